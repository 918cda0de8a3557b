"""Knowledge base, category graph, user overlays and retrieval plans on the given tables.

Roles: customers give a knowledge base (nation number = category, market segment = subcategory, customer number = second
category of the same record) that is written as markdown documents and read back, and they are the users; ``events`` are
their query history.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from caresift import constants as K
from caresift.catalog.registry import query, r6, sql_text, table
from caresift.functions import text as X
from caresift.functions import weights as W
from caresift.operators import classify as C
from caresift.operators import graph as G
from caresift.operators import kb
from caresift.operators.sizes import dealt
from caresift.session import cut_lineage
from caresift.streaming import state

CATS = K.CATEGORIES
NAMES = list(K.CATEGORY_LABELS.values())


def _cat(number):
    return F.element_at(F.array(*[F.lit(c) for c in CATS]), (F.pmod(number, F.lit(20)) + 1).cast("int"))


def _name(slug):
    return F.element_at(F.create_map(*[F.lit(x) for p in K.CATEGORY_LABELS.items() for x in p]), slug)


ARR = "[" + ", ".join(sql_text(c) for c in CATS) + "]"
NAME_ARR = "[" + ", ".join(sql_text(c) for c in NAMES) + "]"
CAT = lambda n: f"{ARR}[(({n}) % 20 + 1)::INT]"


def documents(spark, d):
    """Markdown documents, one per category, from the customers."""
    c = table(spark, d, "customer").select(
        _cat(F.col("c_nationkey")).alias("cat"), _cat(F.col("c_custkey")).alias("other"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("no"))
    counts = c.where(F.col("cat") != F.col("other")).groupBy("cat", "other").agg(F.count(F.lit(1)).alias("n"))
    # at most 20 x 20 links and 20 x 5 subcategories are gathered here, whatever the number of customers
    line = F.format_string("  - [%s](%s.md) %s %d cross-hits", _name(F.col("other")), "other", F.when(F.col("n") % 2 == 0, "—").otherwise("--"), "n")
    strong = F.col("n") % 3 != 0
    links = counts.groupBy("cat").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(strong, line))), "\n").alias("strong"), F.array_join(F.sort_array(F.collect_list(F.when(~strong, line))), "\n").alias("weak"))
    segs = c.groupBy("cat", "seg").agg(F.count(F.lit(1)).alias("n"), (F.max("no") % 20).alias("no"))
    sub = F.concat(F.lit("### "), "seg", F.lit(" & Care (A, B)\n\n- **Related:** ["), _name(_cat(F.col("no") + 1)), F.lit("]("), _cat(F.col("no") + 1), F.lit(".md) (next to it)\n"))
    term = F.format_string("| %s pains | %s | n%d |", F.lower("seg"), F.lower("seg"), "n")
    parts = segs.groupBy("cat").agg(F.array_join(F.sort_array(F.collect_list(sub)), "\n").alias("subs"), F.array_join(F.sort_array(F.collect_list(term)), "\n").alias("terms"))
    text = F.concat(
        F.lit("<!-- draft -->\n\n# "), _name(F.col("cat")), F.lit("\n\n## Links\n- **Strong links:**\n"), "strong", F.lit("\n- **Weak links:**\n"), "weak",
        F.lit("\n\n## Terminology Map\n| Consumer Term | Medical Term | Notes |\n|---|:--|---|\n"), "terms", F.lit("\n\n## Subcategory Details\n"), "subs", F.lit("\n## Known Pitfalls\n- [x](cancer.md) none\n"))
    files = links.join(parts, "cat").select(F.concat(F.lit("/kb/categories/"), "cat", F.lit(".md")).alias("path"), text.alias("text"))
    return kb.documents(files)


def category_graph(spark, d):
    """OPT-9: the graph is read by many joins of one plan, so its few hundred rows are written once."""
    return cut_lineage(G.edges(documents(spark, d)))


KB_SQL = f"""cu AS (SELECT {CAT('c_nationkey')} AS cat, {CAT('c_custkey')} AS other, c_mktsegment AS seg, c_nationkey AS no FROM customer),
  ln AS (SELECT cat, other, count(*)::BIGINT AS n, CASE WHEN count(*) % 3 <> 0 THEN 'strong' ELSE 'weak' END AS t FROM cu WHERE cat <> other GROUP BY 1, 2),
  sg AS (SELECT cat, seg, count(*)::BIGINT AS n, max(no) % 20 AS no, lower(seg) || '_care_a_b' AS sub FROM cu GROUP BY 1, 2),
  ed AS (SELECT 'cat:' || cat AS src, 'cat:' || other AS dst, t AS edge_type, 0.1 + least(1, log10(n + 1) / log10(101)) * (CASE WHEN t = 'strong' THEN 0.85 ELSE 0.35 END - 0.1) AS base_weight FROM ln
    UNION ALL SELECT 'cat:' || cat, 'sub:' || cat || ':' || sub, 'parent_child', 1.0 FROM sg UNION ALL SELECT 'sub:' || cat || ':' || sub, 'cat:' || cat, 'parent_child', 1.0 FROM sg
    UNION ALL SELECT 'sub:' || cat || ':' || sub, 'cat:' || {CAT('no + 1')}, 'related', 0.6 FROM sg WHERE cat <> {CAT('no + 1')})"""


@query("src_05_kb_documents", f"WITH {KB_SQL} SELECT DISTINCT cat AS slug, {NAME_ARR}[list_position({ARR}, cat)] AS name FROM cu")
def src_05(spark, d):
    return documents(spark, d).select("slug", "name")


@query("src_05_kb_links", f"WITH {KB_SQL} SELECT cat AS category, other AS target, t AS link_type, n AS cross_hits, n || ' cross-hits' AS reason FROM ln")
def src_05b(spark, d):
    return kb.links(documents(spark, d)).select("category", "target", "link_type", "cross_hits", "reason")


@query("src_05_kb_terms", f"WITH {KB_SQL} SELECT cat AS category, lower(seg) || ' pains' AS consumer_term, lower(seg) AS medical_term, 'n' || n AS notes FROM sg")
def src_05c(spark, d):
    return kb.terms(documents(spark, d)).select("category", "consumer_term", "medical_term", "notes")


@query("src_05_kb_subcategories", f"WITH {KB_SQL} SELECT cat AS category, sub AS subcategory, seg || ' & Care (A, B)' AS name, {CAT('no + 1')} AS target, 'next to it' AS reason FROM sg")
def src_05d(spark, d):
    docs = documents(spark, d)
    return kb.subcategories(docs).select("category", "subcategory", "name").join(kb.related(docs), ["category", "subcategory"])


@query("wn_04_section_lines", """
    WITH l AS (SELECT page_id, unnest(string_split(text, '|')) AS line, generate_subscripts(string_split(text, '|'), 1) AS pos FROM (SELECT page_id, regexp_replace(regexp_replace(html, '[\\n|]', ' ', 'g'), '<(h1|p|footer)>', '|## \\1|', 'g') AS text FROM pages)),
    s AS (SELECT *, last_value(CASE WHEN line LIKE '## %' THEN pos END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM l)
    SELECT s.page_id, substr(h.line, 4) AS section, count(*)::BIGINT AS lines, sum(length(s.line))::BIGINT AS chars FROM s JOIN l h ON h.page_id = s.page_id AND h.pos = s.head
    WHERE s.pos <> s.head AND trim(s.line) <> '' GROUP BY 1, 2""")
def wn_04(spark, d):
    marked = F.regexp_replace(F.regexp_replace("html", r"[\n|]", " "), "<(h1|p|footer)>", "\n## $1\n")
    docs = table(spark, d, "pages").select(F.col("page_id").alias("slug"), marked.alias("text"))
    body = kb.sections(docs).where(F.col("section") != "").withColumn("line", F.split_part("body", F.lit("\n"), F.lit(2)))
    return body.where(F.trim("line") != "").groupBy(F.col("slug").alias("page_id"), "section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("jn_17_labelled_terms", f"SELECT p_type AS mesh_term, min(p_brand) AS primary_category, min(p_brand) AS category_label FROM part GROUP BY 1")
def jn_17(spark, d):
    from caresift.sources.writers import labelled_terms

    return labelled_terms(table(spark, d, "part").groupBy(F.col("p_type").alias("term")).agg(F.min("p_brand").alias("category")))


@query("graph_edges", f"WITH {KB_SQL} SELECT src, dst, edge_type, round(base_weight, 6) AS base_weight FROM ed")
def graph_edges(spark, d):
    return G.edges(documents(spark, d)).withColumn("base_weight", r6(F.col("base_weight")))


@query("graph_nodes", f"WITH {KB_SQL} SELECT 'cat:' || cat AS node, 'category' AS node_type, cat AS category FROM (SELECT DISTINCT cat FROM cu) UNION ALL SELECT 'sub:' || cat || ':' || sub, 'subcategory', cat FROM sg")
def graph_nodes(spark, d):
    return G.nodes(documents(spark, d)).select("node", "node_type", "category")


@query("cls_14_condition_registry", f"""WITH {KB_SQL},
    v AS (SELECT cat, sub, unnest([lower(seg) || ' & care (a, b)', lower(seg) || ' & care', lower(seg), 'a ' || lower(seg) || ' & care', lower(seg) || ' & care a', 'b ' || lower(seg) || ' & care', lower(seg) || ' & care b', lower(seg) || ' pains']) AS name FROM sg)
    SELECT name, max(cat) AS category, arg_max(sub, cat) AS subcategory FROM v GROUP BY 1""")
def cls_14(spark, d):
    return kb.condition_registry(documents(spark, d))


# --- users -----------------------------------------------------------------------------------------------------

def profiles(spark, d):
    key = F.col("c_custkey")
    sub = X.slugify(F.concat("c_mktsegment", F.lit(" & Care (A, B)")))
    condition = lambda name, cat, s, active: F.struct(name.alias("name"), cat.alias("category_id"), s.alias("subcategory_id"), active.alias("active"))
    med = lambda name, cat: F.struct(name.alias("name"), cat.alias("category_id"))
    conditions = F.array(condition(F.lower("c_mktsegment"), _cat(F.col("c_nationkey")), sub, key % 7 != 0), condition(F.lit("other"), _cat(key * 3), F.when(key % 2 == 0, sub).otherwise("nowhere"), F.lit(True)))
    return table(spark, d, "customer").select(
        key.alias("user_id"), (key % 90).cast("int").alias("age"), F.when(key % 3 == 0, "female").when(key % 3 == 1, "male").otherwise("other").alias("sex"),
        F.when(key % 5 == 0, F.filter(conditions, lambda _: F.lit(False))).otherwise(conditions).alias("conditions"),
        F.array(med(F.lit("m1"), _cat(F.floor(key / 20))), med(F.lit("m2"), F.lit(K.MEDICATIONS))).alias("medications"))


USERS_SQL = f"""us AS (SELECT c_custkey AS user_id, c_custkey % 90 AS age, c_custkey % 3 AS sex, {CAT('c_custkey // 20')} AS med FROM customer),
  co AS (SELECT c_custkey AS user_id, {CAT('c_nationkey')} AS cat, lower(c_mktsegment) || '_care_a_b' AS sub, lower(c_mktsegment) AS name FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0
    UNION ALL SELECT c_custkey, {CAT('c_custkey * 3')}, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) || '_care_a_b' ELSE 'nowhere' END, 'other' FROM customer WHERE c_custkey % 5 <> 0),
  an AS (SELECT co.user_id, 'cat:' || co.cat AS cat, 'sub:' || co.cat || ':' || co.sub AS sub, co.name FROM co JOIN sg ON sg.cat = co.cat AND sg.sub = co.sub),
  b1 AS (SELECT user_id, src, dst, CASE WHEN edge_type = 'strong' THEN 0.30 ELSE 0.25 END AS boost FROM an JOIN ed ON src = an.cat AND dst LIKE 'cat:%'),
  b2 AS (SELECT user_id, src, dst, 0.15 AS boost FROM an JOIN ed ON src = an.sub AND edge_type = 'related'),
  cm(a, b, s, t, boost) AS (VALUES {", ".join(f"({sql_text(a)}, {sql_text(b)}, {sql_text(s)}, {sql_text(t)}, {v})" for a, b, s, t, v, _ in K.COMORBIDITY)}),
  uc AS (SELECT DISTINCT user_id, cat FROM co),
  b3 AS (SELECT x.user_id, 'cat:' || s AS src, 'cat:' || t AS dst, boost FROM uc x JOIN uc y ON x.user_id = y.user_id JOIN cm ON cm.a = x.cat AND cm.b = y.cat),
  ag(lo, hi, t, boost) AS (VALUES {", ".join(f"({lo}, {hi}, {sql_text(t)}, {v})" for lo, hi, t, v, _ in K.AGE_BOOSTS)}),
  sx(sex, t, boost) AS (VALUES {", ".join(f"({0 if s == 'female' else 1}, {sql_text(t)}, {v})" for s, t, v, _ in K.SEX_BOOSTS)}),
  uf AS (SELECT user_id, cat FROM an GROUP BY ALL UNION ALL SELECT user_id, 'cat:' || unnest({ARR}) FROM us WHERE user_id NOT IN (SELECT user_id FROM an)),
  b4 AS (SELECT us.user_id, uf.cat AS src, 'cat:' || t AS dst, boost FROM us JOIN uf USING (user_id) JOIN ag ON age >= lo AND age < hi WHERE uf.cat <> 'cat:' || t
    UNION ALL SELECT us.user_id, uf.cat, 'cat:' || t, boost FROM us JOIN uf USING (user_id) JOIN sx USING (sex) WHERE uf.cat <> 'cat:' || t),
  b5 AS (SELECT user_id, 'cat:' || med AS src, 'cat:{K.MEDICATIONS}' AS dst, 0.10 AS boost FROM us WHERE med <> '{K.MEDICATIONS}' UNION ALL SELECT user_id, 'cat:{K.MEDICATIONS}', 'cat:' || med, 0.05 FROM us WHERE med <> '{K.MEDICATIONS}'),
  bo AS (SELECT *, 'anchor' AS source_type FROM b1 UNION ALL SELECT *, 'expand' FROM b2 UNION ALL SELECT *, 'comorbidity' FROM b3 UNION ALL SELECT *, 'demographic' FROM b4 UNION ALL SELECT *, 'medication' FROM b5)"""


def _boosts(df):
    return df.select("user_id", "src", "dst", F.col("boost").cast("double").alias("boost"))


def _boost_sql(name):
    return f"WITH {KB_SQL}, {USERS_SQL} SELECT user_id, src, dst, boost::DOUBLE AS boost FROM {name}"


@query("jn_11_anchor_boosts", _boost_sql("b1"))
def jn_11(spark, d):
    graph = category_graph(spark, d)
    return _boosts(G.anchor_boosts(G.anchored(profiles(spark, d), graph), graph))


@query("jn_11_expand_boosts", _boost_sql("b2"))
def jn_11b(spark, d):
    graph = category_graph(spark, d)
    return _boosts(G.expand_boosts(G.anchored(profiles(spark, d), graph), graph))


@query("jn_09_comorbidity_boosts", _boost_sql("b3"))
def jn_09(spark, d):
    return _boosts(G.comorbidity_boosts(profiles(spark, d), category_graph(spark, d)))


@query("jn_10_demographic_boosts", _boost_sql("b4"))
def jn_10(spark, d):
    users = profiles(spark, d)
    graph = category_graph(spark, d)
    return _boosts(G.demographic_boosts(users, G.anchored(users, graph), graph))


@query("jn_12_medication_boosts", _boost_sql("b5"))
def jn_12(spark, d):
    return _boosts(G.medication_boosts(profiles(spark, d), category_graph(spark, d)))


PLAN_SQL = f"""qs AS (SELECT c_custkey AS user_id, 'cat:' || {CAT('c_custkey * 7')} AS src FROM customer),
  hi AS (SELECT user_id, 'cat:' || {CAT("(props->>'$.k')::INT")} AS src, 'cat:' || {CAT("(props->>'$.k')::INT + length(event_type)")} AS dst, count(*) AS cnt, max(ts) AS last FROM events GROUP BY 1, 2, 3),
  ce AS (SELECT src, dst, base_weight FROM ed WHERE src LIKE 'cat:%' AND dst LIKE 'cat:%'),
  tb AS (SELECT user_id, src, dst, sum(boost) AS boosts FROM (SELECT user_id, src, dst, boost FROM bo UNION ALL SELECT user_id, dst, src, boost FROM bo) GROUP BY 1, 2, 3),
  ca AS (SELECT user_id, src, dst, base_weight, TRUE AS direct FROM qs JOIN ce USING (src)
    UNION ALL SELECT DISTINCT qs.user_id, qs.src, an.cat, 0.0, FALSE FROM qs JOIN an USING (user_id) WHERE an.cat <> qs.src AND qs.src IN (SELECT src FROM ce UNION SELECT dst FROM ce) AND NOT EXISTS (SELECT 1 FROM ce WHERE ce.src = qs.src AND ce.dst = an.cat)),
  pl AS (SELECT user_id, src, dst, least(1, base_weight + CASE WHEN coalesce(boosts, 0) <= 0 THEN 0 ELSE 0.4 * (1 - exp(-boosts / 0.4)) END
      + CASE WHEN direct AND cnt IS NOT NULL THEN least(cnt * 0.02 * pow(0.5, ((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(last)) / 86400000000.0) / 90), 0.15) ELSE 0 END) AS weight
    FROM ca LEFT JOIN tb USING (user_id, src, dst) LEFT JOIN hi USING (user_id, src, dst) WHERE direct OR boosts IS NOT NULL)"""
BUCKET = "CASE WHEN weight >= 0.6 THEN 'must' WHEN weight >= 0.35 THEN 'may' END"


def history(spark, d):
    k = F.from_json("props", "k int")["k"]
    touches = table(spark, d, "events").select(
        "user_id", F.array(F.concat(F.lit("cat:"), _cat(k)), F.concat(F.lit("cat:"), _cat(k + F.length("event_type")))).alias("nodes"), F.col("ts").cast("timestamp").alias("ts"))
    touches = dealt(touches, 200_000)  # counted per edge and task
    return state.query_history(state.history_increments(touches))


def plan(spark, d):
    graph = category_graph(spark, d)
    users = profiles(spark, d)
    queries = users.select(F.col("user_id").alias("query_id"), "user_id", _cat(F.col("user_id") * 7).alias("primary_category"))
    return G.retrieval_plan(queries, graph, G.user_overlay(users, graph), history(spark, d), G.anchored(users, graph), F.lit("2024-03-01").cast("timestamp"))


@query("jn_07_retrieval_plan", f"WITH {KB_SQL}, {USERS_SQL}, {PLAN_SQL} SELECT user_id AS query_id, substr(dst, 5) AS category, round(weight, 5) AS weight, {BUCKET} AS bucket FROM pl WHERE weight NOT BETWEEN 0.349999 AND 0.350001 AND weight NOT BETWEEN 0.599999 AND 0.600001")
def jn_07(spark, d):
    # weights within rounding of a threshold may fall on either side in two engines
    w = F.col("weight")
    return plan(spark, d).where(~w.between(0.349999, 0.350001) & ~w.between(0.599999, 0.600001)).withColumn("weight", F.round("weight", 5))


@query("jn_08_promoted_categories", f"WITH {KB_SQL}, {USERS_SQL}, {PLAN_SQL} SELECT user_id AS query_id, substr(dst, 5) AS category, round(weight, 5) AS weight FROM pl WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.src = pl.src AND ce.dst = pl.dst)")
def jn_08(spark, d):
    graph = category_graph(spark, d).where(F.col("dst").startswith("cat:"))
    direct = graph.select(F.substring("src", 5, 100).alias("p"), F.substring("dst", 5, 100).alias("category"))
    rows = plan(spark, d).withColumn("p", _cat(F.col("query_id") * 7))
    return rows.join(direct, ["p", "category"], "left_anti").select("query_id", "category", F.round("weight", 5).alias("weight"))


@query("ag_39_baseline_weights", f"WITH {KB_SQL}, {USERS_SQL}, {PLAN_SQL} SELECT u.sex AS user_id, substr(dst, 5) AS category, round(max(weight), 5) AS weight FROM pl JOIN us u USING (user_id) GROUP BY 1, 2")
def ag_39(spark, d):
    rows = plan(spark, d).select((F.col("query_id") % 3).alias("user_id"), "category", "weight")
    return G.baseline_weights(rows).withColumn("weight", F.round("weight", 5))


@query("set_04_adjusted_weights", """
    WITH b AS (SELECT c_custkey AS user_id, c_mktsegment AS category, 0.5 AS weight FROM customer), a AS (SELECT o_custkey AS user_id, 'MACHINERY' AS category, max(o_totalprice) / 500000 AS proposed FROM orders GROUP BY 1)
    SELECT user_id, category, CASE WHEN proposed IS NULL THEN weight ELSE round(round(greatest(0.05, least(0.95, coalesce(weight, 0) + greatest(-0.2, least(0.3, proposed - coalesce(weight, 0))))), 4), 3) END::DOUBLE AS weight FROM b FULL JOIN a USING (user_id, category)""")
def set_04(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("category"), F.lit(0.5).alias("weight"))
    adj = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg((F.max("o_totalprice") / 500000).alias("proposed")).withColumn("category", F.lit("MACHINERY"))
    return G.adjusted_weights(base, adj, ["user_id"]).select("user_id", "category", F.round("weight", 3).alias("weight"))


@query("ag_40_memory_weights", """
    WITH f AS (SELECT user_id, event_type AS category, count_if(value < 5)::BIGINT AS fresh, count_if(value > 60)::BIGINT AS grown FROM events WHERE value < 5 OR value > 60 GROUP BY 1, 2),
    p AS (SELECT DISTINCT user_id, 'click' AS category, 0.6 AS weight FROM events)
    SELECT user_id, category, round(CASE WHEN coalesce(grown, 0) > 0 THEN least(0.95, x + 0.15 * grown) ELSE x END, 6)::DOUBLE AS weight FROM (
      SELECT *, CASE WHEN coalesce(fresh, 0) > 0 THEN least(0.95, coalesce(weight, 0.3) + 0.1 * fresh) ELSE coalesce(weight, 0.3) END AS x FROM p FULL JOIN f USING (user_id, category))""")
def ag_40(spark, d):
    e = table(spark, d, "events")
    facts = e.where((F.col("value") < 5) | (F.col("value") > 60)).select("user_id", F.col("event_type").alias("category"), (F.col("value") > 60).alias("graduated"))
    start = e.select("user_id", F.lit("click").alias("category"), F.lit(0.6).alias("weight")).distinct()
    return G.memory_weights(start, facts, ["user_id"]).withColumn("weight", r6(F.col("weight")))


@query("str_05_profile_change", f"""WITH {KB_SQL}, {USERS_SQL} SELECT user_id, src, dst, boost::DOUBLE AS boost FROM b5 WHERE user_id % 4 <> 0 UNION ALL SELECT user_id, src, dst, boost::DOUBLE FROM bo WHERE user_id % 4 = 0""")
def str_05(spark, d):
    # every fourth profile has changed; the others keep the medication boosts they had
    users, graph = profiles(spark, d), category_graph(spark, d)
    return _boosts(G.rebuilt_for(users.where(F.col("user_id") % 4 == 0), graph, G.medication_boosts(users, graph)))


@query("str_04_decayed_history", f"""SELECT user_id, src, dst, cnt::BIGINT AS cnt, round(least(cnt * 0.02 * pow(0.5, ((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(last)) / 86400000000.0) / 90), 0.15), 6) AS boost
    FROM (SELECT user_id, 'cat:' || {CAT("(props->>'$.k')::INT")} AS src, 'cat:' || {CAT("(props->>'$.k')::INT + length(event_type)")} AS dst, count(*) AS cnt, max(ts) AS last FROM events GROUP BY 1, 2, 3)""")
def str_04(spark, d):
    return state.decayed(history(spark, d), F.lit("2024-03-01").cast("timestamp")).select("user_id", "src", "dst", "cnt", r6(F.col("boost")).alias("boost"))


@query("jn_13_novel_facts", f"""
    WITH f AS (SELECT user_id, event_type || ' ' || c_mktsegment AS fact FROM events JOIN customer ON c_custkey = user_id)
    SELECT user_id, fact FROM f WHERE user_id % 5 = 0 OR NOT (contains(lower(fact), (SELECT lower(c_mktsegment) FROM customer WHERE c_custkey = f.user_id)) OR contains(lower(fact), 'other') OR contains(lower(fact), 'm1') OR contains(lower(fact), 'm2'))""")
def jn_13(spark, d):
    users = profiles(spark, d)
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    facts = table(spark, d, "events").join(names, "user_id").select("user_id", F.concat_ws(" ", "event_type", "c_mktsegment").alias("fact"))
    return state.novel_facts(facts, users)
