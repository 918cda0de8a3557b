"""Categorisation, tiers and corpus statistics on the given tables.

Roles: ``documents`` are records (source = dataset, lang = subject), user turns with the reply that follows are dialogues.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from caresift import constants as K
from caresift.catalog.registry import (
    MESH_RULES, PHARMA_RULES, QUESTION_RULES, TOPIC_RULES, query, r6, sql_any, sql_count, sql_first, sql_map, sql_text, table, texts,
)
from caresift.functions import rules as RU
from caresift.functions import text as X
from caresift.operators import categorize as C
from caresift.operators import corpus as O
from caresift.operators import sampling, turns

SUBJECTS = {"en": "Medicine", "fr": "Pharmacology", "de": "Dental", "es": "Anatomy"}
WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(8239)||chr(12288)"


def records(spark, d):
    """Documents as exam records."""
    subject = F.element_at(F.create_map(*[F.lit(x) for p in SUBJECTS.items() for x in p]), F.col("lang"))
    return texts(spark, d, "documents", "doc_id", "text", "lang", "source").select(
        F.col("doc_id").alias("id"), F.col("text").alias("question"), F.col("text").alias("exp"), subject.alias("subject_name"),
        F.col("source").alias("topic_name"), "lang", "source")


def dialogues(spark, d):
    return turns.dialogue_pairs(table(spark, d, "conversations"))


RECORDS_SQL = f"SELECT doc_id AS id, lower(trim(text, {WS})) AS q, {sql_map('lang', SUBJECTS)} AS subject, lower(source) AS topic, lang, source, text FROM documents"
DIALOGUE_SQL = f"""SELECT a.conv_id, a.turn, lower(trim(a.text, {WS})) AS i, lower(trim(b.text, {WS})) AS o, trim(b.text, {WS}) AS raw
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"""


def sql_ranked(source: str, parts, keys: str, default: str, extra: str = "") -> str:
    """Primary and secondary category by score, with ties by the order in which categories first score."""
    rows, position = [], 0
    for rules, expr, weight in parts:
        for rule in rules:
            rows.append(f"SELECT {keys}, {sql_text(rule.category)} AS category, {weight} * {expr(rule)} AS pts, {position} AS pos FROM src")
            position += 1
    return f"""WITH src AS ({source}), pts AS ({' UNION ALL '.join(rows)}),
      sc AS (SELECT {keys}, category, sum(pts) AS score, min(CASE WHEN pts > 0 THEN pos END) AS seen FROM pts GROUP BY ALL HAVING sum(pts) > 0),
      rk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, seen) AS rn FROM sc),
      top AS (SELECT {keys}, max(CASE WHEN rn = 1 THEN category END) AS p, max(CASE WHEN rn = 2 AND score >= 2 THEN category END) AS s FROM rk GROUP BY ALL)
    SELECT {', '.join('src.' + k.strip() for k in keys.split(','))}, coalesce(p, {sql_text(default)}) AS primary_category, s AS secondary_category {extra} FROM src LEFT JOIN top USING ({keys})"""


CATEGORIZED_SQL = sql_ranked(
    f"SELECT doc_id, lower(trim(text, {WS})) AS q FROM documents", [(QUESTION_RULES, lambda r: sql_any("q", r.keywords) + "::INT", 2), (MESH_RULES, lambda r: sql_count("q", r.keywords), 1)],
    "doc_id", K.MEDICATIONS)
# tiers by length only in the shared fixture; CLS-07 has its own query
FIXTURE_SQL = f"""SELECT c.doc_id, d.source AS dataset, d.lang AS subject_name, c.primary_category, coalesce(c.secondary_category, '') AS secondary_category,
    CASE WHEN n_chars > 3000 THEN 'TIER_A' WHEN n_chars > 1000 THEN 'TIER_B' WHEN n_chars > 300 THEN 'TIER_C' ELSE 'TIER_D' END AS quality_tier,
    coalesce(l.quality = 1, FALSE) AS has_explanation
  FROM ({CATEGORIZED_SQL}) c JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)"""


def categorized(spark, d):
    """All documents in the common schema: scored categories, a tier by length, explained when labelled good."""
    docs, labels = texts(spark, d, "documents", "doc_id", "text", "source", "lang", "n_chars"), table(spark, d, "labels")
    lowered = F.lower(X.strip(F.col("text")))
    scored = RU.scored_categories(
        [(QUESTION_RULES, RU.hit_array(lowered, QUESTION_RULES), 2), (MESH_RULES, RU.count_array(lowered, MESH_RULES), 1)], K.MEDICATIONS)
    ranked = docs.withColumn("_c", scored).withColumns({"primary_category": F.col("_c.primary"), "secondary_category": F.col("_c.secondary")})
    n = F.col("n_chars")
    tier = F.when(n > 3000, "TIER_A").when(n > 1000, "TIER_B").when(n > 300, "TIER_C").otherwise("TIER_D")
    joined = ranked.withColumn("quality_tier", tier).join(labels.select("doc_id", "quality"), "doc_id", "left")
    return O.harmonised(joined, F.col("source"), F.col("doc_id"), F.col("text"), F.col("lang"), None, F.coalesce(F.col("quality") == 1, F.lit(False)), question_chars=None)


@query("cls_01_keyword", f"SELECT doc_id, {sql_any('lower(text)', ['Eauoi'.lower(), 'ntth', 'schung'])} AS hit FROM documents")
def cls_01(spark, d):
    rows = texts(spark, d, "documents", "doc_id", "text")
    return rows.select("doc_id", RU.any_keyword(F.lower("text"), ["eauoi", "ntth", "schung"]).alias("hit"))


@query("cls_02_first_rule", f"SELECT category, count(*)::BIGINT AS n FROM (SELECT {sql_first('lower(text)', QUESTION_RULES)} AS category FROM documents) GROUP BY category")
def cls_02(spark, d):
    rows = texts(spark, d, "documents", "text").select(RU.first_match(F.lower("text"), QUESTION_RULES).alias("category"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_DIRECT = "CASE subject " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in K.SUBJECT_DIRECT.items()) + " END"
_BROAD = "CASE subject " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in K.SUBJECT_BROAD.items()) + " END"


@query("cls_03_exam_categories", f"""
    WITH a AS (SELECT *, {_DIRECT} AS direct FROM ({RECORDS_SQL})),
    b AS (SELECT *, CASE WHEN direct IS NULL AND subject = 'Pharmacology' THEN coalesce({sql_first('topic', PHARMA_RULES)}, {sql_first('q', PHARMA_RULES)}) END AS drug FROM a),
    c AS (SELECT *, CASE WHEN direct IS NOT NULL THEN direct WHEN subject = 'Pharmacology' THEN coalesce(drug, 'medications_drug_safety')
      ELSE coalesce({sql_first('topic', TOPIC_RULES)}, {sql_first('q', QUESTION_RULES)}, {_BROAD}, 'medications_drug_safety') END AS primary_category FROM b)
    SELECT id, primary_category, CASE WHEN direct IS NOT NULL THEN {sql_first('q', QUESTION_RULES, 'direct')}
      WHEN subject = 'Pharmacology' THEN CASE WHEN drug IS NOT NULL THEN 'medications_drug_safety' END
      WHEN primary_category <> 'cancer' AND {sql_any('q', K.CANCER_SIGNALS)} THEN 'cancer' END AS secondary_category FROM c""")
def cls_03(spark, d):
    return C.categorize_mcq(records(spark, d), TOPIC_RULES, QUESTION_RULES, PHARMA_RULES).select("id", "primary_category", "secondary_category")


@query("cls_04_literature_categories", sql_ranked(
    f"SELECT doc_id, lower(lang || ' ' || text) AS m, lower(trim(text, {WS})) AS q FROM documents",
    [(MESH_RULES, lambda r: sql_count("m", r.keywords), 1), (QUESTION_RULES, lambda r: sql_any("q", r.keywords) + "::INT", 2)], "doc_id", K.MEDICATIONS))
def cls_04(spark, d):
    rows = texts(spark, d, "documents", "doc_id", "text", "lang").select("doc_id", F.col("text").alias("question"), F.struct(F.array("lang", "text").alias("meshes")).alias("context"))
    return C.categorize_literature(rows, MESH_RULES, QUESTION_RULES).select("doc_id", "primary_category", "secondary_category")


_ROUTE = "CASE " + " ".join(f"WHEN contains(site, {sql_text(k)}) THEN {sql_text(c)}" for k, c in K.SITE_ROUTES if c) + " END"


@query("cls_05_consumer_categories", f"""
    WITH a AS (SELECT conv_id, turn, i AS q, o AS a, CASE WHEN turn = 2 THEN 'niddk_x' WHEN turn = 4 THEN 'gard' ELSE 'other' END AS site,
        CASE WHEN turn = 0 THEN 'treatment' ELSE 'symptoms' END AS kind FROM ({DIALOGUE_SQL})),
    b AS (SELECT *, coalesce({_ROUTE}, {sql_first('q', QUESTION_RULES)}, {sql_first('a', QUESTION_RULES)}) AS p FROM a)
    SELECT conv_id, turn, coalesce(p, 'public_health_prevention') AS primary_category,
      CASE WHEN p <> 'cancer' AND {sql_any("(q || ' ' || a)", K.CANCER_SIGNALS)} THEN 'cancer' WHEN kind = 'treatment' AND p <> 'medications_drug_safety' THEN 'medications_drug_safety' END AS secondary_category FROM b""")
def cls_05(spark, d):
    t = F.col("turn")
    rows = dialogues(spark, d).select(
        "conv_id", "turn", F.col("input").alias("question"), F.col("output").alias("answer"),
        F.when(t == 2, "NIDDK_x").when(t == 4, "gard").otherwise("other").alias("source"), F.when(t == 0, " Treatment").otherwise("symptoms").alias("question_type"))
    return C.categorize_consumer(rows, QUESTION_RULES, preview_chars=None).select("conv_id", "turn", "primary_category", "secondary_category")


@query("cls_06_dialogue_categories", sql_ranked(
    DIALOGUE_SQL, [(QUESTION_RULES, lambda r: sql_any("i", r.keywords) + "::INT", 2), (QUESTION_RULES, lambda r: sql_any("o", r.keywords) + "::INT", 1)], "conv_id, turn", K.PUBLIC_HEALTH
).replace("s AS secondary_category", f"CASE WHEN coalesce(p, '') <> 'cancer' AND {sql_any(chr(40) + 'i || chr(32) || o' + chr(41), K.CANCER_SIGNALS)} THEN 'cancer' ELSE s END AS secondary_category"))
def cls_06(spark, d):
    return C.categorize_dialogue(dialogues(spark, d), QUESTION_RULES, preview_chars=None).select("conv_id", "turn", "primary_category", "secondary_category")


def _alternatives(patterns):
    return sql_text("|".join(f"(?:{p})" for p in patterns))


@query("cls_07_explanation_tier", f"""
    SELECT doc_id, CASE WHEN t IN ('', 'null', 'none') THEN 'TIER_D' WHEN regexp_matches(t, {_alternatives(K.TEXTBOOK_PATTERNS)}) THEN 'TIER_A'
      WHEN length(t) < 50 AND regexp_matches(t, {_alternatives(K.MINIMAL_PATTERNS)}) THEN 'TIER_C' WHEN length(t) < 20 THEN 'TIER_C' ELSE 'TIER_B' END AS tier
    FROM (SELECT doc_id, lower(trim(text, {WS})) AS t FROM documents)""")
def cls_07(spark, d):
    return texts(spark, d, "documents", "doc_id", "text").select("doc_id", C.explanation_tier(F.col("text")).alias("tier"))


@query("cls_08_dialogue_tier", f"""
    SELECT conv_id, turn, CASE WHEN length(raw) < 50 OR {sql_any('o', K.DEFLECTION_PHRASES)} OR (right(raw, 1) NOT IN ('.', '!', '?') AND length(raw) < 300) THEN 'TIER_D'
      WHEN (cond AND {sql_any('o', K.MECHANISM_PHRASES)} AND ({sql_any('o', K.DRUG_SIGNALS)} OR {sql_any('o', K.CONDITIONAL_PHRASES)})) THEN 'TIER_A'
      WHEN (cond OR {sql_any('o', K.DRUG_SIGNALS)}) AND {sql_any('o', K.RECOMMENDATION_PHRASES)} THEN 'TIER_B'
      WHEN {sql_any('o', K.RECOMMENDATION_PHRASES)} THEN 'TIER_C' ELSE 'TIER_D' END AS quality_tier
    FROM (SELECT *, {sql_any('o', K.CONDITION_ENDINGS)} OR regexp_matches(raw, '\\([A-Z]{{2,6}}\\)') AS cond FROM ({DIALOGUE_SQL}))""")
def cls_08(spark, d):
    return C.dialogue_tier(dialogues(spark, d), "output").select("conv_id", "turn", "quality_tier")


_SETS = {name: [{"dataset": "dataset", "primary_category": "primary_category", "quality_tier": "quality_tier", "subject_name": "subject_name",
                 "has_explanation": "has_explanation", "secondary_category": "secondary_category"}[c] for c in cols] for name, cols in O.STAT_SETS.items()}
_STATS_SQL = f"WITH f AS ({FIXTURE_SQL}) " + " UNION ALL ".join(
    "SELECT " + sql_text(n) + " AS stat, " + ", ".join((c if c in cols else f"NULL AS {c}") for c in O.STAT_COLUMNS) + ", count(*)::BIGINT AS cnt FROM f"
    + (" WHERE secondary_category <> ''" if "secondary_category" in cols else "") + (" GROUP BY " + ", ".join(cols) if cols else "")
    for n, cols in _SETS.items())


@query("ag_01_corpus_stats", _STATS_SQL)
def ag_01(spark, d):
    return O.corpus_stats(categorized(spark, d))


@query("ag_02_shares", f"""
    WITH f AS ({FIXTURE_SQL}), c AS (SELECT primary_category, quality_tier, count(*)::BIGINT AS cnt FROM f GROUP BY 1, 2)
    SELECT *, round(cnt * 100.0 / sum(cnt) OVER (), 6) AS pct, round(cnt * 100.0 / sum(cnt) OVER (PARTITION BY primary_category), 6) AS pct_of_category FROM c""")
def ag_02(spark, d):
    counts = categorized(spark, d).groupBy("primary_category", "quality_tier").agg(F.count(F.lit(1)).alias("cnt"))
    out = O.shares(O.shares(counts), ["primary_category"], "pct_of_category")
    return out.withColumns({"pct": r6(F.col("pct")), "pct_of_category": r6(F.col("pct_of_category"))})


@query("ag_03_category_block", f"""
    WITH f AS ({FIXTURE_SQL}) SELECT primary_category, count(*)::BIGINT AS total, count_if(dataset = 'src0')::BIGINT AS ds_src0, count_if(dataset = 'src1')::BIGINT AS ds_src1,
      count_if(quality_tier = 'TIER_A')::BIGINT AS tier_a, count_if(quality_tier = 'TIER_B')::BIGINT AS tier_b, count_if(quality_tier = 'TIER_C')::BIGINT AS tier_c,
      count_if(quality_tier = 'TIER_D')::BIGINT AS tier_d, count_if(NOT has_explanation)::BIGINT AS missing FROM f GROUP BY 1""")
def ag_03(spark, d):
    return O.category_block(categorized(spark, d), ["src0", "src1"])


@query("ag_03_top_subjects", f"""
    WITH f AS ({FIXTURE_SQL}), c AS (SELECT primary_category, subject_name, count(*)::BIGINT AS cnt FROM f GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY cnt DESC, subject_name) AS rn FROM c) WHERE rn <= 3""")
def ag_03b(spark, d):
    return O.top_subjects(categorized(spark, d), 3).withColumn("rn", F.col("rn").cast("bigint"))


@query("ag_04_coverage_gap", f"""
    WITH f AS ({FIXTURE_SQL}), b AS (SELECT primary_category, count_if(dataset = 'src0') AS lit, count_if(dataset = 'src1') AS exam FROM f GROUP BY 1)
    SELECT primary_category, CASE WHEN lit = 0 THEN {sql_text(K.GAP_LABELS['no_literature'])} WHEN exam = 0 THEN {sql_text(K.GAP_LABELS['no_exam'])} WHEN lit < exam * 0.1 THEN {sql_text(K.GAP_LABELS['low_literature'])} ELSE {sql_text(K.GAP_LABELS['good'])} END AS gap FROM b""")
def ag_04(spark, d):
    block = O.category_block(categorized(spark, d), ["src0", "src1"])
    return block.select("primary_category", O.coverage_gap(F.col("ds_src0"), F.col("ds_src1")).alias("gap"))


@query("ag_05_category_pairs", f"""
    WITH f AS ({FIXTURE_SQL}) SELECT primary_category, secondary_category, count(*)::BIGINT AS cnt FROM f WHERE secondary_category <> '' GROUP BY 1, 2
    ORDER BY cnt DESC, 1, 2 LIMIT 20""")
def ag_05(spark, d):
    return O.category_pairs(categorized(spark, d))


@query("ag_05_missing_explanations", f"WITH f AS ({FIXTURE_SQL}) SELECT primary_category, count(*)::BIGINT AS cnt FROM f WHERE NOT has_explanation GROUP BY 1")
def ag_05b(spark, d):
    return O.missing_explanations(categorized(spark, d), None)


@query("ag_06_term_categories", f"""
    WITH f AS ({FIXTURE_SQL}), c AS (SELECT t AS term, primary_category AS category, count(*)::BIGINT AS cnt FROM (SELECT unnest([dataset, subject_name, quality_tier]) AS t, primary_category FROM f) GROUP BY 1, 2)
    SELECT term, category, cnt FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY cnt DESC, category) AS rn FROM c) WHERE rn = 1""")
def ag_06(spark, d):
    return O.term_categories(categorized(spark, d).withColumn("mesh_terms", F.array("dataset", "subject_name", "quality_tier")))


LINKS_SQL = f"""WITH f AS ({FIXTURE_SQL}), c AS (SELECT primary_category, secondary_category AS target, count(*)::BIGINT AS cross_hits FROM f WHERE secondary_category <> '' GROUP BY 1, 2)
    SELECT *, CASE WHEN rn <= 3 THEN 'strong' ELSE 'weak' END AS link_type FROM (SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY cross_hits DESC, target) AS rn FROM c) WHERE rn <= 6"""


@query("ag_07_category_links", LINKS_SQL)
def ag_07(spark, d):
    return O.category_links(categorized(spark, d)).withColumn("rn", F.col("rn").cast("bigint"))


@query("ag_41_weakest_subjects", f"""
    WITH f AS ({FIXTURE_SQL}) SELECT subject_name AS subject, count(*)::BIGINT AS total, count_if(NOT has_explanation)::BIGINT AS missing, round(count_if(NOT has_explanation) * 100.0 / count(*), 6) AS missing_pct
    FROM f GROUP BY 1 HAVING count(*) >= 110 ORDER BY count_if(NOT has_explanation) * 100.0 / count(*) DESC, 1 LIMIT 8""")
def ag_41(spark, d):
    return O.weakest_subjects(categorized(spark, d), None, 110).withColumn("missing_pct", r6(F.col("missing_pct")))


@query("ag_44_tier_samples", f"""
    WITH f AS ({FIXTURE_SQL}) SELECT primary_category, id, rn FROM (SELECT primary_category, doc_id::VARCHAR AS id, row_number() OVER (PARTITION BY primary_category ORDER BY doc_id::VARCHAR) AS rn
      FROM f WHERE quality_tier = 'TIER_A') WHERE rn <= 30""")
def ag_44(spark, d):
    return O.first_per_category(categorized(spark, d), 30, "TIER_A").select("primary_category", "id", F.col("rn").cast("bigint").alias("rn"))


@query("lim_02_seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def lim_02(spark, d):
    return sampling.seeded_sample(table(spark, d, "documents").select("doc_id", "lang"), 100, "doc_id", 42)


@query("lim_03_page", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def lim_03(spark, d):
    return sampling.page(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], 50, 100)


@query("lim_03_spread_pages", """
    WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, count(*) OVER () // 7 AS step FROM documents)
    SELECT doc_id, row_idx::BIGINT AS row_idx, (row_idx // step)::BIGINT AS page FROM n WHERE row_idx % step < 10 AND row_idx // step < 7""")
def lim_03b(spark, d):
    return sampling.spread_pages(table(spark, d, "documents").select("doc_id"), ["doc_id"], 7, 10)


@query("lim_04_review_queue", f"""
    WITH f AS ({FIXTURE_SQL}) SELECT doc_id::VARCHAR AS id, dataset, primary_category, secondary_category FROM f WHERE secondary_category <> '' AND quality_tier = 'TIER_D'
    ORDER BY dataset, id LIMIT 20""")
def lim_04(spark, d):
    rows = O.review_queue(categorized(spark, d), (F.col("secondary_category") != "") & (F.col("quality_tier") == "TIER_D"))
    return rows.select("id", "dataset", "primary_category", "secondary_category")


@query("lim_05_by_count", f"WITH f AS ({FIXTURE_SQL}) SELECT subject_name, dataset, count(*)::BIGINT AS cnt FROM f GROUP BY 1, 2 ORDER BY cnt DESC, 1, 2 LIMIT 10")
def lim_05(spark, d):
    counts = categorized(spark, d).groupBy("subject_name", "dataset").agg(F.count(F.lit(1)).alias("cnt"))
    return O.by_count(counts, "subject_name", "dataset").limit(10)


@query("lim_06_repeated", "SELECT item_id, sample_idx::INT AS sample_idx FROM benchmark, range(4) r(sample_idx)")
def lim_06(spark, d):
    return sampling.repeated(table(spark, d, "benchmark").select("item_id"), 4)


@query("lim_07_companions", """
    WITH t AS (SELECT doc_id AS train_id, row_number() OVER (ORDER BY doc_id) - 1 AS at, count(*) OVER () AS n FROM documents),
    w AS (SELECT item_id, shot, (SELECT count(*) FROM documents) AS n, ('0x' || substr(md5('42:' || item_id || ':' || shot), 1, 12))::BIGINT AS h FROM benchmark, range(1, 4) AS r(shot))
    SELECT item_id, train_id, shot::INT AS shot FROM w JOIN t ON t.at = (shot - 1) * w.n // 3 + h % (shot * w.n // 3 - (shot - 1) * w.n // 3)""")
def lim_07(spark, d):
    tests = table(spark, d, "benchmark").select("item_id")
    return sampling.companions(tests, table(spark, d, "documents").select("doc_id"), 3, "item_id", "doc_id").select("item_id", "train_id", "shot")


@query("set_01_union", """
    SELECT doc_id::VARCHAR AS id, 'documents' AS dataset, lang AS subject_name FROM documents UNION ALL SELECT conv_id || '-' || turn, 'conversations', role FROM conversations""")
def set_01(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("documents").alias("dataset"), F.col("lang").alias("subject_name"), "text")
    conv = table(spark, d, "conversations").select(F.lit("conversations").alias("dataset"), F.col("role").alias("subject_name"), F.concat_ws("-", "conv_id", "turn").alias("id"))
    return O.union_tables([docs, conv], ["id", "dataset", "subject_name"])
