"""Filters, projections and scalar functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caresift import constants as K
from caresift.catalog.registry import query, r6, sql_text, table, texts
from caresift.functions import answers as A
from caresift.functions import text as X
from caresift.functions import weights as W
from caresift.operators import turns

WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(8239)||chr(12288)"


@query("flt_01_filled_answers", f"""
    SELECT role, count(*)::BIGINT AS kept FROM conversations
    WHERE length(trim(coalesce(text, ''), {WS})) > 0 GROUP BY role""")
def flt_01(spark, d):
    return table(spark, d, "conversations").where(X.filled(F.col("text"))).groupBy("role").agg(F.count(F.lit(1)).alias("kept"))


@query("flt_02_has_explanation", f"""
    SELECT event_type, count_if(lower(trim(coalesce(e, ''), {WS})) NOT IN ('', 'null'))::BIGINT AS explained, count(*)::BIGINT AS n
    FROM (SELECT event_type, CASE WHEN value < 5 THEN NULL WHEN value < 10 THEN ' Null ' WHEN value < 15 THEN '  ' ELSE props END AS e FROM events)
    GROUP BY event_type""")
def flt_02(spark, d):
    v = F.col("value")
    e = F.when(v < 5, F.lit(None)).when(v < 10, " Null ").when(v < 15, "  ").otherwise(F.col("props"))
    rows = table(spark, d, "events").select("event_type", e.alias("e"))
    return rows.groupBy("event_type").agg(F.count_if(X.has_explanation(F.col("e"))).alias("explained"), F.count(F.lit(1)).alias("n"))


@query("flt_03_single_turn", """
    SELECT conv_id FROM conversations GROUP BY conv_id HAVING count_if(role = 'assistant') = 0""")
def flt_03(spark, d):
    return turns.single_turn(table(spark, d, "conversations"))


@query("flt_04_looks_english", f"""
    SELECT lang, count_if(ok)::BIGINT AS english, count(*)::BIGINT AS n FROM (
      SELECT lang, length(trim(text, {WS})) > 0
        AND (length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) = 0
             OR length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 0.85)
        AND list_has_any(regexp_extract_all(lower(text), '[a-z'']+'), [{", ".join(sql_text(w) for w in K.ENGLISH_WORDS)}]) AS ok
      FROM documents) GROUP BY lang""")
def flt_04(spark, d):
    rows = texts(spark, d, "documents", "lang", "text").select("lang", X.looks_english(F.col("text")).alias("ok"))
    return rows.groupBy("lang").agg(F.count_if("ok").alias("english"), F.count(F.lit(1)).alias("n"))


@query("flt_05_only_user_and_assistant", """
    SELECT conv_id FROM conversations GROUP BY conv_id HAVING count_if(role NOT IN ('user', 'assistant')) = 0""")
def flt_05(spark, d):
    return turns.only_roles(table(spark, d, "conversations"))


@query("prj_01_option_letter", """
    SELECT CASE WHEN l_linenumber = 0 THEN NULL WHEN l_linenumber BETWEEN 1 AND 4 THEN substr('abcd', l_linenumber, 1)
                ELSE l_linenumber::VARCHAR END AS letter, count(*)::BIGINT AS n
    FROM lineitem GROUP BY 1""")
def prj_01(spark, d):
    rows = table(spark, d, "lineitem").select(X.option_letter(F.col("l_linenumber")).alias("letter"))
    return rows.groupBy("letter").agg(F.count(F.lit(1)).alias("n"))


@query("prj_02_composite_key", "SELECT source || '::' || doc_id AS key, lang FROM documents")
def prj_02(spark, d):
    return table(spark, d, "documents").select(X.composite_key(F.col("source"), F.col("doc_id").cast("string")).alias("key"), "lang")


@query("prj_03_cuts", """
    SELECT doc_id, substr(text, 1, 200) AS question, length(substr(text, 1, 8000))::BIGINT AS embed_chars, md5(substr(text, 1, 400)) AS evidence
    FROM documents""")
def prj_03(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", X.cut(t, "question").alias("question"), F.length(X.cut(t, "embed")).cast("bigint").alias("embed_chars"), F.md5(X.cut(t, "evidence")).alias("evidence"))


@query("prj_04_chunk_text", """
    SELECT doc_id, md5('Question: ' || text || CASE WHEN quality = 1 THEN chr(10) || 'Answer: ' || lang ELSE '' END || chr(10) || 'Category: ' || source) AS chunk
    FROM documents LEFT JOIN labels USING (doc_id)""")
def prj_04(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    line = X.explained_answer_line(F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("lang"))
    return rows.select("doc_id", F.md5(X.chunk_text(F.col("text"), line, F.col("source"), limit=None)).alias("chunk"))


@query("prj_05_words", """
    SELECT w AS word, count(*)::BIGINT AS n FROM (
      SELECT unnest(string_split_regex(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+')) AS w FROM documents)
    WHERE w <> '' GROUP BY w""")
def prj_05(spark, d):
    return (texts(spark, d, "documents", "text").select(F.explode_outer(X.words(F.col("text"))).alias("word")).where(F.col("word").isNotNull())
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


@query("prj_06_phrase_tokens", f"""
    SELECT token, p_type AS category, count(*)::BIGINT AS weight FROM (
      SELECT p_type, trim(unnest(string_split_regex(lower(p_name || ' (' || p_brand || ')'), '[\\s/\\-,]+')), '()[].''"') AS token FROM part)
    WHERE length(token) >= 4 AND token NOT IN ({", ".join(sql_text(w) for w in K.QUERY_STOP_WORDS)}) GROUP BY 1, 2""")
def prj_06(spark, d):
    from caresift.operators.classify import token_index

    terms = table(spark, d, "part").select(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("consumer_term"), F.col("p_type").alias("category"))
    return token_index(terms)


@query("prj_07_slugify", """
    SELECT DISTINCT p_name || ' & ' || p_brand || ' / ' || p_type || ' (x, y)' AS name,
      trim(regexp_replace(replace(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(p_name || ' & ' || p_brand || ' / ' || p_type || ' (x, y)'), '&', 'and'),
        '[/(),]', ' ', 'g'), '[^a-z0-9\\s]', '', 'g')), '\\s+', '_', 'g'), '_and_', '_'), '_+', '_', 'g'), '_') AS slug
    FROM part""")
def prj_07(spark, d):
    name = F.concat_ws("", "p_name", F.lit(" & "), "p_brand", F.lit(" / "), "p_type", F.lit(" (x, y)"))
    return table(spark, d, "part").select(name.alias("name")).distinct().withColumn("slug", X.slugify(F.col("name")))


@query("prj_08_lenient_json", """
    SELECT event_type, sum(CASE WHEN event_type = 'error' THEN NULL ELSE (props->>'$.k')::BIGINT END)::BIGINT AS k,
      count_if(event_type = 'error')::BIGINT AS unparsed FROM events GROUP BY event_type""")
def prj_08(spark, d):
    p = F.col("props")
    reply = (F.when(F.col("event_type") == "click", F.concat(F.lit("Sure!\n```json\n"), p, F.lit("\n```\nDone.")))
             .when(F.col("event_type") == "view", F.concat(F.lit("The answer is "), p, F.lit(" as asked.")))
             .when(F.col("event_type") == "error", F.concat(F.lit("no object in "), F.translate(p, "{}", "")))
             .otherwise(p))
    rows = table(spark, d, "events").select("event_type", X.lenient_json(reply, "k bigint").alias("j"))
    return rows.groupBy("event_type").agg(F.sum("j.k").alias("k"), F.count_if(F.col("j").isNull()).alias("unparsed"))


@query("prj_09_tag_labels", """
    SELECT tag, CASE WHEN contains(tag, ':') THEN split_part(tag, ':', 1) ELSE '' END AS prefix,
      upper(substr(s, 1, 1)) || substr(s, 2) AS label, n
    FROM (SELECT tag, lower(translate(CASE WHEN contains(tag, ':') THEN substr(tag, position(':' IN tag) + 1) ELSE tag END, '_-', '  ')) AS s, count(*)::BIGINT AS n
          FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'theme:' ELSE '' END || lower(l_returnflag) || '_LINE-' || l_linenumber AS tag FROM lineitem) GROUP BY tag)""")
def prj_09(spark, d):
    tag = F.concat(F.when(F.col("l_linestatus") == "O", "theme:").otherwise(""), F.lower("l_returnflag"), F.lit("_LINE-"), F.col("l_linenumber").cast("string"))
    rows = table(spark, d, "lineitem").select(tag.alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("tag", X.tag_prefix(F.col("tag")).alias("prefix"), X.tag_label(F.col("tag")).alias("label"), "n")


@query("prj_10_last_user_text", """
    SELECT conv_id, md5(arg_max(text, turn)) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def prj_10(spark, d):
    return turns.last_user_text(table(spark, d, "conversations")).select("conv_id", F.md5("query").alias("query"))


def _letters(spark, d):
    # a response text per order: prose with an answer letter in it
    letter = F.substring(F.lit("ABCDE"), F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(1))
    return table(spark, d, "orders").withColumn(
        "response", F.concat(F.lit("Considering "), "o_orderpriority", F.lit(".\nanswer "), F.lit(": $"), letter, F.lit("$ because "), F.col("o_totalprice").cast("string")))


@query("prj_11_choice_letter", """
    SELECT o_orderkey, nullif(regexp_extract('Considering ' || o_orderpriority || '.' || chr(10) || 'answer : $' || substr('ABCDE', substr(o_orderpriority, 1, 1)::INT, 1)
      || '$ because ' || o_totalprice, '(?i)Answer[ \\t]*:[ \\t]*\\$?([A-D])\\$?', 1), '') AS letter FROM orders""")
def prj_11(spark, d):
    return _letters(spark, d).select("o_orderkey", A.choice_letter(F.col("response")).alias("letter"))


@query("prj_12_multilingual_letter", """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'A' WHEN 'fr' THEN 'B' WHEN 'de' THEN 'C' ELSE 'D' END AS letter FROM documents""")
def prj_12(spark, d):
    line = (F.when(F.col("lang") == "en", "**Answer:** $\\boxed{A}$").when(F.col("lang") == "fr", "Réponse : B")
            .when(F.col("lang") == "de", "Antwort: **C**").otherwise("الإجابة: د"))
    cleaned = texts(spark, d, "documents", "doc_id", "text", "lang").withColumn("response", A.without_markup(F.concat_ws("\n", "text", line)))
    return cleaned.select("doc_id", A.multilingual_letter(F.col("response")).alias("letter"))


@query("prj_13_answer_line", """
    SELECT o_orderkey, 'worth ' || o_orderpriority AS answer FROM orders""")
def prj_13(spark, d):
    response = F.concat(F.lit("Step 1.\nANSWER :  worth "), "o_orderpriority", F.lit("\nThanks"))
    return table(spark, d, "orders").select("o_orderkey", A.answer_line(response).alias("answer"))


@query("prj_14_number_answer", """
    SELECT p_partkey, p_size::VARCHAR || '.50' AS number, p_size % 2 = 0 AS hit FROM part""")
def prj_14(spark, d):
    size = F.col("p_size").cast("string")
    response = F.concat(F.lit("Answer: 7 apples. Answer: 1,000 minus 3 is "), size, F.lit(".50."))
    number = A.number_answer(response, F.lit("Answer"))
    target = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(".5"))).otherwise(F.lit("0"))
    return table(spark, d, "part").select("p_partkey", number.alias("number"), A.same_number(target, number).alias("hit"))


@query("prj_15_span_scores", """
    WITH t AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS p, p_name AS pt, list_distinct(list_filter(string_split(lower(p_type || ' ' || split_part(p_name, ' ', 1)), ' '), lambda x: x <> '')) AS g1,
                 lower(p_type || ' ' || split_part(p_name, ' ', 1)) AS g1t, list_distinct(string_split('blue ' || split_part(p_name, ' ', 2), ' ')) AS g2, 'blue ' || split_part(p_name, ' ', 2) AS g2t FROM part),
    f AS (SELECT p_partkey, pt, g1t, g2t, len(list_intersect(p, g1)) / len(p) AS p1, len(list_intersect(p, g1)) / len(g1) AS r1,
                 len(list_intersect(p, g2)) / len(p) AS p2, len(list_intersect(p, g2)) / len(g2) AS r2 FROM t)
    SELECT p_partkey, CASE WHEN pt = g1t OR pt = g2t THEN 1.0 ELSE 0.0 END::DOUBLE AS em,
      greatest(round(CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END * 100, 2), round(CASE WHEN p2 + r2 = 0 THEN 0 ELSE 2 * p2 * r2 / (p2 + r2) END * 100, 2)) AS f1,
      contains(pt, split_part(pt, ' ', 2)) AS fuzzy FROM f""")
def prj_15(spark, d):
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    refs = F.array(F.concat(F.lit("The "), "p_type", F.lit("-"), first, F.lit("!")), F.concat(F.lit("blue  "), second), F.lit(" "))
    best = A.best_span(F.col("p_name"), refs)
    return table(spark, d, "part").select("p_partkey", best["em"].alias("em"), best["f1"].alias("f1"), A.fuzzy_match(F.col("p_name"), F.concat(F.lit("the "), second)).alias("fuzzy"))


@query("prj_16_result_id", "SELECT sha256(o_orderkey || o_orderpriority) AS id, o_custkey FROM orders")
def prj_16(spark, d):
    return table(spark, d, "orders").select(X.result_id(F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("id"), "o_custkey")


@query("prj_17_retrieval_items", """
    SELECT doc_id, 'PMID ' || doc_id AS source, lang || ' paper' AS content, 1.0::DOUBLE AS relevance_score FROM documents WHERE source NOT IN ('src1', 'src2')
    UNION ALL SELECT doc_id, 'PMID 77', source, 1.0 FROM documents WHERE source NOT IN ('src1', 'src2')
    UNION ALL SELECT doc_id, 'openfda', lang, 1.0 FROM documents WHERE source = 'src1'""")
def prj_17(spark, d):
    tool = F.when(F.col("source") == "src1", "drug_interaction_db").otherwise("pubmed_search")
    found = F.format_string("Results:\n- PMID %d: %s paper\n- PMID 77: %s\nend", "doc_id", "lang", "source")
    result = F.when(F.col("source") == "src1", F.col("lang")).when(F.col("source") == "src2", F.concat(F.lit("Error: "), found)).otherwise(found)
    items = table(spark, d, "documents").select("doc_id", F.explode(X.retrieval_items(tool, result)).alias("i"))
    return items.select("doc_id", "i.*")


@query("prj_18_trace", """
    WITH t AS (SELECT doc_id, text, lang, source, n_chars, lang = 'en' AS found, chr(39) AS q FROM documents),
    r AS (SELECT doc_id, unnest(list_filter(['Agent A: classified query as ' || q || lang || q || ' using keyword method',
        CASE WHEN lang = 'fr' THEN 'Agent A: normalized terms -> ' || lang || ', ' || source ELSE 'Agent A: no term normalization applied' END,
        'Agent B: retrieval plan built — must_load=[' || q || source || q || '], may_load=[]',
        CASE WHEN found THEN 'Agent C: hybrid search (pgvector + FTS, RRF fusion) returned 1 results from ' || source ELSE 'Agent C: hybrid search (pgvector + FTS, RRF fusion) returned 0 results' END,
        'Agent D: confidence=0.50 — disclaimer=' || CASE WHEN n_chars > 1000 THEN 'applied' ELSE 'none' END,
        CASE WHEN lang = 'de' THEN 'Agent D: uncertainty flags -> [UNCERTAINTY FLAG]' END], lambda x: x IS NOT NULL)) AS line, md5(CASE WHEN found THEN text ELSE '' END) AS content FROM t)
    SELECT doc_id, line, content FROM r""")
def prj_18(spark, d):
    from caresift.operators.providers import trace_of, trace_or_default

    lang = F.col("lang")
    hit = F.array(F.struct(F.col("source").alias("source_table"), F.col("text").alias("chunk_text"), F.lit(0.5).alias("relevance_score")))
    hits = F.when(lang == "en", hit).otherwise(F.filter(hit, lambda _: F.lit(False)))
    none = F.lit(None).cast("array<string>")
    trace = trace_of(
        F.col("text"), lang, F.lit("keyword"), F.when(lang == "fr", F.array("lang", "source")), F.array("source"), none, F.lit(None).cast("string"), hits, F.lit(0.5),
        F.when(F.col("n_chars") > 1000, "notice"), F.when(lang == "de", F.array(F.lit("[UNCERTAINTY FLAG]"))), hits, F.lit(None).cast("string"), 500)
    rows = table(spark, d, "documents").select("doc_id", trace_or_default(trace, F.col("text")).alias("t"))
    content = F.coalesce(F.get("t.retrieval_results", F.lit(0))["content"], F.lit(""))
    return rows.select("doc_id", F.md5(content).alias("content"), F.explode_outer("t.reasoning_trace").alias("line"))


@query("prj_19_usage", """
    SELECT l_returnflag, sum(l_partkey)::BIGINT AS input_tokens, sum(l_suppkey)::BIGINT AS output_tokens, count(*) FILTER (l_linestatus = 'O')::BIGINT AS with_total
    FROM lineitem GROUP BY l_returnflag""")
def prj_19(spark, d):
    new = F.col("l_linestatus") == "O"
    u = F.struct(F.when(new, F.col("l_partkey")).alias("input_tokens"), F.when(~new, F.col("l_partkey")).alias("prompt_tokens"),
                 F.when(new, F.col("l_suppkey")).alias("output_tokens"), F.when(~new, F.col("l_suppkey")).alias("completion_tokens"),
                 F.when(new, F.col("l_partkey") + F.col("l_suppkey")).alias("total_tokens"))
    rows = table(spark, d, "lineitem").select("l_returnflag", X.usage(u).alias("u"))
    return rows.groupBy("l_returnflag").agg(F.sum("u.input_tokens").alias("input_tokens"), F.sum("u.output_tokens").alias("output_tokens"), F.count("u.total_tokens").alias("with_total"))


@query("prj_20_shuffled_options", """
    WITH o AS (SELECT p_partkey, p_type, unnest([0, 1, 2, 3]) AS i, unnest([p_type, p_brand, p_name, p_size::VARCHAR]) AS option FROM part),
    s AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY md5('7:' || p_partkey || ':' || i), i) AS place FROM o)
    SELECT p_partkey, p_type, string_agg(option, '|' ORDER BY place) AS options, substr('ABCD', max(CASE WHEN i = 0 THEN place END)::INT, 1) AS letter FROM s GROUP BY ALL""")
def prj_20(spark, d):
    options = F.array("p_type", "p_brand", "p_name", F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", "p_type", X.shuffled_options(F.col("p_partkey"), options, 7).alias("o"))
    return rows.select("p_partkey", "p_type", F.array_join(F.transform("o", lambda s: s["option"]), "|").alias("options"), X.correct_letter(F.col("o")).alias("letter"))


@query("prj_21_split_rubrics", """
    SELECT l_orderkey, l_linenumber, (l_quantity >= 25)::BIGINT + (l_tax >= 0.04)::BIGINT AS n_positive,
      2 - ((l_quantity >= 25)::BIGINT + (l_tax >= 0.04)::BIGINT) AS n_negative,
      round(greatest(l_quantity - 25, 0) + greatest(l_tax - 0.04, 0), 6) AS total_possible FROM lineitem""")
def prj_21(spark, d):
    rubrics = F.array(F.struct((F.col("l_quantity") - 25).alias("points")), F.struct((F.col("l_tax") - 0.04).alias("points")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.split_rubrics(rubrics).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", F.size("s.positive").cast("bigint").alias("n_positive"), F.size("s.negative").cast("bigint").alias("n_negative"), r6(F.col("s.total_possible")).alias("total_possible"))


@query("prj_22_count_weight", """
    WITH c AS (SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY 1, 2)
    SELECT c_nationkey, c_mktsegment, n, round(0.1 + least(1, log10(n + 1) / log10(101)) * (0.85 - 0.1), 6) AS strong,
      round(0.1 + least(1, log10(n + 1) / log10(101)) * (0.35 - 0.1), 6) AS weak FROM c""")
def prj_22(spark, d):
    counts = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("*", r6(W.count_weight(F.col("n"), K.STRONG_MAX)).alias("strong"), r6(W.count_weight(F.col("n"), K.WEAK_MAX)).alias("weak"))


@query("prj_23_soft_cap", """
    SELECT s_suppkey, round(CASE WHEN s_acctbal <= 0 THEN 0 ELSE 0.4 * (1 - exp(-(s_acctbal / 10000) / 0.4)) END, 6) AS capped FROM supplier""")
def prj_23(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", r6(W.soft_cap(F.col("s_acctbal") / 10000)).alias("capped"))


HISTORY_SQL = """SELECT user_id, event_type, count(*) AS cnt, max(ts) AS last FROM events GROUP BY 1, 2"""


@query("prj_24_history_boost", f"""
    SELECT user_id, event_type, round(least(cnt * 0.02 * pow(0.5, ((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(last)) / 86400000000.0) / 90), 0.15), 6) AS boost
    FROM ({HISTORY_SQL})""")
def prj_24(spark, d):
    history = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("cnt"), F.max(F.col("ts").cast("timestamp")).alias("last"))
    days = (F.unix_micros(F.lit("2024-03-01").cast("timestamp")) - F.unix_micros("last")) / 86_400_000_000
    return history.select("user_id", "event_type", r6(W.history_boost(F.col("cnt"), days)).alias("boost"))


@query("prj_25_effective_weight", """
    SELECT l_orderkey, round(least(0.1 + 0.4 * (1 - exp(-sum(l_discount) / 0.4)) + least(count(*) * 0.02, 0.15), 1), 6) AS weight
    FROM lineitem GROUP BY l_orderkey HAVING sum(l_discount) > 0""")
def prj_25(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_discount").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("b") > 0)
    return sums.select("l_orderkey", r6(W.effective_weight(F.lit(0.1), F.col("b"), W.history_boost(F.col("n"), F.lit(0.0)))).alias("weight"))


@query("prj_26_guarded_adjustment", """
    SELECT l_orderkey, l_linenumber, round(greatest(0.05, least(0.95, l_tax * 10 + greatest(-0.2, least(l_discount * 10 - l_tax * 10, 0.3)))), 3) AS weight FROM lineitem""")
def prj_26(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(W.guarded_adjustment(F.col("l_tax") * 10, F.col("l_discount") * 10), 3).alias("weight"))


@query("prj_27_graph_rerank", """
    SELECT l_orderkey, l_linenumber, round(1.0 / (60 + l_linenumber) * (1 + l_tax * 0.3) + CASE WHEN l_returnflag = 'R' THEN 0.1 ELSE 0 END, 6) AS score FROM lineitem""")
def prj_27(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(W.graph_rerank(1.0 / (60 + F.col("l_linenumber")), F.col("l_tax"), F.col("l_returnflag") == "R")).alias("score"))


@query("prj_28_disclaimer", f"""
    SELECT band, hedged, count(*)::BIGINT AS n FROM (
      SELECT CASE WHEN c >= 0.8 THEN NULL WHEN c >= 0.6 THEN {sql_text(K.DISCLAIMER_HIGH)} WHEN c >= 0.45 THEN {sql_text(K.DISCLAIMER_MEDIUM)} ELSE {sql_text(K.DISCLAIMER_LOW)} END AS band,
        c >= 0.55 AND c < 0.8 AS hedged FROM (SELECT o_totalprice / 500000 AS c FROM orders)) GROUP BY 1, 2""")
def prj_28(spark, d):
    c = F.col("o_totalprice") / 500000
    rows = table(spark, d, "orders").select(W.disclaimer(c).alias("band"), (W.hedged(F.lit("x"), c) != "x").alias("hedged"))
    return rows.groupBy("band", "hedged").agg(F.count(F.lit(1)).alias("n"))


@query("prj_29_clip", "SELECT event_id, round(greatest(0, least(1, value / 50 - 0.2)), 6) AS v FROM events")
def prj_29(spark, d):
    return table(spark, d, "events").select("event_id", r6(X.clip01(F.col("value") / 50 - 0.2)).alias("v"))


@query("set_05_appended_terms", """
    SELECT item_id, array_to_string(list_concat(w, list_filter(e, lambda x: NOT list_contains(w, x))), ' ') AS terms FROM (
      SELECT item_id, ['the', 'report'] AS w, ['report', 'item' || item_id] AS e FROM benchmark)""")
def set_05(spark, d):
    known = F.array(F.lit("the"), F.lit("report"))
    new = F.array(F.lit("report"), F.concat(F.lit("item"), F.col("item_id").cast("string")))
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.appended_terms(known, new), " ").alias("terms"))
