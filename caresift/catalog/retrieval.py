"""Classification and hybrid retrieval on the given tables.

Roles: ``embeddings`` joined with ``documents`` are the searchable records (label decides the source table), ``benchmark``
items are queries with the vector of the same number; user turns are questions to classify, and the longer words of
``benchmark`` are the terms of a knowledge base of five categories.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from caresift import constants as K
from caresift.catalog.registry import query, r6, sql_any, sql_map, sql_text, table, texts
from caresift.catalog.stem_sql import stems
from caresift.functions import text as X
from caresift.operators import classify as C
from caresift.operators import kb
from caresift.operators import retrieval as R
from caresift.operators.sizes import checked_broadcast
from caresift.sources import writers

#: Two numbers a row: so many labels are some 50 MB.
LABEL_ROWS = 2_000_000
CATS = ["heart_blood_vessels", "medications_drug_safety", "cancer", "infections", "eye_health"]
TABLES = ["medmcqa_records", "pubmedqa_records", "medquad_records"]
PUNCT = "'[^\\p{L}\\p{N}_\\s]'"


def _category(number):
    return F.element_at(F.array(*[F.lit(c) for c in CATS]), (F.pmod(number, F.lit(5)) + 1).cast("int"))


def _source_table(label):
    return F.when(label < 4, TABLES[0]).when(label < 7, TABLES[1]).otherwise(TABLES[2])


CAT_SQL = lambda n: "[" + ", ".join(sql_text(c) for c in CATS) + f"][({n}) % 5 + 1]"
TABLE_SQL = f"CASE WHEN label < 4 THEN '{TABLES[0]}' WHEN label < 7 THEN '{TABLES[1]}' ELSE '{TABLES[2]}' END"
WORDS_SQL = lambda c: f"list_filter(string_split_regex(regexp_replace(lower({c}), {PUNCT}, ' ', 'g'), '\\s+'), lambda x: x <> '')"
STOP_SQL = "[" + ", ".join(sql_text(w) for w in K.STOP_WORDS) + "]"

RECORDS_SQL = f"""rec AS (SELECT vec_id AS record_id, {TABLE_SQL} AS source_table, embedding::DOUBLE[] AS e, text, {CAT_SQL('label')} AS primary_category,
    CASE WHEN n_chars > 3000 THEN 'TIER_A' WHEN n_chars > 1000 THEN 'TIER_B' WHEN n_chars > 300 THEN 'TIER_C' ELSE 'TIER_D' END AS quality_tier
    FROM (SELECT doc_id AS vec_id, text, n_chars, embedding, coalesce(label, doc_id % 10) AS label FROM documents LEFT JOIN embeddings ON doc_id = vec_id))"""
SEM_SQL = f"""{RECORDS_SQL}, qs AS (SELECT item_id AS query_id, b.text, embedding::DOUBLE[] AS e FROM benchmark b LEFT JOIN embeddings ON vec_id = item_id),
  sim AS (SELECT query_id, source_table, record_id, greatest(0, least(1, round(list_cosine_similarity(qs.e, rec.e), 9))) AS score FROM qs, rec WHERE qs.e IS NOT NULL AND rec.e IS NOT NULL),
  sem0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_table ORDER BY score DESC, record_id) AS r FROM sim) WHERE r <= 20),
  sem AS (SELECT query_id, source_table, record_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_table, record_id) AS rank FROM sem0) WHERE rank <= 20)"""
LEX_SQL = f"""qw0 AS (SELECT query_id, unnest(ws) AS word FROM (SELECT item_id AS query_id, list_filter(list_distinct({WORDS_SQL('text')}), lambda x: NOT list_contains({STOP_SQL}, x)) AS ws FROM benchmark)),
  dw AS (SELECT source_table, record_id, len(ws) AS len, unnest(ws) AS word FROM (SELECT source_table, record_id, {WORDS_SQL('text')} AS ws FROM rec)),
  st AS (SELECT * FROM {stems('(SELECT word FROM qw0 UNION SELECT word FROM dw)')}),
  qw1 AS (SELECT DISTINCT query_id, stem FROM qw0 JOIN st USING (word)), qw AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS need FROM qw1),
  tf AS (SELECT source_table, record_id, len, stem, count(*) AS tf FROM dw JOIN st USING (word) WHERE NOT list_contains({STOP_SQL}, word) GROUP BY ALL),
  lex1 AS (SELECT query_id, source_table, record_id, round(least(1.0, sum(tf) / (1 + ln(len::DOUBLE))), 9) AS score FROM tf JOIN qw USING (stem) GROUP BY query_id, need, source_table, record_id, len HAVING count(*) = need),
  lex0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_table ORDER BY score DESC, record_id) AS r FROM lex1) WHERE r <= 20),
  lex AS (SELECT query_id, source_table, record_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_table, record_id) AS rank FROM lex0) WHERE rank <= 20)"""
FUSED_SQL = lambda k: f"""fz AS (SELECT query_id, source_table, record_id, coalesce(s.rank, 21) AS sem_rank, coalesce(l.rank, 21) AS lex_rank, coalesce(s.score, l.score) AS relevance_score,
    1.0 / (60 + coalesce(s.rank, 21)) + 1.0 / (60 + coalesce(l.rank, 21)) AS rrf_score FROM sem s FULL JOIN lex l USING (query_id, source_table, record_id)),
  fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, source_table, record_id) AS fused_rank FROM fz) WHERE fused_rank <= {k})"""  # noqa: E731


def records(spark, d, *vector):
    """``vector``: "embedding", if it is wanted too.  Without it the labels are broadcast, so that texts are not shuffled."""
    n = F.col("n_chars")
    docs = texts(spark, d, "documents", F.col("doc_id").alias("vec_id"), "text", "n_chars")
    vectors = table(spark, d, "embeddings").select("vec_id", "label", *vector)
    joined = docs.join(vectors if vector else checked_broadcast(vectors, LABEL_ROWS), "vec_id", "left").withColumn("label", F.coalesce("label", F.col("vec_id") % 10))
    return joined.select(
        _source_table(F.col("label")).alias("source_table"), F.col("vec_id").alias("record_id"), *vector, "text", _category(F.col("label")).alias("primary_category"),
        F.when(n > 3000, "TIER_A").when(n > 1000, "TIER_B").when(n > 300, "TIER_C").otherwise("TIER_D").alias("quality_tier"))


def asked(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(vectors, "query_id", "left")


def semantic(spark, d):
    vectors = table(spark, d, "embeddings").select(_source_table(F.col("label")).alias("source_table"), F.col("vec_id").alias("record_id"), "embedding")
    present = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"))
    return R.list_top(R.semantic_hits(vectors.join(present, "record_id", "left_semi"), asked(spark, d)))


def lexical(spark, d):
    return R.list_top(R.lexical_hits(records(spark, d).select("source_table", "record_id", "text"), asked(spark, d)))


def fused(spark, d, k=20):
    return R.fused(semantic(spark, d), lexical(spark, d), k)


def _long(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@query("jn_01_embeddings_with_records", f"WITH {RECORDS_SQL} SELECT source_table, record_id, primary_category, quality_tier, md5(text) AS text FROM rec WHERE e IS NOT NULL")
def jn_01(spark, d):
    docs = table(spark, d, "documents")
    n = F.col("n_chars")
    right = docs.select(F.col("doc_id").alias("source_id"), "text", F.when(n > 3000, "TIER_A").when(n > 1000, "TIER_B").when(n > 300, "TIER_C").otherwise("TIER_D").alias("quality_tier"))
    left = table(spark, d, "embeddings").select(_source_table(F.col("label")).alias("source_table"), F.col("vec_id").alias("source_id"), _category(F.col("label")).alias("primary_category"))
    return R.with_records(left, right, ("source_id",)).select("source_table", F.col("source_id").alias("record_id"), "primary_category", "quality_tier", F.md5("text").alias("text"))


@query("jn_02_not_yet_embedded", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_02(spark, d):
    return writers.absent(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("jn_03_lexical_search", f"WITH {SEM_SQL}, {LEX_SQL} SELECT query_id, source_table, record_id, rank, round(score, 6) AS score FROM lex")
def jn_03(spark, d):
    return _long(lexical(spark, d), "rank").withColumn("score", r6(F.col("score")))


@query("jn_03_indexed_search", f"WITH {SEM_SQL}, {LEX_SQL} SELECT query_id, source_table, record_id, round(score, 6) AS score FROM lex0")
def jn_03b(spark, d):
    index = R.build_postings(records(spark, d).select("source_table", "record_id", "text"))
    return R.search_postings(spark, index, asked(spark, d)).withColumn("score", r6(F.col("score")))


@query("jn_04_semantic_search", f"WITH {SEM_SQL} SELECT query_id, source_table, record_id, rank, round(score, 6) AS score FROM sem")
def jn_04(spark, d):
    return _long(semantic(spark, d), "rank").withColumn("score", r6(F.col("score")))


TERMS_SQL = f"""terms AS (SELECT DISTINCT {CAT_SQL('item_id')} AS category, word AS consumer_term FROM (SELECT item_id, unnest({WORDS_SQL('text')}) AS word FROM benchmark) WHERE length(word) >= 7),
  ph AS (SELECT consumer_term AS phrase, max(category) AS category FROM terms GROUP BY 1),
  q AS (SELECT conv_id * 100 + turn AS query_id, regexp_replace(lower(text), {PUNCT}, ' ', 'g') AS t, {WORDS_SQL('text')} AS ws FROM conversations WHERE role = 'user')"""


def terms(spark, d):
    words = table(spark, d, "benchmark").select(_category(F.col("item_id")).alias("category"), F.explode_outer(X.words(F.col("text"))).alias("consumer_term"))
    return words.where(F.length("consumer_term") >= 7).distinct()


def questions(spark, d):
    rows = table(spark, d, "conversations").where(F.col("role") == "user")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")


@query("jn_05_contained_phrases", f"WITH {TERMS_SQL} SELECT query_id, phrase, category FROM q JOIN ph ON contains(t, phrase)")
def jn_05(spark, d):
    return C.contained(questions(spark, d), X.normalized(F.col("text")), C.phrase_index(terms(spark, d)), "phrase").select("query_id", "phrase", "category")


@query("jn_05_many_phrases", f"""
    WITH ph AS (SELECT DISTINCT word AS phrase FROM (SELECT unnest({WORDS_SQL('text')}) AS word FROM documents) WHERE length(word) >= 5),
    q AS (SELECT item_id, regexp_replace(lower(text), {PUNCT}, ' ', 'g') AS t FROM benchmark)
    SELECT item_id, count(*)::BIGINT AS n, min(phrase) AS least, max(phrase) AS largest FROM q JOIN ph ON contains(t, phrase) GROUP BY 1""")
def jn_05_many(spark, d):
    words = texts(spark, d, "documents", "text").select(F.explode_outer(X.words(F.col("text"))).alias("phrase"))
    phrases = words.where(F.length("phrase") >= 5).distinct()
    found = C.contained(table(spark, d, "benchmark").select("item_id", "text"), X.normalized(F.col("text")), phrases, "phrase")
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("phrase").alias("least"), F.max("phrase").alias("largest"))


@query("cls_02_rules_of_any_number", f"""
    WITH r AS (SELECT item_id AS rule_idx, 'c' || (item_id % 7) AS category, unnest({WORDS_SQL('text')}) AS keyword FROM benchmark),
    k AS (SELECT keyword, min(rule_idx) AS rule_idx FROM r WHERE length(keyword) >= 6 GROUP BY 1),
    hit AS (SELECT doc_id, min(rule_idx) AS rule_idx FROM documents JOIN k ON contains(lower(text), keyword) GROUP BY 1)
    SELECT doc_id, 'c' || (rule_idx % 7) AS category FROM documents LEFT JOIN hit USING (doc_id)""")
def cls_02_many(spark, d):
    item = F.col("item_id")
    rules = table(spark, d, "benchmark").select(F.lit("words").alias("rule_set"), item.alias("rule_idx"), F.concat(F.lit("c"), item % 7).alias("category"), F.explode_outer(X.words(F.col("text"))).alias("keyword"))
    docs = texts(spark, d, "documents", "doc_id", "text")
    return C.first_rules(docs, F.lower("text"), rules.where(F.length("keyword") >= 6), "words").select("doc_id", "category")


KEYWORD_SQL = f"""{TERMS_SQL},
  p1 AS (SELECT query_id, category, count(*) AS s FROM q JOIN ph ON contains(t, phrase) GROUP BY 1, 2),
  p2 AS (SELECT query_id, category, s, rank() OVER (PARTITION BY query_id ORDER BY s DESC) AS r FROM p1),
  pw AS (SELECT query_id, min(category) AS category FROM p2 WHERE r = 1 GROUP BY 1 HAVING count(*) = 1),
  tk AS (SELECT token, category, count(*) AS weight FROM (SELECT category, consumer_term AS token FROM terms WHERE consumer_term NOT IN ({", ".join(sql_text(w) for w in K.QUERY_STOP_WORDS)})) GROUP BY 1, 2),
  t1 AS (SELECT query_id, category, sum(weight) AS s FROM (SELECT query_id, unnest(list_distinct(ws)) AS token FROM q) JOIN tk USING (token) GROUP BY 1, 2),
  t2 AS (SELECT query_id, category, s, rank() OVER (PARTITION BY query_id ORDER BY s DESC) AS r FROM t1),
  tw AS (SELECT query_id, min(category) AS category FROM t2 WHERE r = 1 GROUP BY 1 HAVING count(*) = 1),
  kw AS (SELECT query_id, coalesce(pw.category, tw.category) AS category FROM pw FULL JOIN tw USING (query_id))"""


@query("cls_09_keyword_category", f"WITH {KEYWORD_SQL} SELECT * FROM kw")
def cls_09(spark, d):
    return C.keyword_category(questions(spark, d), terms(spark, d))


CENTROID_SQL = """ce AS (SELECT label, list(m ORDER BY pos) AS c, min(n) AS n FROM (
    SELECT label, pos, avg(v) AS m, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1 HAVING min(n) >= 45)"""
NEAREST_SQL = f"""{CENTROID_SQL},
  nc AS (SELECT vec_id AS query_id, ce.label AS category, round(list_cosine_similarity(embedding::DOUBLE[], c), 9) AS cosine FROM embeddings, ce),
  nearest AS (SELECT query_id, category, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, category) AS r FROM nc) WHERE r = 1)"""


@query("ag_08_centroids", f"WITH {CENTROID_SQL} SELECT label AS category, n::BIGINT AS n, generate_subscripts(c, 1)::BIGINT - 1 AS pos, round(unnest(c), 6) AS v FROM ce")
def ag_08(spark, d):
    means = C.centroids(table(spark, d, "embeddings"), "label", min_rows=45)
    rows = means.select("category", "n", F.posexplode("centroid").alias("pos", "v"))
    return _long(rows, "n", "pos").withColumn("v", r6(F.col("v")))


@query("cls_10_nearest_centroid", f"WITH {NEAREST_SQL} SELECT query_id, category, round(cosine, 5) AS cosine FROM nearest WHERE cosine >= 0.2")
def cls_10(spark, d):
    e = table(spark, d, "embeddings")
    return C.nearest_centroid(e.withColumnRenamed("vec_id", "query_id"), C.centroids(e, "label", min_rows=45), threshold=0.2).withColumn("cosine", F.round("cosine", 5))


@query("cls_11_cascade", f"""
    WITH {KEYWORD_SQL}, {NEAREST_SQL}
    SELECT q.query_id, coalesce(kw.category, CASE WHEN cosine >= 0.2 THEN 'centroid_' || nearest.category END, CASE WHEN l.quality = 1 THEN 'cancer' END, 'public_health_prevention') AS category,
      CASE WHEN kw.category IS NOT NULL THEN 'keyword' WHEN cosine >= 0.2 THEN 'embedding' WHEN l.doc_id IS NOT NULL THEN 'llm' ELSE 'fallback' END AS method
    FROM q LEFT JOIN kw USING (query_id) LEFT JOIN nearest USING (query_id) LEFT JOIN labels l ON l.doc_id = q.query_id""")
def cls_11(spark, d):
    e = table(spark, d, "embeddings")
    asked_ = questions(spark, d)
    near = C.nearest_centroid(e.withColumnRenamed("vec_id", "query_id"), C.centroids(e, "label", min_rows=45), threshold=0.2)
    near = near.withColumn("category", F.concat(F.lit("centroid_"), F.col("category").cast("string")))
    model = table(spark, d, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("quality") == 1, "cancer").otherwise("nonsense").alias("category"))
    return C.cascade(asked_, C.keyword_category(asked_, terms(spark, d)), near, model).select("query_id", "category", "method")


@query("cls_12_match_conditions", """
    WITH reg AS (SELECT lower(p_name) AS entry, min(p_brand) AS category, min(p_type) AS subcategory FROM part GROUP BY 1),
    nm AS (SELECT p_partkey AS id, CASE WHEN p_size <= 20 THEN upper(p_name) WHEN p_size <= 35 THEN 'my ' || p_name || ' hurts' ELSE split_part(p_name, ' ', 2) END AS name FROM part),
    m AS (SELECT id, name, entry, category, subcategory, lower(name) = entry AS exact FROM nm JOIN reg ON lower(name) = entry OR contains(lower(name), entry) OR contains(entry, lower(name)))
    SELECT id, name, category, subcategory FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exact DESC, entry) AS r FROM m) WHERE r = 1""")
def cls_12(spark, d):
    part = table(spark, d, "part")
    registry = part.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_brand").alias("category"), F.min("p_type").alias("subcategory"))
    name = (F.when(F.col("p_size") <= 20, F.upper("p_name")).when(F.col("p_size") <= 35, F.concat(F.lit("my "), "p_name", F.lit(" hurts")))
            .otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))))
    return C.match_conditions(part.select(F.col("p_partkey").alias("id"), name.alias("name")), registry)


DRUGS = [("small", "heart_blood_vessels"), ("blue", "infections"), ("ring", "eye_health")]
FREE = [(["red", "blue"], "eye_health", "colour"), (["bolt", "ring"], "dental_oral", "metal"), (["green", "ring"], "eye_health", "colour")]


@query("cls_13_resolve", f"""
    SELECT p_partkey, CASE WHEN contains(p_name, 'small') THEN 'heart_blood_vessels' WHEN contains(p_name, 'blue') THEN 'infections' WHEN contains(p_name, 'ring') THEN 'eye_health' ELSE 'medications_drug_safety' END AS drug_category,
      r_name AS checklist FROM part JOIN region ON r_regionkey = p_size - 1""")
def cls_13(spark, d):
    checklist = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("key"), F.col("r_name").alias("checklist"))
    picks = table(spark, d, "part").withColumnRenamed("p_size", "key")
    return C.resolve_checklist(picks, checklist).select("p_partkey", C.medication_category(F.col("p_name"), DRUGS).alias("drug_category"), "checklist")


@query("cls_13_medications", """
    SELECT p_partkey, p_name AS name, CASE WHEN contains(p_name, 'small') THEN 'heart_blood_vessels' WHEN contains(p_name, 'blue') THEN 'infections' WHEN contains(p_name, 'ring') THEN 'eye_health' ELSE 'medications_drug_safety' END AS category
      FROM part WHERE p_size % 5 <> 0""")
def cls_13_medications(spark, d):
    name = F.when(F.col("p_size") % 10 == 0, None).when(F.col("p_size") % 5 == 0, " \t ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("\n")))
    return C.resolve_medications(table(spark, d, "part").select("p_partkey", name.alias("name")), "name", DRUGS)


@query("cls_13_freetext", """
    SELECT p_partkey, 'eye_health' AS category, 'colour' AS subcategory, CASE WHEN contains(p_name, 'red') THEN 'Red' WHEN contains(p_name, 'blue') THEN 'Blue' WHEN contains(p_name, 'green') THEN 'Green' ELSE 'Ring' END AS name
      FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'blue') OR contains(p_name, 'green') OR contains(p_name, 'ring')
    UNION ALL SELECT p_partkey, 'dental_oral', 'metal', CASE WHEN contains(p_name, 'bolt') THEN 'Bolt' ELSE 'Ring' END FROM part WHERE contains(p_name, 'bolt') OR contains(p_name, 'ring')""")
def cls_13b(spark, d):
    return C.freetext_conditions(table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_name"), FREE).select("p_partkey", "category", "subcategory", "name")


@query("jn_06_rank_fusion", f"WITH {SEM_SQL}, {LEX_SQL}, {FUSED_SQL(8)} SELECT query_id, source_table, record_id, sem_rank, lex_rank, round(relevance_score, 6) AS relevance_score, round(rrf_score, 6) AS rrf_score, fused_rank FROM fused")
def jn_06(spark, d):
    return _long(fused(spark, d, 8), "sem_rank", "lex_rank", "fused_rank").withColumns({"relevance_score": r6(F.col("relevance_score")), "rrf_score": r6(F.col("rrf_score"))})


HITS_SQL = f"""{SEM_SQL}, {LEX_SQL}, {FUSED_SQL(20)},
  plan AS (SELECT query_id, c AS primary_category, (query_id % 7 + length(c) % 3) / 10.0 AS weight, (query_id + length(c)) % 4 = 0 AS must FROM qs, (SELECT unnest([{", ".join(sql_text(c) for c in CATS)}]) AS c)),
  sc AS (SELECT f.*, r.primary_category, r.quality_tier, r.text AS chunk_text, rrf_score * (1 + 0.3 * weight) + CASE WHEN must THEN 0.1 ELSE 0 END AS final_score
    FROM fused f JOIN rec r USING (source_table, record_id) LEFT JOIN plan p ON p.query_id = f.query_id AND p.primary_category = r.primary_category),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, source_table, record_id) AS final_rank FROM sc) WHERE final_rank <= 8)"""


def hits(spark, d):
    rec = records(spark, d).select("source_table", "record_id", "primary_category", "quality_tier", F.col("text").alias("chunk_text"))
    plan = asked(spark, d).select("query_id", F.explode(F.array(*[F.lit(c) for c in CATS])).alias("category")).select(
        "query_id", "category", ((F.col("query_id") % 7 + F.length("category") % 3) / 10.0).alias("weight"),
        F.when((F.col("query_id") + F.length("category")) % 4 == 0, "must").alias("bucket"))
    return R.reranked(R.described(fused(spark, d, R.prefetch(8)), rec), plan, 8)


@query("lim_01_reranked_top_k", f"WITH {HITS_SQL} SELECT query_id, source_table, record_id, final_rank, round(final_score, 6) AS final_score FROM hits")
def lim_01(spark, d):
    return _long(hits(spark, d), "final_rank").select("query_id", "source_table", "record_id", "final_rank", r6(F.col("final_score")).alias("final_score"))


@query("flt_06_relevance_floor", f"""WITH {HITS_SQL}, m AS (SELECT query_id, max(relevance_score) AS m FROM hits GROUP BY 1)
    SELECT query_id, source_table, record_id FROM hits JOIN m USING (query_id) WHERE relevance_score >= 0.35 OR m < 0.35""")
def flt_06(spark, d):
    return R.relevant(hits(spark, d)).select("query_id", "source_table", "record_id")


@query("flt_08_allowed_tables", f"""WITH {SEM_SQL}, {LEX_SQL}, {FUSED_SQL(20)} SELECT query_id, source_table, record_id FROM fused
    WHERE query_id % 3 = 0 OR (query_id % 3 = 1 AND source_table = '{TABLES[0]}') OR query_id % 3 = 2""")
def flt_08(spark, d):
    wanted = asked(spark, d).select("query_id", F.when(F.col("query_id") % 3 == 1, F.array(F.lit(TABLES[0]), F.lit("other"))).when(F.col("query_id") % 3 == 2, F.array(F.lit("other"))).alias("tables"))
    return R.allowed_tables(fused(spark, d), wanted, TABLES).select("query_id", "source_table", "record_id")


@query("wn_01_ranked_lists", f"WITH {SEM_SQL} SELECT query_id, source_table, record_id, r AS rank FROM sem0")
def wn_01(spark, d):
    found = R.semantic_hits(records(spark, d, "embedding").select("source_table", "record_id", "embedding"), asked(spark, d))
    return _long(R.best_per_query(found, 20, ["query_id", "source_table"]), "rank").select("query_id", "source_table", "record_id", "rank")


@query("wn_02_top_n_per_table", """
    SELECT c_nationkey, c_mktsegment, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3) WHERE rank <= 5""")
def wn_02(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")
    per = R.best_per_query(rows, 3, ["c_nationkey", "c_mktsegment"], "c_acctbal", ("c_custkey",))
    return _long(R.best_per_query(per, 5, ["c_nationkey"], "c_acctbal", ("c_custkey",)), "rank").select("c_nationkey", "c_mktsegment", "c_custkey", "rank")


@query("wn_05_citations", f"""WITH {HITS_SQL} SELECT query_id, source_table, record_id, quality_tier, row_number() OVER (PARTITION BY query_id ORDER BY {sql_map('quality_tier', K.TIER_ORDER)}, relevance_score DESC, final_rank) AS citation FROM hits""")
def wn_05(spark, d):
    h = hits(spark, d).select("query_id", "source_table", "record_id", "quality_tier", "relevance_score", F.col("final_rank").alias("rank"))
    twice = h.unionByName(h.withColumn("rank", F.col("rank") + 100))
    return _long(R.citations(twice), "citation").select("query_id", "source_table", "record_id", "quality_tier", "citation")


def sql_confidence(src: str) -> str:
    tier = sql_map("quality_tier", K.TIER_WEIGHTS)
    weight = sql_map("source_table", K.SOURCE_WEIGHTS)
    return f"""h AS ({src}), mx AS (SELECT query_id, max(relevance_score) AS m FROM h GROUP BY 1),
  k AS (SELECT h.* FROM h JOIN mx USING (query_id) WHERE relevance_score >= 0.35 OR m < 0.35),
  a AS (SELECT query_id, avg(coalesce({tier}, 0.1)) AS t, least(1.0, avg(relevance_score * coalesce({weight}, 1.0))) AS r, count(*) AS n, count(DISTINCT source_table) AS u, bool_or({sql_any('lower(chunk_text)', K.NARROW_INDEX_DRUGS)}) AS drug FROM k GROUP BY 1),
  b AS (SELECT q.query_id, q.category, coalesce(n, 0) AS n_hits, coalesce(u, 0) AS n_tables, greatest(0, least(1, coalesce(0.5 * t + 0.5 * r, 0) + least(0.10, 0.05 * (coalesce(u, 0) - 1)))) AS c0, coalesce(drug, FALSE) AS drug FROM cq q LEFT JOIN a USING (query_id)),
  cf AS (SELECT *, CASE WHEN category = 'medications_drug_safety' AND n_tables < 2 THEN least(c0, 0.8) ELSE c0 END AS confidence FROM b)"""


@query("ag_38_confidence", f"""WITH cq AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'F' THEN 'medications_drug_safety' ELSE 'cancer' END AS category FROM orders),
    {sql_confidence(f'''SELECT l_orderkey AS query_id, CASE WHEN l_returnflag = 'R' THEN '{TABLES[0]}' WHEN l_returnflag = 'A' THEN '{TABLES[2]}' ELSE 'other' END AS source_table,
       CASE WHEN l_linenumber < 3 THEN 'TIER_A' WHEN l_linenumber < 5 THEN 'TIER_C' ELSE 'TIER_X' END AS quality_tier, l_discount * 10 AS relevance_score, CASE WHEN l_tax > 0.06 THEN 'On Warfarin' ELSE 'x' END AS chunk_text FROM lineitem''')}
    SELECT query_id, n_hits::BIGINT AS n_hits, n_tables::BIGINT AS n_tables, round(confidence + 1e-9, 5) AS confidence, category = 'medications_drug_safety' AND drug AS narrow_index FROM cf""")
def ag_38(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderstatus") == "F", K.MEDICATIONS).otherwise("cancer").alias("category"))
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    h = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.when(flag == "R", TABLES[0]).when(flag == "A", TABLES[2]).otherwise("other").alias("source_table"),
        F.when(line < 3, "TIER_A").when(line < 5, "TIER_C").otherwise("TIER_X").alias("quality_tier"), (F.col("l_discount") * 10).alias("relevance_score"),
        F.when(F.col("l_tax") > 0.06, "On Warfarin").otherwise("x").alias("chunk_text"))
    out = R.confidence(q, h)
    return _long(out, "n_hits", "n_tables").select("query_id", "n_hits", "n_tables", F.round(F.col("confidence") + 1e-9, 5).alias("confidence"), "narrow_index")


@query("cls_15_flags", """
    SELECT l_returnflag, count_if(l_discount * 10 < 0.55)::BIGINT AS uncertain, count_if(l_tax > 0.06)::BIGINT AS drug FROM lineitem GROUP BY 1""")
def cls_15(spark, d):
    from caresift.functions.weights import edge_of_unsure

    text = F.when(F.col("l_tax") > 0.06, "Taking LITHIUM daily").otherwise("rest")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(edge_of_unsure(F.col("l_discount") * 10)).alias("uncertain"), F.count_if(C.narrow_index_drug(text)).alias("drug"))


@query("answer_hybrid_confidence", f"""WITH {HITS_SQL}, cq AS (SELECT query_id, {CAT_SQL('query_id')} AS category FROM qs), {sql_confidence('SELECT query_id, source_table, quality_tier, relevance_score, chunk_text FROM hits')}
    SELECT query_id, category, n_hits::BIGINT AS n_hits, n_tables::BIGINT AS n_tables, round(confidence + 1e-9, 5) AS confidence FROM cf""")
def answer_hybrid(spark, d):
    q = asked(spark, d).select("query_id", _category(F.col("query_id")).alias("category"))
    out = R.confidence(q, hits(spark, d))
    return _long(out, "n_hits", "n_tables").select("query_id", "category", "n_hits", "n_tables", F.round(F.col("confidence") + 1e-9, 5).alias("confidence"))


@query("wn_07_budgeted_context", """
    WITH s AS (SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents WHERE length(text) > 0)
    SELECT source, doc_id, md5(substr(text, 1, (32000 - used)::INT)) AS text FROM s WHERE used < 32000""")
def wn_07(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", "text")
    return kb.budgeted(rows, "source", "doc_id", "text").select("source", "doc_id", F.md5("text").alias("text"))


@query("jn_19_knowledge_lookup", """
    SELECT p_partkey, r_name IS NOT NULL AS found, coalesce(lower(r_name) || ' rules', '') AS content, CASE WHEN r_name IS NULL THEN 'slug0, slug1, slug2, slug3, slug4' END AS known_slugs FROM part LEFT JOIN region ON p_size = r_regionkey""")
def jn_19(spark, d):
    docs = table(spark, d, "region").select(F.concat(F.lit("slug"), F.col("r_regionkey").cast("string")).alias("slug"), F.concat(F.lower("r_name"), F.lit(" rules")).alias("text"))
    wanted = table(spark, d, "part").select("p_partkey", F.concat(F.lit("slug"), F.col("p_size").cast("string")).alias("slug"))
    return kb.lookup(wanted, docs).select("p_partkey", "found", F.coalesce("content", F.lit("")).alias("content"), "known_slugs")


@query("wn_08_unique_winner", """
    WITH s AS (SELECT o_custkey AS query_id, o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY n DESC) AS k FROM s)
    SELECT query_id, min(category) AS category FROM r WHERE k = 1 GROUP BY 1 HAVING count(*) = 1""")
def wn_08(spark, d):
    return C.unique_winner(table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("category"), F.lit(1).alias("score")))
