"""Streams over the given tables and batch calls to providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from caresift.catalog.registry import query, table
from caresift.catalog.scans import fresh
from caresift.operators import providers
from caresift.streaming import state, windows

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, d):
    return state.file_stream(spark, d, EVENTS, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_01_incremental_embedding", "SELECT 'documents' AS source_table, doc_id::VARCHAR AS source_id, 'hashed' AS model FROM documents")
def str_01(spark, d):
    target = fresh(spark, "embedded")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    chunks = state.file_stream(spark, d, schema, "documents.parquet").select(
        F.lit("documents").alias("source_table"), F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("chunk_text"))
    embedder = providers.hashed_words(32)
    # half of the table is there before the stream starts
    known = table(spark, d, "labels").select(F.lit("documents").alias("source_table"), F.col("doc_id").cast("string").alias("source_id"), F.lit("known").alias("chunk_text"))
    state.embed_missing(known, embedder, "hashed", target)
    state.embed_new(chunks, embedder, "hashed", target, fresh(spark, "ck"))
    return spark.read.parquet(target).select("source_table", "source_id", "model")


def facts(spark, d):
    k = F.from_json("props", "k int")["k"]
    return events(spark, d).select(
        F.col("user_id").cast("string").alias("user_id"), "event_id", "ts", F.when(F.col("value") > 60, "update").otherwise("add").alias("op"),
        F.concat_ws(" ", "event_type", F.floor(k / 20).cast("string")).alias("fact"), F.concat_ws(" ", "event_type", F.lit("0")).alias("old_fact"), F.col("event_type").alias("category"))


@query("str_02_user_memory")
def str_02(spark, d):
    path = fresh(spark, "memory")
    state.remember(facts(spark, d), path, fresh(spark, "ck"))
    kept, graduated = state.remembered(spark, path)
    columns = ["user_id", "fact", "category", "mentions", "first_seen", "last_seen"]
    return kept.select(*columns, F.lit("kept").alias("kind")).unionByName(graduated.select(*columns, F.lit("graduated").alias("kind")))


@query("str_03_query_history", """
    SELECT user_id, event_type AS src, 'k' || (props->>'$.k') AS dst, count(*)::BIGINT AS cnt, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_used FROM events GROUP BY 1, 2, 3""")
def str_03(spark, d):
    path = fresh(spark, "history")
    nodes = F.array("event_type", F.concat(F.lit("k"), F.from_json("props", "k int")["k"].cast("string")))
    state.keep_history(state.history_increments(events(spark, d).select("user_id", nodes.alias("nodes"), "ts")), path, fresh(spark, "ck"))
    return state.latest(spark, path, ["user_id", "src", "dst"]).withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("str_06_pattern_tracker", """
    WITH c AS (SELECT event_type || (props->>'$.k') AS tag, count(*)::BIGINT AS cnt FROM events GROUP BY 1) SELECT tag, cnt, cnt >= 20 AS graduated FROM c""")
def str_06(spark, d):
    path, done = fresh(spark, "patterns"), fresh(spark, "graduated")
    tag = F.concat("event_type", F.from_json("props", "k int")["k"].cast("string"))
    state.track_patterns(events(spark, d).select(tag.alias("tag"), "ts"), path, done, fresh(spark, "ck"), ready_at=20)
    counts = state.latest(spark, path, ["tag"])
    graduated = spark.read.parquet(done).select("tag", F.lit(True).alias("g"))
    return counts.join(graduated, "tag", "left").select("tag", "cnt", F.coalesce("g", F.lit(False)).alias("graduated"))


@query("udf_01_embedded_chunks", "SELECT doc_id::VARCHAR AS source_id, 16::BIGINT AS dim FROM documents")
def udf_01(spark, d):
    chunks = table(spark, d, "documents").select(F.lit("documents").alias("source_table"), F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("chunk_text"))
    out = providers.embed_chunks(chunks, providers.hashed_words(16), "hashed")
    return out.select("source_id", F.size("embedding").cast("bigint").alias("dim"))


def _judge(texts):
    return [("```json\n{\"score\": %d, \"explanation\": \"ok\"}\n```" % len(t)) if not t.startswith("Q error") else "no idea" for t in texts]


@query("udf_02_model_grades", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE length('Q ' || event_type || ' ' || props) END::DOUBLE AS score FROM events""")
def udf_02(spark, d):
    asked = table(spark, d, "events").select("event_id", F.concat_ws(" ", F.lit("Q"), "event_type", "props").alias("prompt"))
    from caresift.functions.text import grade_from_text

    return providers.ask_model(asked, _judge).select("event_id", grade_from_text(F.col("response"))["score"].alias("score"))


@query("udf_02_inferred_comorbidity", """
    SELECT DISTINCT least(c_mktsegment, n_name) AS a, greatest(c_mktsegment, n_name) AS b, 'cancer' AS category, 0.2::DOUBLE AS boost FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def udf_02b(spark, d):
    reply = F.lit('```json\n[{"category": "cancer", "score": 0.5, "reasoning": "r"}, {"category": "unknown", "score": 0.1}]\n```')
    pairs = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    swapped = F.col("c_custkey") % 2 == 0
    pairs = pairs.select(F.when(swapped, F.col("c_mktsegment")).otherwise(F.col("n_name")).alias("condition_a"), F.when(swapped, F.col("n_name")).otherwise(F.col("c_mktsegment")).alias("condition_b"), reply.alias("response"))
    return providers.inferred_comorbidity(pairs, ["cancer", "infections"]).select("a", "b", "category", "boost")


@query("udf_03_prompt_columns", """
    SELECT c_custkey, 'Age: ' || (c_custkey % 90) || chr(10) || 'Active conditions: ' || c_mktsegment AS profile, '[1] [TIER_A] (medquad_records): ' || c_name AS evidence FROM customer WHERE c_custkey % 90 > 0
    UNION ALL SELECT c_custkey, 'Active conditions: ' || c_mktsegment, '[1] [TIER_A] (medquad_records): ' || c_name FROM customer WHERE c_custkey % 90 = 0""")
def udf_03(spark, d):
    none = F.filter(F.array(F.struct(F.lit("x").alias("name"))), lambda _: F.lit(False))
    hit = F.array(F.struct(F.lit("TIER_A").alias("quality_tier"), F.lit("medquad_records").alias("source_table"), F.col("c_name").alias("chunk_text")))
    lines = providers.profile_lines((F.col("c_custkey") % 90), F.lit("prefer_not_to_say"), F.array(F.struct(F.col("c_mktsegment").alias("name"))), none, 10)
    return table(spark, d, "customer").select("c_custkey", lines.alias("profile"), providers.evidence_block(hit, 400).alias("evidence"))


@query("udf_04_responses", "SELECT d.doc_id, quality::BIGINT AS response FROM documents d LEFT JOIN labels l USING (doc_id)")
def udf_04(spark, d):
    responses = table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("response"))
    return providers.responses_joined(table(spark, d, "documents").select("doc_id"), responses, "doc_id")


@query("wn_06_strongest_facts", """
    WITH f AS (SELECT user_id, event_type || ' ' || (props->>'$.k') AS fact, count(*) AS mentions, min(ts)::DATE AS first_seen FROM events GROUP BY 1, 2)
    SELECT user_id, fact, mentions::BIGINT AS mentions FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mentions DESC, first_seen DESC, fact) AS r FROM f) WHERE r <= 20""")
def wn_06(spark, d):
    fact = F.concat_ws(" ", "event_type", F.from_json("props", "k int")["k"].cast("string"))
    seen = table(spark, d, "events").groupBy("user_id", fact.alias("fact")).agg(F.count(F.lit(1)).alias("mentions"), F.min(F.col("ts").cast("date")).alias("first_seen"))
    return state.strongest_facts(seen).select("user_id", "fact", "mentions")


@query("ag_45_embedding_summary", "SELECT source AS source_table, count(*)::BIGINT AS chunks, count(l.doc_id)::BIGINT AS embedded, (count(*) - count(l.doc_id))::BIGINT AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def ag_45b(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("source_table"), F.col("doc_id").alias("source_id"))
    done = docs.join(table(spark, d, "labels").select(F.col("doc_id").alias("source_id")), "source_id", "left_semi")
    return providers.embedding_summary(docs, done)


def _closed(spark, d, result, name):
    path = fresh(spark, name)
    windows.write_closed(result, path, fresh(spark, "ck"))
    return windows.closed(spark, path, result.schema)


def _day(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _measures():
    return [F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"), F.count_if(F.col("value") > 50).alias("n_over_50")]


# A stream closes what ends no later than its watermark, which counts in milliseconds.
WATERMARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)"


def _windows_sql(starts, length):
    return f"""
    WITH w AS (SELECT event_type, value, {starts} AS s FROM events WHERE ts IS NOT NULL)
    SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(s + {length}, '%Y-%m-%d %H:%M:%S.%f') AS window_end,
           count(*)::BIGINT AS n, max(value) AS highest, count(*) FILTER (value > 50)::BIGINT AS n_over_50
    FROM w WHERE s + {length} <= {WATERMARK} GROUP BY event_type, s"""


@query("str_07_tumbling_windows", _windows_sql("time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')", "INTERVAL 6 HOUR"))
def str_07_tumbling(spark, d):
    out = _closed(spark, d, windows.activity_windows(events(spark, d), ["event_type"], _measures(), "6 hours"), "tumbling")
    return out.select("event_type", _day("window_start"), _day("window_end"), "n", "highest", "n_over_50")


@query("str_07_sliding_windows", _windows_sql("unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR FOR k IN [0, 1, 2, 3]])", "INTERVAL 24 HOUR"))
def str_07_sliding(spark, d):
    out = _closed(spark, d, windows.activity_windows(events(spark, d), ["event_type"], _measures(), "24 hours", "6 hours"), "sliding")
    return out.select("event_type", _day("window_start"), _day("window_end"), "n", "highest", "n_over_50")


@query("str_07_sessions", f"""
    WITH g AS (SELECT user_id, ts, value, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events WHERE ts IS NOT NULL),
    s AS (SELECT *, sum(CASE WHEN since <= INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_end,
           count(*)::BIGINT AS n, max(value) AS highest, count(*) FILTER (value > 50)::BIGINT AS n_over_50
    FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {WATERMARK}""")
def str_07_sessions(spark, d):
    out = _closed(spark, d, windows.activity_sessions(events(spark, d), ["user_id"], _measures(), "6 hours"), "sessions")
    return out.select("user_id", _day("window_start"), _day("window_end"), "n", "highest", "n_over_50")


@query("str_07_distinct_events", "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events")
def str_07_distinct(spark, d):
    """The log arrives twice; each event counts once."""
    twice = events(spark, d).select(F.explode(F.array(F.lit(0), F.lit(1))), "*").drop("col")
    out = _closed(spark, d, windows.distinct_events(twice, ["event_id"]), "distinct")
    return out.select("event_id", "user_id", "event_type", _day("ts"))
