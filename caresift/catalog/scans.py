"""Sources and sinks on the given tables: each writes a table in the format of a source and reads it back typed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caresift.catalog.registry import query, table
from caresift.session import shared_dir
from caresift.sources import discovery, readers, writers


def fresh(spark, name):
    """A new folder for one run."""
    return f"{shared_dir(spark)}/caresift/{name}-{uuid.uuid4().hex}"


@query("src_01_exam_records", """
    SELECT doc_id::VARCHAR AS id, md5(text) AS question, (doc_id % 4 + 1)::INT AS cop, lang AS subject_name, source AS topic_name FROM documents""")
def src_01(spark, d):
    path = fresh(spark, "exam")
    rows = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.lit("a").alias("opa"), F.lit("b").alias("opb"), F.lit("c").alias("opc"), F.lit("d").alias("opd"),
        (F.col("doc_id") % 4 + 1).cast("int").alias("cop"), F.lit(None).cast("string").alias("exp"), F.col("lang").alias("subject_name"), F.col("source").alias("topic_name"))
    rows.write.json(path)
    return readers.exam_records(spark, path).select("id", F.md5("question").alias("question"), "cop", "subject_name", "topic_name")


@query("src_02_literature_records", "SELECT doc_id AS pubid, md5(text) AS context, unnest([lang, source]) AS mesh FROM documents")
def src_02(spark, d):
    path = fresh(spark, "literature")
    context = F.struct(F.array("text").alias("contexts"), F.array(F.lit("RESULTS")).alias("labels"), F.array("lang", "source").alias("meshes"))
    table(spark, d, "documents").select(F.col("doc_id").alias("pubid"), F.lit("q").alias("question"), F.lit("a").alias("long_answer"), F.lit("yes").alias("final_decision"), context.alias("context")).write.json(path)
    rows = readers.literature_records(spark, path)
    return rows.select("pubid", F.md5(F.get("context.contexts", F.lit(0))).alias("context"), F.explode("context.meshes").alias("mesh"))


@query("src_03_consumer_folder", "SELECT 'Q' || doc_id AS question_id, lang AS question_type, md5('Why, \"really\"?' || chr(10) || text) AS question, md5(text) AS answer FROM documents")
def src_03(spark, d):
    path = fresh(spark, "consumer")
    quoted = F.concat(F.lit('Why, "really"?\n'), F.col("text"))
    rows = table(spark, d, "documents").select(F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("question_id"), F.col("lang").alias("question_type"), quoted.alias("question"), F.col("text").alias("answer"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = readers.consumer_folder(spark, path).where(F.col("source") != "")
    return back.select("question_id", "question_type", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query("src_04_dialogue_records", """
    SELECT a.conv_id * 100 + a.turn AS row_idx, md5(a.text) AS input, md5(b.text) AS output FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""")
def src_04(spark, d):
    from caresift.operators.turns import dialogue_pairs

    path = fresh(spark, "dialogue")
    dialogue_pairs(table(spark, d, "conversations")).select((F.col("conv_id") * 100 + F.col("turn")).alias("row_idx"), "input", "output").write.json(path)
    return readers.dialogue_records(spark, path).select("row_idx", F.md5("input").alias("input"), F.md5("output").alias("output"))


@query("src_06_eval_examples", "SELECT l_orderkey || '-' || l_linenumber AS prompt_id, l_quantity - 25 AS points, l_linestatus AS tag FROM lineitem")
def src_06(spark, d):
    path = fresh(spark, "examples")
    rubric = F.struct(F.lit("c").alias("criterion"), (F.col("l_quantity") - 25).alias("points"), F.array("l_linestatus").alias("tags"))
    table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("prompt_id"), F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))).alias("prompt"), F.array(rubric).alias("rubrics")).write.json(path)
    rows = readers.eval_examples(spark, {"full": path}).select("prompt_id", F.explode("rubrics").alias("r"))
    return rows.select("prompt_id", "r.points", F.get("r.tags", F.lit(0)).alias("tag"))


@query("src_06_meta_examples", "SELECT c_custkey::VARCHAR AS prompt_id, c_mktsegment AS cluster, unnest([0, 1])::BIGINT AS pos, unnest([c_acctbal > 5000, c_nationkey > 12]) AS label, unnest(['p' || c_nationkey, 'q']) AS rater_id FROM customer")
def src_06b(spark, d):
    from caresift.operators.agreement import exploded_labels

    path = fresh(spark, "meta")
    table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("prompt_id"), F.lit("x").alias("completion_id"), F.col("c_mktsegment").alias("category"),
        F.array(F.col("c_acctbal") > 5000, F.col("c_nationkey") > 12).alias("binary_labels"), F.array(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")), F.lit("q")).alias("anonymized_physician_ids")).write.json(path)
    return exploded_labels(readers.meta_examples(spark, path)).select("prompt_id", "cluster", F.col("pos").cast("bigint").alias("pos"), "label", "rater_id")


@query("src_07_benchmark_files", """
    SELECT 'csv' AS kind, item_id, md5(text) AS text FROM benchmark UNION ALL SELECT 'jsonl', item_id, md5(text) FROM benchmark UNION ALL SELECT 'tsv', item_id, md5(replace(replace(text, chr(10), ' '), chr(9), ' ')) FROM benchmark""")
def src_07(spark, d):
    rows = table(spark, d, "benchmark")
    csv, jsonl, tsv = (fresh(spark, k) for k in ("csv", "jsonl", "tsv"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(csv)
    rows.write.option("compression", "gzip").json(jsonl)
    rows.select(F.col("item_id").cast("string"), F.translate("text", "\n\t", "  ").alias("text")).select(F.concat_ws("\t", "item_id", "text").alias("value")).write.text(tsv)
    schema = "item_id long, text string"
    parts = [("csv", readers.benchmark_csv(spark, csv, schema)), ("jsonl", readers.benchmark_jsonl(spark, jsonl, schema)), ("tsv", readers.benchmark_tsv(spark, {"en": tsv}, schema).drop("lang"))]
    out = None
    for kind, df in parts:
        one = df.select(F.lit(kind).alias("kind"), "item_id", F.md5("text").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def _folder_name():
    """The reader takes the model from a file's name; Spark names its files itself, so here a folder carries the name."""
    return F.regexp_extract("_metadata.file_path", "file=([^/]+)", 1)


@query("src_08_metric_columns", "SELECT 'line_' || l_linenumber AS model, l_returnflag AS metric, round(avg(l_discount), 6) AS value, count(*)::DOUBLE AS n_samples, round(stddev_pop(l_discount), 6) AS bootstrap_std FROM lineitem GROUP BY 1, 2")
def src_08(spark, d):
    path = fresh(spark, "metrics")
    stats = table(spark, d, "lineitem").groupBy("l_linenumber", F.col("l_returnflag").alias("m")).agg(F.avg("l_discount").alias("a"), F.count(F.lit(1)).cast("double").alias("n"), F.stddev_pop("l_discount").alias("s"))
    pairs = F.array(*[F.struct(F.concat("m", F.lit(x)).alias("key"), F.col(c).alias("value")) for x, c in (("", "a"), (":n_samples", "n"), (":bootstrap_std", "s"))])
    objects = stats.groupBy("l_linenumber").agg(F.to_json(F.map_from_entries(F.flatten(F.collect_list(pairs)))).alias("value"))
    objects.select(F.format_string("eval_line_%d_20250101_120000.json", F.col("l_linenumber").cast("int")).alias("file"), "value").write.partitionBy("file").text(path)
    return readers.metric_files(spark, path, _folder_name()).withColumns({c: F.round(c, 6) for c in ("value", "bootstrap_std")})


@query("src_09_discovered_tables", """
    SELECT doc_id::VARCHAR AS id, 'records_a' AS dataset, lang AS subject_name, source AS primary_category, TRUE AS has_explanation FROM documents
    UNION ALL SELECT conv_id || '-' || turn, 'records_b', '', role, FALSE FROM conversations""")
def src_09(spark, d):
    a, b = fresh(spark, "a"), fresh(spark, "b")
    table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.lit("x").alias("explanation"), F.col("lang").alias("subject_name"), F.col("source").alias("primary_category")).write.parquet(a)
    table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("row_idx"), F.col("text").alias("input"), F.col("role").alias("primary_category")).write.parquet(b)
    database = f"found_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{fresh(spark, 'db')}'")
    spark.sql(f"CREATE TABLE {database}.records_a USING parquet LOCATION '{a}'")
    spark.sql(f"CREATE TABLE {database}.records_b USING parquet LOCATION '{b}'")
    return discovery.all_records(spark, database).select("id", "dataset", "subject_name", "primary_category", "has_explanation")


@query("src_10_example_results", "SELECT 'model_' || o_orderstatus AS model, o_orderkey::VARCHAR AS prompt_id, o_totalprice / 500000 AS score, o_custkey AS input_tokens FROM orders")
def src_10(spark, d):
    path = fresh(spark, "results")
    example = F.struct(F.col("o_orderkey").cast("string").alias("prompt_id"), (F.col("o_totalprice") / 500000).alias("score"), F.struct(F.col("o_custkey").alias("input_tokens")).alias("usage"))
    # a result file is one object; a run is cut into many files here
    file, part = F.concat(F.lit("eval_model_"), "o_orderstatus", F.lit("_20250101_120000_allresults.json")).alias("file"), (F.col("o_orderkey") % 64).alias("part")
    rows = table(spark, d, "orders").groupBy(file, part).agg(F.struct(F.collect_list(example).alias("example_level_metadata")).alias("metadata"))
    rows.write.partitionBy("file", "part").json(path)
    back = readers.example_results(spark, path, _folder_name())
    return back.select("model", "prompt_id", "score", "usage.input_tokens")


@query("snk_01_insert_if_absent", "SELECT source_id, chunk FROM (SELECT doc_id AS source_id, md5(text) AS chunk FROM documents)")
def snk_01(spark, d):
    target = fresh(spark, "insert")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.md5("text").alias("chunk"))
    some = rows.join(table(spark, d, "labels").select(F.col("doc_id").alias("source_id")), "source_id", "left_semi")
    writers.insert_if_absent(some.unionByName(some), target, ["source_id"])
    writers.insert_if_absent(rows.unionByName(rows), target, ["source_id"], order=["chunk"])
    return spark.read.parquet(target)


@query("snk_02_rewrite", "SELECT doc_id, upper(lang) AS lang FROM documents")
def snk_02(spark, d):
    path = writers.rewrite(table(spark, d, "documents").select("doc_id", F.upper("lang").alias("lang")), fresh(spark, "rewrite"), "v2")
    return spark.read.parquet(path)


@query("snk_03_mapping_csv", "SELECT doc_id::VARCHAR AS id, source AS dataset, lang AS primary_category FROM documents")
def snk_03(spark, d):
    path = fresh(spark, "mapping")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("dataset"), F.lit("s").alias("subject_name"), F.lit("t").alias("topic_name"), F.lit("q").alias("question"),
                                               F.col("lang").alias("primary_category"), F.lit("").alias("secondary_category"), F.lit("TIER_A").alias("quality_tier"), F.lit(True).alias("has_explanation"))
    writers.write_category_mapping(rows, path)
    return spark.read.option("header", True).csv(path).select("id", "dataset", "primary_category")


@query("snk_04_report_tables", "SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def snk_04(spark, d):
    path = fresh(spark, "reports")
    writers.write_reports({"by_lang": table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))}, path)
    return spark.read.parquet(f"{path}/by_lang")


@query("snk_05_metric_files", "SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY 1 UNION ALL SELECT source, count(*)::BIGINT FROM documents GROUP BY 1")
def snk_05(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    a, b = fresh(spark, "json"), fresh(spark, "csv")
    writers.write_json(counts, a)
    writers.write_csv(counts, b)
    return spark.read.schema("source string, n bigint").json(a).unionByName(spark.read.schema("source string, n bigint").option("header", True).csv(b))


@query("snk_06_table_counts", "SELECT 'documents' AS source_table, count(*)::BIGINT AS cnt FROM documents UNION ALL SELECT 'labels', count(*)::BIGINT FROM labels UNION ALL SELECT 'events', count(*)::BIGINT FROM events")
def snk_06(spark, d):
    return writers.table_counts({n: table(spark, d, n) for n in ("documents", "labels", "events")})
