"""SRC-01 … SRC-08, SRC-10: typed scans.  Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caresift import schemas as S


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cores when a scan has fewer tasks than there are cores (few or unsplittable files).

    Text rules are bound by CPU, so one round-robin shuffle pays off there.  A scan with enough tasks is left alone: on
    a large table this adds nothing to the plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def exam_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """SRC-01."""
    return _read(spark, path, S.MCQ, fmt)


def literature_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """SRC-02: nested contexts, labels and subject headings."""
    return _read(spark, path, S.LITERATURE, fmt)


def consumer_folder(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: a CSV file or folder; ``source`` is the file name without ending; unreadable files are skipped."""
    return (
        spark.read.schema(S.CONSUMER).option("header", True).option("multiLine", True).option("escape", '"')
        .option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).option("encoding", "UTF-8").csv(path)
        .withColumn("source", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    )


def dialogue_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """SRC-04."""
    return _read(spark, path, S.DIALOGUE, fmt)


def knowledge_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: whole documents as ``(path, text)``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("text"))


def eval_examples(spark: SparkSession, paths: dict[str, str], variant: str = "full") -> DataFrame:
    """SRC-06: rubric examples; ``paths`` names the file of each variant (full, hard, consensus)."""
    if variant not in paths:
        raise ValueError(f"unknown variant {variant!r}; known: {sorted(paths)}")
    return spark.read.schema(S.EVAL_EXAMPLE).json(paths[variant])


def meta_examples(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: examples with labels of several raters."""
    return spark.read.schema(S.META_EXAMPLE).json(path)


def benchmark_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-07: benchmark questions in CSV."""
    return _read(spark, path, schema, "csv")


def benchmark_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-07: benchmark questions in JSON lines, gzipped or not."""
    return spark.read.schema(schema).json(path)


def benchmark_tsv(spark: SparkSession, paths: dict[str, str], schema: str = "inputs string, targets string") -> DataFrame:
    """SRC-07: one tab-separated file per language, with a ``lang`` column."""
    out = None
    for lang, path in paths.items():
        rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path).withColumn("lang", F.lit(lang))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no language given")
    return out


def model_of_file(name):
    """SRC-08: model name inside ``eval_MODEL_date_time[_allresults].json``."""
    stem = F.regexp_replace(name, r"\.json$", "")
    tail = F.when(name.contains("_allresults"), F.regexp_replace(stem, r"(_[^_]*){3}$", "")).otherwise(
        F.regexp_replace(stem, r"(_[^_]*){2}$", ""))
    return F.regexp_replace(tail, r"^[^_]*_", "")


def metric_files(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """SRC-08: ``(model, metric, value, n_samples, bootstrap_std)`` from one JSON object per file.

    ``name`` says what the model is read from, by default the name of the file.
    """
    name = F.col("_metadata.file_name") if name is None else name
    objects = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        model_of_file(name).alias("model"), F.from_json("value", "map<string,double>").alias("m")
    )
    return metric_columns(objects.select("model", F.explode("m").alias("key", "value")))


def metric_columns(long: DataFrame) -> DataFrame:
    """Keys ``m``, ``m:n_samples`` and ``m:bootstrap_std`` to columns."""
    suffix = F.regexp_extract("key", r":(n_samples|bootstrap_std)$", 1)
    pick = lambda s: F.max(F.when(F.col("suffix") == s, F.col("value")))
    return (
        long.withColumn("suffix", suffix).withColumn("metric", F.regexp_replace("key", r":(n_samples|bootstrap_std)$", ""))
        .where(F.col("metric") != "score")
        .groupBy("model", "metric").agg(pick("").alias("value"), pick("n_samples").alias("n_samples"), pick("bootstrap_std").alias("bootstrap_std"))
    )


def example_results(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """SRC-10: per-example results of full result files, with the model of the file (see ``metric_files``)."""
    name = F.col("_metadata.file_name") if name is None else name
    return (
        spark.read.schema(S.RESULT_FILE).options(multiLine=True, recursiveFileLookup=True).json(path)
        .select(model_of_file(name).alias("model"), F.explode("metadata.example_level_metadata").alias("e"))
        .select("model", "e.*")
    )
