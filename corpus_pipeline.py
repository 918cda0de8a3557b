"""The document pipeline: every stage takes what its predecessor kept; stages hand on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caresift.llm import decontaminate, mixing, ngram_join, tokens, toxicity
from caresift.llm.common import fresh_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return ngram_join.one_of_each_class(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or with a few words edited, go."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"), passages=True)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that the expected tokens of every domain meet its target; each stays at least once."""
    return mixing.repeated_to_targets(docs, _table(spark, sf_dir, "labels"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order, and one row per sequence, read back from them."""
    return tokens.sequence_table(spark, tokens.write_shards(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_per_class),
    ("benchmark_decontamination", drop_leaked),
    ("mixing", mix_to_targets),
    ("token_output", token_output),
]

#: Several stages are trained or iterate: no SQL says the same, the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
