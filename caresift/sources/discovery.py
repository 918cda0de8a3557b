"""SRC-09: find record tables in the catalog by their columns and read them in the common schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caresift.functions import text as X
from caresift.schemas import CATEGORIZED_COLUMNS

# Columns in order of preference.
ID_COLUMNS = ["id", "pubid", "question_id", "row_idx"]
QUESTION_COLUMNS = ["question", "input"]
ANSWER_COLUMNS = ["explanation", "exp", "long_answer", "answer", "output"]
SUBJECT_COLUMNS = ["subject_name", "subject", "question_type"]
TOPIC_COLUMNS = ["topic_name", "topic", "source"]


def record_tables(spark: SparkSession, database: str | None = None) -> dict[str, list[str]]:
    """Tables with a primary category and a question (or input), and their columns."""
    found = {}
    for table in spark.catalog.listTables(database):
        name = table.name if database is None else f"{database}.{table.name}"
        columns = [c.name for c in spark.catalog.listColumns(name)]
        if "primary_category" in columns and any(q in columns for q in QUESTION_COLUMNS):
            found[name] = columns
    return found


def read_record_table(spark: SparkSession, name: str, columns: list[str], question_chars: int | None = None) -> DataFrame:
    """One table in the common schema; only the chosen columns are read."""
    def pick(options: list[str]):
        hit = next((c for c in options if c in columns), None)
        return F.lit("") if hit is None else F.coalesce(F.col(hit).cast("string"), F.lit(""))

    if "has_explanation" in columns:
        explained = F.coalesce(F.col("has_explanation"), F.lit(False))
    else:
        explained = F.lit(any(c in columns for c in ANSWER_COLUMNS))
    question = pick(QUESTION_COLUMNS)
    tier = F.col("quality_tier") if "quality_tier" in columns else F.lit(None).cast("string")
    secondary = F.col("secondary_category") if "secondary_category" in columns else F.lit(None).cast("string")
    return spark.table(name).select(
        pick(ID_COLUMNS).alias("id"), F.lit(name.split(".")[-1]).alias("dataset"), pick(SUBJECT_COLUMNS).alias("subject_name"),
        pick(TOPIC_COLUMNS).alias("topic_name"),
        (question if question_chars is None else F.substring(question, 1, question_chars)).alias("question"),
        "primary_category", F.coalesce(secondary, F.lit("")).alias("secondary_category"),
        F.coalesce(tier, F.lit("TIER_D")).alias("quality_tier"), explained.alias("has_explanation"),
    )


def all_records(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Every record table of the database, united."""
    tables = record_tables(spark, database)
    if not tables:
        raise ValueError("no table with a primary category and a question")
    parts = [read_record_table(spark, n, c) for n, c in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts).select(*CATEGORIZED_COLUMNS)
