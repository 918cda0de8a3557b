"""Failure patterns of evaluation runs (AG-42, AG-43, AG-45, JN-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift.functions import text as X

READY_AT, STALE_AFTER = 5, 20


def failed_items(examples: DataFrame) -> DataFrame:
    """AG-42: rubric items worth points that were not met, with query and beginning of the response.

    ``examples`` has ``prompt_id, prompt, completion, rubric_items``.
    """
    reply = F.try_element_at(F.filter("completion", lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    missed = F.filter("rubric_items", lambda r: ~F.coalesce(r["criteria_met"], F.lit(True)) & (r["points"] > 0))
    return examples.select(
        F.coalesce("prompt_id", F.lit("unknown")).alias("prompt_id"), X.last_user_text(F.col("prompt")).alias("query"),
        X.cut(F.coalesce(reply, F.lit("")), "response").alias("response"), F.posexplode_outer(missed).alias("item_idx", "r"),
    ).where(F.col("r").isNotNull()).select(
        "prompt_id", "query", "response", "item_idx", "r.criterion", "r.points", F.coalesce("r.tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("r.explanation", F.lit("")).alias("explanation"),
    )


def merged_tags(tagged: DataFrame, aliases: DataFrame, tag: str = "tag") -> DataFrame:
    """JN-18: tags replaced by the existing tag a decision table maps them to."""
    a = aliases.select(F.col("new_tag").alias(tag), F.col("existing_tag").alias("_to"))
    return tagged.join(a, tag, "left").withColumn("merged", F.col("_to").isNotNull() & (F.col("_to") != F.col(tag))).withColumn(
        tag, F.coalesce("_to", F.col(tag))
    ).drop("_to")


def pattern_counts(tagged: DataFrame, graduated: DataFrame | None = None, ready_at: int = READY_AT) -> DataFrame:
    """AG-43: occurrences per tag, last run, and whether it is ready to graduate.  Examples stay as rows in ``tagged``."""
    counts = tagged.groupBy("tag").agg(
        F.count(F.lit(1)).alias("cnt"), F.max(run_number(F.col("run_id"))).alias("last_run")
    )
    if graduated is None:
        done = counts.withColumn("graduated", F.lit(False))
    else:
        done = counts.join(graduated.select("tag", F.lit(True).alias("_g")), "tag", "left").withColumn("graduated", F.col("_g").isNotNull()).drop("_g")
    return done.withColumn("ready", (F.col("cnt") >= ready_at) & ~F.col("graduated"))


def run_number(run: Column) -> Column:
    """The number after the last underscore of a run name, or null."""
    return F.nullif(F.regexp_extract(run, r"(?:^|_)(\d+)$", 1), F.lit("")).cast("long")


def stale_patterns(patterns: DataFrame, current_run: int, after: int = STALE_AFTER) -> DataFrame:
    """AG-43: graduated tags never seen in a run or last seen at least ``after`` runs ago."""
    return patterns.where(F.col("graduated") & (F.col("last_run").isNull() | (current_run - F.col("last_run") >= after)))


def run_summary(tagged: DataFrame, known: DataFrame, ready_at: int = READY_AT) -> DataFrame:
    """AG-45: failures analysed, merged and new tags, tags that graduate."""
    per_tag = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("merged").alias("m"))
    before = known.select("tag", F.col("cnt").alias("_had"), "graduated")
    joined = per_tag.join(before, "tag", "left")
    total = F.col("n") + F.coalesce("_had", F.lit(0))
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("failures_analyzed"), F.count_if(F.col("_had").isNull()).alias("new_tags"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("merged_tags"),
        F.count_if((total >= ready_at) & ~F.coalesce("graduated", F.lit(False))).alias("graduated"),
    )
