"""Evaluation: graded items to metrics, statistics and failure patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caresift.operators import failures, scoring


def graded(examples: DataFrame, grades: DataFrame) -> DataFrame:
    """UDF-02: examples with their rubric items marked by a grader's answers.

    ``grades`` is ``(prompt_id, item_idx, criteria_met, explanation)``; items without a grade count as not met.
    """
    items = examples.select("prompt_id", F.posexplode("rubrics").alias("item_idx", "r"))
    marked = items.join(grades, ["prompt_id", "item_idx"], "left")
    per_example = marked.groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct(
        "item_idx", "r.criterion", "r.points", "r.tags", F.coalesce("criteria_met", F.lit(False)).alias("criteria_met"),
        F.coalesce("explanation", F.lit("")).alias("explanation")))).alias("rubric_items"))
    return examples.join(per_example, "prompt_id")


def metrics(examples: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """AG-10, AG-12: metric rows and their clipped statistics (``keys`` end with the example key)."""
    rows = scoring.metric_rows(examples, keys)
    return rows, scoring.clipped_stats(rows, keys[:-1])


def failure_report(examples: DataFrame, tags: DataFrame, aliases: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AG-42 … AG-45: tagged failures and the run's summary.  ``tags`` is ``(prompt_id, item_idx, tag, run_id)``."""
    failed = failures.failed_items(examples).join(tags, ["prompt_id", "item_idx"], "left").withColumn("tag", F.coalesce("tag", F.lit("untagged")))
    tagged = failures.merged_tags(failed, aliases)
    return tagged, failures.run_summary(tagged, known)
