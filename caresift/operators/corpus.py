"""Corpus statistics, coverage, review queues and category links (AG-01 … AG-07, AG-41, AG-44, SET-01)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caresift import constants as K
from caresift.functions import text as X
from caresift.schemas import CATEGORIZED_COLUMNS

TIERS = list(K.TIER_WEIGHTS)

# The dimensions counted in one pass.
STAT_SETS = {
    "total": [],
    "dataset": ["dataset"],
    "category": ["primary_category"],
    "category_dataset": ["primary_category", "dataset"],
    "tier": ["quality_tier"],
    "category_tier": ["primary_category", "quality_tier"],
    "subject": ["subject_name"],
    "explanation": ["has_explanation"],
    "secondary": ["secondary_category"],
    "category_explanation": ["primary_category", "has_explanation"],
    "category_secondary": ["primary_category", "secondary_category"],
}
STAT_COLUMNS = ["dataset", "primary_category", "quality_tier", "subject_name", "has_explanation", "secondary_category"]


def harmonised(
    df: DataFrame, dataset: str | Column, key: Column, question: Column, subject: Column | None = None,
    topic: Column | None = None, explained: Column | None = None, question_chars: int | None = None,
) -> DataFrame:
    """Project categorised rows to the common schema."""
    empty = F.lit("")
    asked = F.coalesce(question, empty)
    return df.select(
        key.cast("string").alias("id"),
        (F.lit(dataset) if isinstance(dataset, str) else dataset).alias("dataset"),
        F.coalesce(subject if subject is not None else empty, empty).alias("subject_name"),
        F.coalesce(topic if topic is not None else empty, empty).alias("topic_name"),
        (asked if question_chars is None else F.substring(asked, 1, question_chars)).alias("question"),
        "primary_category",
        F.coalesce("secondary_category", empty).alias("secondary_category"),
        F.coalesce("quality_tier", F.lit("TIER_D")).alias("quality_tier"),
        (explained if explained is not None else F.lit(True)).alias("has_explanation"),
    )


def union_tables(tables: Sequence[DataFrame], columns: Sequence[str] = CATEGORIZED_COLUMNS) -> DataFrame:
    """SET-01."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).select(*columns)


def corpus_stats(categorized: DataFrame) -> DataFrame:
    """AG-01: eleven counts in one pass, long: which set, its keys, ``cnt``.

    Grouping sets multiply rows by the number of sets before the partial aggregation.  Counting the full combination
    first leaves at most a few thousand rows per partition to multiply.
    """
    combos = categorized.groupBy(*STAT_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    sets = list(STAT_SETS.values())
    grouped = combos.groupingSets(sets, *STAT_COLUMNS).agg(
        F.sum("n").alias("cnt"), F.grouping_id(*STAT_COLUMNS).alias("gid")
    )
    names = None
    for name, columns in STAT_SETS.items():
        gid = sum(0 if c in columns else 1 << (len(STAT_COLUMNS) - 1 - i) for i, c in enumerate(STAT_COLUMNS))
        names = F.when(F.col("gid") == gid, name) if names is None else names.when(F.col("gid") == gid, name)
    return grouped.select(names.alias("stat"), *STAT_COLUMNS, "cnt").where(
        ~(F.col("stat").isin("secondary", "category_secondary") & (F.col("secondary_category") == ""))
    )


def shares(counts: DataFrame, group: Sequence[str] = (), name: str = "pct") -> DataFrame:
    """AG-02: percentage of ``cnt`` within ``group`` (of everything without group).  ``counts`` is an aggregate."""
    total = F.sum("cnt").over(Window.partitionBy(*group))
    return counts.withColumn(name, F.when(total > 0, F.col("cnt") * 100.0 / total).otherwise(0.0))


def category_block(categorized: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """AG-03: one row per category: counts per dataset and tier, missing explanations."""
    return categorized.groupBy("primary_category").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("dataset") == d).alias(f"ds_{d}") for d in datasets],
        *[F.count_if(F.col("quality_tier") == t).alias(t.lower()) for t in TIERS],
        F.count_if(~F.col("has_explanation")).alias("missing"),
    )


def top_subjects(categorized: DataFrame, n: int = 10) -> DataFrame:
    """AG-03: the most frequent subjects of each category."""
    counts = categorized.groupBy("primary_category", "subject_name").agg(F.count(F.lit(1)).alias("cnt"))
    window = Window.partitionBy("primary_category").orderBy(F.desc("cnt"), "subject_name")
    return counts.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= n)


def coverage_gap(literature: Column, exam: Column) -> Column:
    """AG-04: how well a category is covered by literature next to exam questions."""
    return (
        F.when(literature == 0, K.GAP_LABELS["no_literature"])
        .when(exam == 0, K.GAP_LABELS["no_exam"])
        .when(literature < exam * 0.1, K.GAP_LABELS["low_literature"])
        .otherwise(K.GAP_LABELS["good"])
    )


def _pair_counts(categorized: DataFrame) -> DataFrame:
    """Counts of (primary, secondary) pairs.

    Pairs without a secondary are dropped after counting: a filter on the column itself would be pushed below the
    categorisation when both are in one plan, and evaluate the rules twice.
    """
    counted = categorized.groupBy("primary_category", "secondary_category").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("secondary_category")).alias("_some")
    )
    return counted.where(F.col("_some") > 0).drop("_some")


def category_pairs(categorized: DataFrame, n: int = 20) -> DataFrame:
    """AG-05: the most frequent (primary, secondary) pairs."""
    return (
        _pair_counts(categorized).withColumnRenamed("n", "cnt")
        .orderBy(F.desc("cnt"), "primary_category", "secondary_category").limit(n)
    )


def missing_explanations(categorized: DataFrame, dataset: str | None = "medmcqa") -> DataFrame:
    """AG-05: records without explanation by category."""
    rows = categorized.where(~F.col("has_explanation"))
    if dataset is not None:
        rows = rows.where(F.col("dataset") == dataset)
    return rows.groupBy("primary_category").agg(F.count(F.lit(1)).alias("cnt"))


def term_categories(rows: DataFrame, terms: str = "mesh_terms", category: str = "primary_category") -> DataFrame:
    """AG-06: each term's most frequent category; ties by category name."""
    counts = (
        rows.select(F.explode(terms).alias("term"), F.col(category).alias("category"))
        .groupBy("term", "category").agg(F.count(F.lit(1)).alias("cnt"))
    )
    best = F.min(F.struct((-F.col("cnt")).alias("neg"), "category")).alias("b")
    return counts.groupBy("term").agg(best).select("term", "b.category", (-F.col("b.neg")).alias("cnt"))


def category_links(categorized: DataFrame) -> DataFrame:
    """AG-07: the three most frequent secondary categories are strong links, the next three weak."""
    counts = _pair_counts(categorized).withColumnRenamed("n", "cross_hits")
    window = Window.partitionBy("primary_category").orderBy(F.desc("cross_hits"), "secondary_category")
    return (
        counts.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= 6)
        .select("primary_category", F.col("secondary_category").alias("target"), "cross_hits", "rn",
                F.when(F.col("rn") <= 3, "strong").otherwise("weak").alias("link_type"))
    )


def weakest_subjects(categorized: DataFrame, dataset: str | None = "medmcqa", min_rows: int = 100, n: int = 8) -> DataFrame:
    """AG-41: subjects with the highest share of missing explanations."""
    rows = categorized if dataset is None else categorized.where(F.col("dataset") == dataset)
    return (
        rows.withColumn("subject", F.when(F.col("subject_name") == "", "Unknown").otherwise(F.col("subject_name")))
        .groupBy("subject")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("has_explanation")).alias("missing"))
        .where(F.col("total") >= min_rows)
        .withColumn("missing_pct", F.col("missing") * 100.0 / F.col("total"))
        .orderBy(F.desc("missing_pct"), "subject").limit(n)
    )


def first_per_category(categorized: DataFrame, n: int, tier: str | None = None, order: Sequence[str] = ("id",)) -> DataFrame:
    """AG-44, LIM-04: the first ``n`` records of every category (only of one tier when given).

    The limit is applied per task before the shuffle, so a hot category sends at most ``n`` rows from each task.
    """
    rows = categorized if tier is None else categorized.where(F.col("quality_tier") == tier)
    window = Window.partitionBy("primary_category").orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= n)


def by_count(counts: DataFrame, *names: str) -> DataFrame:
    """LIM-05: most frequent first, ties by name."""
    return counts.orderBy(F.desc("cnt"), *names)


def review_queue(categorized: DataFrame, condition: Column, n: int = 20) -> DataFrame:
    """SNK-04, LIM-04: the first records (by id) that a person should look at."""
    return categorized.where(condition).orderBy("dataset", "id").limit(n)
