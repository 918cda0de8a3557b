"""Rubric scores, metric statistics, bootstrap and benchmark accuracies (AG-09 … AG-13, AG-19 … AG-24)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift import constants as K
from caresift.functions import text as X

EXAMPLE = ["run_id", "model", "example_id"]


def rubric_score(points: Column, met: Column) -> Column:
    """AG-09, as an aggregate: points of met items over all positive points; null without positive points."""
    possible = F.sum(F.when(points > 0, points))
    return F.coalesce(F.sum(F.when(met, points)), F.lit(0.0)) / F.nullif(possible, F.lit(0.0))


def rubric_score_of(items: Column) -> Column:
    """AG-09 on an array of items inside one row."""
    total = lambda f: F.aggregate(F.filter(items, f), F.lit(0.0), lambda acc, r: acc + r["points"])
    return total(lambda r: r["criteria_met"]) / F.nullif(total(lambda r: r["points"] > 0), F.lit(0.0))


def example_scores(items: DataFrame, keys: Sequence[str] = EXAMPLE) -> DataFrame:
    """AG-09 for a long table of graded items."""
    return items.groupBy(*keys).agg(rubric_score(F.col("points"), F.col("criteria_met")).alias("score"))


def metric_rows(examples: DataFrame, keys: Sequence[str] = EXAMPLE) -> DataFrame:
    """AG-10 on one row per example with ``rubric_items`` and ``example_tags``: ``(keys, metric, value)``.

    The overall score, each example tag with the overall score, and each rubric tag with the score of its own items
    (left out when they have no positive points).  Works inside the row: no shuffle.
    """
    overall = rubric_score_of(F.col("rubric_items"))
    tags = F.array_distinct(F.flatten(F.transform("rubric_items", lambda r: r["tags"])))
    own = F.transform(
        tags,
        lambda t: F.struct(t.alias("metric"), rubric_score_of(
            F.filter("rubric_items", lambda r: F.array_contains(r["tags"], t))).alias("value")),
    )
    inherited = F.transform("example_tags", lambda t: F.struct(t.alias("metric"), F.col("_o").alias("value")))
    head = F.array(F.struct(F.lit("overall_score").alias("metric"), F.col("_o").alias("value")))
    return (
        examples.withColumn("_o", overall).withColumn("_own", own)
        .select(*keys, F.explode_outer(F.concat(head, inherited, "_own")).alias("m"))
        .select(*keys, "m.metric", "m.value").where(F.col("value").isNotNull())
    )


def tag_scores(items: DataFrame, keys: Sequence[str] = EXAMPLE) -> DataFrame:
    """AG-10 for a long table of graded items with ``tags``."""
    tagged = items.select(*keys, "points", "criteria_met", F.explode("tags").alias("metric"))
    return (
        tagged.groupBy(*keys, "metric").agg(rubric_score(F.col("points"), F.col("criteria_met")).alias("value"))
        .where(F.col("value").isNotNull())
    )


def metric_stats(metrics: DataFrame, keys: Sequence[str] = ("run_id", "model")) -> DataFrame:
    """AG-11: mean, population std, min, max and n of every metric."""
    v = F.col("value")
    return metrics.groupBy(*keys, "metric").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count(v).alias("n_samples"),
    )


def keyed_stats(stats: DataFrame, keys: Sequence[str] = ("run_id", "model")) -> DataFrame:
    """AG-11: long form with the keys ``name`` (mean) and ``name:stat``."""
    names = ["mean", "std", "min", "max", "n_samples"]
    pairs = F.array(*[
        F.struct((F.col("metric") if n == "mean" else F.concat(F.col("metric"), F.lit(f":{n}"))).alias("key"),
                 F.col(n).cast("double").alias("value"))
        for n in names
    ])
    return stats.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.key", "p.value")


def clipped_stats(metrics: DataFrame, keys: Sequence[str] = ("run_id", "model")) -> DataFrame:
    """AG-12, AG-13 (b): clipped mean, n and the analytic standard error that the bootstrap estimates."""
    v = F.col("value")
    return metrics.groupBy(*keys, "metric").agg(
        X.clip01(F.avg(v)).alias("mean"), F.count(v).alias("n_samples"),
        (F.stddev_pop(v) / F.sqrt(F.count(v))).alias("std_error"),
    )


def bootstrap_std(metrics: DataFrame, keys: Sequence[str] = ("run_id", "model"), replicates: int = 1000, seed: int = 0) -> DataFrame:
    """AG-13 (a): standard deviation of the clipped mean over Poisson bootstrap replicates.

    Equal values are counted first; a value seen c times gets Poisson(c) copies in every replicate.  The values are
    dealt over all tasks by their hash, so a large metric is spread; a task adds up its batches and sends one row of
    replicate sums per metric.  The draw depends on value, replicate and seed only (a counter-based generator), so a
    recomputed task repeats it.
    """
    group = [*keys, "metric"]
    counts = (
        metrics.where(F.col("value").isNotNull()).groupBy(*group, "value").agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("h", F.xxhash64(*group, "value", F.lit(seed)))
    )
    types = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in group)

    def uniform(h: np.ndarray) -> np.ndarray:
        x = h.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53

    def poisson(h: np.ndarray, cnt: np.ndarray) -> np.ndarray:
        """Inverse of the distribution function, tabulated once per distinct count within 12 standard deviations."""
        out = np.empty((len(h), replicates))
        for c in np.unique(cnt):
            low = max(0, int(c - 12 * np.sqrt(c)))
            k = np.arange(low, int(c + 12 * np.sqrt(c) + 12))
            logs = np.concatenate([[0.0], np.cumsum(np.log(c) - np.log(k[1:]))])
            mass = np.exp(logs - logs.max())
            mine = cnt == c
            out[mine] = low + np.searchsorted(np.cumsum(mass) / mass.sum(), uniform(h[mine]))
        return out

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), 512):
                for names, part in batch.iloc[at:at + 512].groupby(group, sort=False, dropna=False):
                    copies = poisson(part["h"].to_numpy(), part["cnt"].to_numpy())
                    both = np.stack([copies.sum(0), part["value"].to_numpy(float) @ copies])
                    names = tuple(None if pd.isna(x) else x for x in names)
                    sums[names] = sums[names] + both if names in sums else both
        rows = [dict(zip(group, names)) | {"w": both[0].tolist(), "t": both[1].tolist()} for names, both in sums.items()]
        yield pd.DataFrame(rows, columns=[*group, "w", "t"])

    partial = counts.repartition("h").mapInPandas(draw, f"{types}, w array<double>, t array<double>")
    sums = (
        partial.select(*group, F.posexplode(F.arrays_zip("w", "t")).alias("replicate", "s"))
        .groupBy(*group, "replicate").agg(F.sum("s.w").alias("w"), F.sum("s.t").alias("t"))
    )
    return (
        sums.withColumn("m", X.clip01(F.col("t") / F.nullif(F.col("w"), F.lit(0.0))))
        .groupBy(*group).agg(F.stddev_pop("m").alias("bootstrap_std"), F.count("m").alias("replicates"))
    )


def accuracy(df: DataFrame, by: Sequence[str], predicted: str, label: str) -> DataFrame:
    """AG-19: share of right predictions per group."""
    return df.groupBy(*by).agg(
        F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def subject_group(subject: Column) -> Column:
    """AG-20, JN-17: the group of an exam subject; null for an unknown one."""
    groups = F.create_map(*[F.lit(x) for pair in K.SUBJECT_CATEGORIES.items() for x in pair])
    return F.element_at(groups, subject)


def script_group(language: Column) -> Column:
    """AG-20: Latin or other script."""
    return F.when(language.isin(K.LATIN_LANGUAGES), "group_latin").otherwise("group_non_latin")


def short_fact_metrics(df: DataFrame, by: Sequence[str] = (), grade: str = "grade") -> DataFrame:
    """AG-21: grades A (correct), B (incorrect), C (not attempted) to shares, attempted accuracy and F1."""
    share = lambda g: F.avg((F.col(grade) == g).cast("double"))
    out = df.groupBy(*by).agg(
        share("A").alias("is_correct"), share("B").alias("is_incorrect"), share("C").alias("is_not_attempted")
    )
    out = out.withColumn("is_given_attempted", F.col("is_correct") + F.col("is_incorrect"))
    out = out.withColumn("accuracy_given_attempted", F.coalesce(
        F.col("is_correct") / F.nullif(F.col("is_given_attempted"), F.lit(0.0)), F.lit(0.0)))
    both = F.col("accuracy_given_attempted") + F.col("is_correct")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("accuracy_given_attempted") * F.col("is_correct") / both).otherwise(0.0))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """AG-23: chance that one of k samples passes when c of n did."""
    steps = F.when(c > 0, F.sequence((n - c + 1).cast("int"), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    none = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (1.0 - F.lit(float(k)) / i))
    return F.when(n - c < k, F.lit(1.0)).otherwise(1.0 - none)


def unified_scores(dimensions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG-24, SET-03: weighted score of five dimensions; null with ``missing`` and ``unexpected`` unless they are exact.

    ``dimensions`` is ``(keys…, dimension, score)``.
    """
    names = F.array(*[F.lit(d) for d in K.DIMENSION_WEIGHTS])
    table = F.create_map(*[F.lit(x) for pair in K.DIMENSION_WEIGHTS.items() for x in pair])
    per_dimension = dimensions.groupBy(*keys, "dimension").agg(F.max("score").alias("score"))
    grouped = per_dimension.groupBy(*keys).agg(
        F.sum(F.col("score") * F.element_at(table, F.col("dimension"))).alias("_s"),
        F.collect_set(F.when(F.col("dimension").isin(list(K.DIMENSION_WEIGHTS)), F.col("dimension"))).alias("_d"),
        F.count_if(~F.col("dimension").isin(list(K.DIMENSION_WEIGHTS))).alias("unexpected"),
    )
    missing = F.array_sort(F.array_except(names, "_d"))
    return grouped.select(
        *keys, F.array_join(missing, ",").alias("missing"), "unexpected",
        F.when((F.size(missing) == 0) & (F.col("unexpected") == 0), F.col("_s")).alias("unified_score"),
    )


def copied_to_tags(scores: DataFrame, keys: Sequence[str], tags: str = "tags", value: str = "unified_score") -> DataFrame:
    """AG-24: the score under every tag of its example."""
    return scores.select(*keys, F.explode(tags).alias("metric"), F.col(value).alias("value"))
