"""Ordered computations that survive groups of any size.

``running_before`` is the one primitive: for every row, the sum of a measure over the rows of its group that come
before it.  Ranks, quantiles, slices, worst-at-k and win counts are built on it.

A window over a group puts the group into one task.  When every group is small that is the cheapest plan, so it is used
whenever a count shows that no group exceeds ``hot_rows``.  Otherwise the rows are range-partitioned by group *and*
order, which splits a hot group over many tasks, and local sums are completed with the totals of the earlier
partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caresift.session import cut_lineage

HOT_ROWS = 1_000_000


def has_hot_group(df: DataFrame, keys: Sequence[str], hot_rows: int) -> bool:
    """One counting job over the keys only: does any group have more than ``hot_rows`` rows?"""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not counts.where(F.col("_n") > hot_rows).isEmpty()


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, str],
    hot_rows: int = HOT_ROWS,
    hot: bool | None = None,
    how: str = "sum",
) -> DataFrame:
    """Add, per ``name: measure``, the sum (or, with ``how="max"``, the largest) of ``measure`` over earlier rows.

    Earlier means smaller in ``order`` (ascending) among the rows of the same ``keys``.  For the first row a sum is 0 and
    a maximum null.  ``order`` must be unique within ``keys``, except among rows that add nothing.  Runs one counting
    job unless the caller knows whether groups are ``hot``; with a hot group also one checkpoint.
    """
    total = {"sum": F.sum, "max": F.max}[how]
    start = (lambda c: F.coalesce(c, F.lit(0))) if how == "sum" else (lambda c: c)
    added = (lambda a, b: a + F.coalesce(b, F.lit(0))) if how == "sum" else F.greatest
    if hot is None:
        hot = has_hot_group(df, keys, hot_rows)
    if not hot:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: start(total(m).over(window)) for n, m in measures.items()})

    # The partition number is written with the rows: later stages must all see the same placement.
    placed = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumns({f"_l_{n}": start(total(m).over(local)) for n, m in measures.items()})

    totals = placed.groupBy("_part", *keys).agg(*[total(m).alias(f"_t_{n}") for n, m in measures.items()])
    across = Window.partitionBy(*keys).orderBy("_part")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.withColumn("_first", F.row_number().over(across) == 1)
        .withColumns({f"_o_{n}": total(f"_t_{n}").over(earlier) for n in measures})
        .where(~F.col("_first"))
        .select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_o_{n}" for n in measures])
    )
    # Only groups cut by a partition border have offsets: fewer rows than partitions, so broadcasting is bounded.
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
        F.col("_part") == F.col("_p"),
    )
    joined = within.join(F.broadcast(offsets), same, "left")
    return joined.withColumns(
        {n: added(F.col(f"_l_{n}"), F.col(f"_o_{n}")) for n in measures}
    ).select(*df.columns, *measures)


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_idx", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number all rows from 0 in a unique order."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_before(ones, [], order, {name: "_one"}, hot_rows).drop("_one")


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one-row-per-group values back to rows; a null key is a group like any other."""
    renamed = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_g_{k}"]) for k in keys])
    return df.join(renamed, same, how).drop(*[f"_g_{k}" for k in keys])


def value_counts(df: DataFrame, keys: Sequence[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct values per group with ``cnt`` and ``before``, the number of rows with a smaller value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    # A group has at most as many distinct values as rows; only a group of many rows needs the closer look.
    hot = None if has_hot_group(df, keys, hot_rows) else False
    return running_before(counts, keys, [value], {"before": "cnt"}, hot_rows, hot)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Quantiles with linear interpolation, one row per group and quantile.

    Works on distinct values and their counts, so no task ever holds all values of a group.
    """
    counts = value_counts(df.select(*keys, F.col(value).alias("_v")), keys, "_v", hot_rows)
    sizes = counts.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    sized = join_groups(counts, sizes, keys) if keys else counts.withColumn("n", sizes.scalar())

    def covers(place: Column) -> Column:
        return F.when((F.col("before") <= place) & (place < F.col("before") + F.col("cnt")), F.col("_v"))

    picks, results = [], []
    for i, q in enumerate(at):
        place = F.lit(float(q)) * (F.col("n") - 1)
        picks += [F.max(covers(F.floor(place))).alias(f"_lo{i}"), F.max(covers(F.ceil(place))).alias(f"_hi{i}")]
        step = F.col(f"_hi{i}") - F.col(f"_lo{i}")
        results.append(F.struct(
            F.lit(float(q)).alias("q"), (F.col(f"_lo{i}") + step * (place - F.floor(place))).cast("double").alias("value")
        ))
    picked = sized.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    return picked.select(*keys, "n", F.explode(F.array(*results)).alias("r")).select(*keys, "n", "r.q", "r.value")


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the average rank of ``value`` within its group (ties share their mean rank)."""
    ranks = value_counts(df, keys, value, hot_rows).select(
        *keys, value, (F.col("before") + (F.col("cnt") + 1) / 2).alias(name)
    )
    return join_groups(df, ranks, [*keys, value])


def running_max_frontier(
    df: DataFrame, keys: Sequence[str], order: str, value: str, carry: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """WN-03: rows that beat everything earlier in ``order``.

    Rows of the same ``order`` value are first reduced to their best one (largest value, then smallest ``carry``
    columns), so what is put in order is the distinct dates or costs, not the rows.
    """
    rest = [c for c in carry if c != value]
    if rest:
        top = F.min(F.struct((-F.col(value)).alias("_neg"), *rest)).alias("_t")
        best = df.groupBy(*keys, order).agg(top).select(*keys, order, (-F.col("_t._neg")).alias(value), *[F.col(f"_t.{c}").alias(c) for c in rest])
    else:
        best = df.groupBy(*keys, order).agg(F.max(value).alias(value))
    ranked = running_before(best, keys, [order], {"_b": value}, hot_rows, how="max")
    return ranked.where(F.col("_b").isNull() | (F.col(value) > F.col("_b"))).drop("_b")
