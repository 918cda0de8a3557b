"""Samples, slices and repetitions (LIM-02 … LIM-07)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caresift.operators.ordered import HOT_ROWS, numbered


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """LIM-02: ``n`` rows without replacement, the same ones for the same keys and seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key).limit(n)


def page(df: DataFrame, order: Sequence[str], offset: int, length: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """SRC-01, LIM-03: rows ``offset`` to ``offset + length`` of an order, which is made unique by the other columns.

    Rows are numbered where they are, so that a page far down does not bring all rows before it into one task.
    """
    rest = [c for c in df.columns if c not in order]
    rows = numbered(df, [*order, *rest], "_row", hot_rows)
    return rows.where((F.col("_row") >= offset) & (F.col("_row") < offset + length)).drop("_row")


def spread_pages(df: DataFrame, order: Sequence[str], pages: int, length: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """LIM-03: ``pages`` slices of ``length`` rows, starting at multiples of (rows // pages)."""
    rows = numbered(df, order, "row_idx", hot_rows)
    step = F.greatest(F.floor(rows.agg(F.count(F.lit(1)).alias("n")).scalar() / pages), F.lit(1))
    page_no = F.floor(F.col("row_idx") / step)
    return (
        rows.withColumn("page", page_no).where((F.col("row_idx") - F.col("page") * step < length) & (F.col("page") < pages))
    )


def repeated(df: DataFrame, n: int) -> DataFrame:
    """LIM-06: every row ``n`` times, with ``sample_idx``."""
    return df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def companions(tests: DataFrame, train: DataFrame, n: int, key: str, train_key: str, seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """LIM-07: ``n`` different seeded training rows for every test row (all of them when there are no more).

    Training rows are numbered; the numbers are cut into ``n`` equal ranges, and a test row takes from each range the
    number that a hash of its key points to.  Then rows meet by equality of numbers.
    """
    offered = numbered(train.select(F.col(train_key).alias("train_id")), ["train_id"], "_at", hot_rows)
    rows = train.count()
    take = min(n, rows)
    if not take:
        return tests.select(key).limit(0).select("*", F.lit(None).cast(train.schema[train_key].dataType).alias("train_id"), F.lit(0).alias("shot"))
    shot = F.col("shot")
    low, high = F.floor((shot - 1) * rows / take), F.floor(shot * rows / take)
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key, shot)), 1, 12), 16, 10).cast("bigint")
    wanted = tests.withColumn("shot", F.explode(F.sequence(F.lit(1), F.lit(take)))).withColumn("_at", (low + drawn % (high - low)).cast("bigint"))
    return wanted.join(offered, "_at").drop("_at")
