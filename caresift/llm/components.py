"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caresift.llm.common import few_tasks, forget, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node it reaches) for every node of ``edges`` (columns ``a``, ``b``: bigint).

    Each step is two aggregations and joins by equality and is written to the shared folder, in tasks by the number of
    edges; the number of steps grows with the logarithm of the longest path.  Nothing is collected but a count and a
    checksum of the edges.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(edges.where(a != b).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = stored(few_tasks(large, mark[0]), "components")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = stored(few_tasks(small.select("e.a", "e.b").where(a != b).distinct(), mark[0]), "components")
        forget(now)
        forget(large)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(a.alias("node"), b.alias("component")).unionByName(now.select(b.alias("node"), b.alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum("b")).first())
