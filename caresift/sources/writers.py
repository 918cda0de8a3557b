"""SNK-01 … SNK-06."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from caresift import constants as K
from caresift.schemas import CATEGORIZED_COLUMNS


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first in ``order``, or any."""
    if not order:
        return rows.dropDuplicates(list(keys))
    others = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
        .select(*keys, "_r.*").select(*rows.columns)
    )


def absent(rows: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-02: rows whose key is not in the target."""
    return rows.join(target.select(*keys), list(keys), "left_anti")


def insert_if_absent(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (), partition_by: Sequence[str] = ()) -> int:
    """SNK-01: append the rows whose key is neither in the target nor earlier in the batch; returns how many.

    A plain append: files appear when the job commits, so a run that failed before that can simply run again.  A commit
    that was itself interrupted may leave part of the rows, which the next run then finds and leaves out.  Two writers
    at the same time are not kept apart.
    """
    new = first_of_each(rows, keys, order)
    try:
        new = absent(new, rows.sparkSession.read.parquet(path), keys)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*partition_by).parquet(path)
    return int(seen.get["n"])


def rewrite(df: DataFrame, path: str, version: str, partition_by: Sequence[str] = ()) -> str:
    """SNK-02: write a recomputed table as a new version next to the old one and return its path.

    Readers switch by path (or by pointing their table at it), so none sees a half-written table.
    """
    target = f"{path.rstrip('/')}/{version}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(target)
    return target


def write_category_mapping(categorized: DataFrame, path: str) -> None:
    """SNK-03: the nine-column mapping as CSV with header."""
    categorized.select(*CATEGORIZED_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def labelled_terms(term_categories: DataFrame) -> DataFrame:
    """SNK-03, JN-17: term, category and display name (the category itself when it has none), by term."""
    table = F.create_map(*[F.lit(x) for pair in K.CATEGORY_LABELS.items() for x in pair])
    return term_categories.select(
        F.col("term").alias("mesh_term"), F.col("category").alias("primary_category"),
        F.coalesce(F.element_at(table, F.col("category")), F.col("category")).alias("category_label"),
    ).orderBy("mesh_term")


def write_term_mapping(term_categories: DataFrame, path: str) -> None:
    """SNK-03."""
    labelled_terms(term_categories).write.mode("overwrite").option("header", True).csv(path)


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """SNK-04: each report table under its name."""
    for name, df in reports.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    """SNK-05: metrics or full results as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-05: an extract as CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """SNK-06: ``(source_table, cnt)``; tables are counted where they are, only counts are united."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(name).alias("source_table"), "cnt")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no table given")
    return out


