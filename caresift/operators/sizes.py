"""Size checks before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, otherwise: str | None = None) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``rows`` rows, else unchanged or with the hint ``otherwise`` (a shuffle join follows).

    For narrow tables derived from queries or rules, whose size Spark cannot estimate: without the mark the large side
    would be shuffled before adaptive execution learns that the other side is small.  Runs one job over ``df`` only.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


def parts_of(df: DataFrame, rows: int) -> int:
    """In how many parts ``df`` goes so that each has about ``rows`` rows: tasks stay the same size however large it is.  Runs one counting job."""
    return max(1, -(-df.count() // rows))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt over tasks of about ``rows`` rows, for rows that grow inside a task: a compact file is read by few tasks, however many rows it has."""
    return df.repartition(parts_of(df, rows))
