"""STR-07: activity in tumbling, sliding and session windows of event time, and repeated events, with late data.

A watermark trails the latest event time by ``delay``.  Windows are written once, when the watermark has passed their end,
so state holds open windows only and results never change.  Rows that arrive for a closed window are dropped and counted.
Rows without an event time belong to no window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caresift.streaming.state import _appending

#: Seconds between two looks at the progress of a running stream; Spark keeps the last 100 batches.
LOOK_EVERY = 2


def activity_windows(events: DataFrame, keys: Sequence[str], measures: Sequence[Column], length: str, every: str | None = None, delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """``keys``, ``window_start, window_end`` and the measures of each window; ``every`` shorter than ``length``: sliding."""
    window = F.window(time, length, every or length)
    return _bounds(events.withWatermark(time, delay).groupBy(*keys, window.alias("_w")).agg(*measures), keys)


def activity_sessions(events: DataFrame, keys: Sequence[str], measures: Sequence[Column], gap: str, delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """One row per session: events of a key that follow one another by at most ``gap``; it ends ``gap`` after the last."""
    return _bounds(events.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(*measures), keys)


def distinct_events(events: DataFrame, keys: Sequence[str], delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """The first event of each key; a repetition is known as long as the watermark is less than ``delay`` past the first."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def _bounds(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    others = [c for c in windows.columns if c not in (*keys, "_w")]
    return windows.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *others)


def write_closed(result: DataFrame, path: str, checkpoint: str) -> int:
    """Append what is closed to ``path`` until the input is read; the number of late rows that were dropped.

    Rows count as they reach the state, that is, rows of one window and key that a task has already combined as one.
    A batch that runs again replaces its own folder.
    """
    query = (
        result.writeStream.foreachBatch(_appending(path)).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    dropped: dict[int, int] = {}
    done = False
    while not done:
        done = query.awaitTermination(LOOK_EVERY)
        for progress in query.recentProgress:
            dropped[progress.batchId] = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
    return sum(dropped.values())


def closed(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_closed`` wrote, whatever batch it came in."""
    return spark.read.schema(schema).parquet(f"{path}/batch=*")
