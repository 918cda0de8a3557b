"""Written stages, word hashing on UTF-8 bytes, and groups streamed through Arrow batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from caresift.session import shared_dir

#: Bytes of text worked on at once: large enough for vector operations, small enough for the processor's cache.
SLICE_BYTES = 1 << 18
#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 4 << 20
#: Rows of a few numbers that are worth a task and a file of their own.
TASK_ROWS = 50_000

#: White space of the word contract, [\x20\x09-\x0D].
WHITE_SPACE = (9, 10, 11, 12, 13, 32)

_BASE = 0x9E3779B97F4A7C15


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared folder the cluster names."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later stages neither recompute it nor depend on an executor."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many tasks as about ``rows`` rows ask for, one for each core at least: tiny files cost more time than their rows."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def forget(df: DataFrame) -> None:
    """Remove a table that ``stored`` wrote and nothing needs any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Let at most ``BATCH_BYTES`` go to a Python worker at once, unless the session allows even less.

    Whole texts are long: at Spark's 64 MB a batch, its copies in the executor and its workers add up to much memory.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub("[^0-9-]", "", spark.conf.get(key)) or 0)
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- words of many texts at once -----------------------------------------------------------------------------------

def separators(*codes: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into row ranges of about ``limit`` bytes: (first row, end row, bytes, offsets of each text).

    A null text has no bytes.  A text longer than the limit is a range of its own.
    """
    column = column.cast(pa.large_string())
    size = len(column)
    if not size:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + size + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    low = 0
    while low < size:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of its first word (with one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = between[data]
    begin, end = ~gap, ~gap
    begin[1:] &= gap[:-1]
    end[:-1] &= gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] = ~gap[inner]
    end[inner - 1] = ~gap[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words: eight bytes at a time are taken into two chains, each step of which mixes all bits."""

    #: Words of more bytes than this are hashed one by one.
    LONG = 512

    def __init__(self) -> None:
        self.byte = np.random.default_rng(20_011).integers(1, 1 << 63, 256).astype(np.uint64)

    def pairs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of every word."""
        size = ends - starts
        one, two = mixed(size.astype(np.uint64) ^ self.byte[1]), mixed(size.astype(np.uint64) + self.byte[2])
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[:len(data)] = data
        # The eight bytes from every byte on.
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        long = size > self.LONG
        left = np.flatnonzero(~long) if long.any() else np.arange(len(size))
        at, rest = starts[left], size[left]
        while len(left):
            chunk = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * np.minimum(rest, 8)).astype(np.uint64))
            one[left] = mixed(one[left] ^ chunk)
            two[left] = mixed(two[left] * np.uint64(_BASE) + chunk)
            more = np.flatnonzero(rest > 8)
            left, at, rest = left[more], at[more] + 8, rest[more] - 8
        for k in np.flatnonzero(long):
            one[k], two[k] = np.frombuffer(xxhash.xxh3_128_digest(data[starts[k]:ends[k]].tobytes()), np.uint64)
        return one, two

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.pairs(data, starts, ends)[0]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words, in their order; as many as there are full windows in the slice."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total, done, step, block = np.zeros(count, np.uint64), 0, 1, words
    factor = _BASE | 1
    left = width
    # Binary powers of the width: a block of 2s words joins two blocks of s words.
    while left:
        if left & 1:
            total = total * np.uint64(pow(factor, step, 1 << 64)) + block[done:done + count]
            done += step
        left >>= 1
        if left:
            block = block[:len(block) - step] * np.uint64(pow(factor, step, 1 << 64)) + block[step:]
            step *= 2
    return mixed(total)


def full_windows(first: np.ndarray, width: int, count: int) -> np.ndarray:
    """Which of the ``count`` windows of a slice lie inside one text; ``first``: first word of each text, and the end."""
    inside = np.zeros(count, bool)
    last = first[1:] - width
    sizes = np.maximum(last - first[:-1] + 1, 0)
    inside[ranges(first[:-1][sizes > 0], sizes[sizes > 0])] = True
    return inside


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start+1, … for every range, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


# --- groups ---------------------------------------------------------------------------------------------------------

def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """From batches sorted by ``keys``, tables that each hold whole groups only (several small ones, or one large one)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = last_change(batch, keys)
        if held and (cut > 0 or not same_key(held[-1], batch, keys)):
            head = [batch.slice(0, cut)] if cut else []
            yield pa.Table.from_batches(held + head)
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def last_change(batch: pa.RecordBatch, keys: Sequence[str]) -> int:
    """The row at which the last group of the batch begins."""
    return int(group_starts(batch, keys)[-1])


def group_starts(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        column = table.column(k)
        values = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def same_key(a: pa.RecordBatch, b: pa.RecordBatch, keys: Sequence[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)


def binary_rows(column: pa.ChunkedArray | pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype) for x in column]
