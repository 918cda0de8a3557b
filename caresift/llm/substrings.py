"""Substring dedup: repeated windows of words, found by super-k-mer partitioning.

A window is ``width`` consecutive words of one text.  Its minimiser is the smallest hash of its runs of ``run`` words;
neighbouring windows mostly share it, and such windows travel together as one string (a super-k-mer) to the bucket of
their minimiser.  Equal windows have equal minimisers, so a bucket sees all occurrences of its windows: sorting them
tells which starts earlier.  A word goes if some window over it also starts earlier.

Before anything is sent, a slice of texts drops the windows that it holds several times, but for the first: a passage
in a third of all texts is sent once per slice.  Minimisers found in a large share of a sample of texts are dealt by
window instead of minimiser, so that no bucket grows with one passage; the sample steers only where windows meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caresift.llm.common import (
    WHITE_SPACE, WordHasher, full_windows, group_starts, mixed, separators, shuffle_partitions, small_batches, stored, text_slices, whole_groups, window_hashes, word_bounds,
)

WINDOW = 20
RUN = 8
SLICE = 4 << 20
#: A minimiser found in one of this many sampled texts is common.  At most HEAVY of them are treated apart.
SHARE, HEAVY, SAMPLE = 500, 10_000, 20_000
#: Stands for a null id, which counts as smaller than every other.
NULL_ID = -(1 << 63)


def minimisers(words: np.ndarray, width: int, run: int) -> np.ndarray:
    """The minimiser of every window of the slice (also of those across texts)."""
    values = window_hashes(words, run)
    span, left = 1, width - run + 1
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    while 2 * span <= left:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:count], values[left - span:left - span + count]) if left > span else values[:count]


class Windows:
    """Words and windows of a slice: where they lie, and two independent 64-bit hashes of every window."""

    def __init__(self, hasher: WordHasher, between: np.ndarray, data: np.ndarray, offsets: np.ndarray, width: int) -> None:
        self.starts, self.ends, self.first = word_bounds(data, offsets, between)
        self.words, others = hasher.pairs(data, self.starts, self.ends)
        self.one = window_hashes(self.words, width)
        self.two = window_hashes(others, width)
        self.place = np.flatnonzero(full_windows(self.first, width, len(self.one)))
        self.text = np.searchsorted(self.first, self.place, "right") - 1


def earlier(one: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For every window whether an equal one has a smaller (document, start)."""
    order = np.lexsort((start, doc, two, one))
    a, b, d, s = one[order], two[order], doc[order], start[order]
    same = np.zeros(len(a), bool)
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
    out = np.zeros(len(a), bool)
    out[order] = (d != d[head]) | (s != s[head])
    return out


def covered(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts: document, first start, number of windows."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1
    return (doc[heads], start[heads], start[tails] - start[heads] + 1) if len(doc) else (doc, start, start)


def common_minimisers(docs: DataFrame, width: int, run: int) -> np.ndarray:
    """Minimisers of a large share of a sample of about ``SAMPLE`` texts: at most ``HEAVY`` numbers."""
    total = docs.count()
    rate = min(1.0, SAMPLE / max(total, 1))
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, between = WordHasher(), separators(*WHITE_SPACE)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(1)):
                view = Windows(hasher, between, data, offsets, width)
                pairs = np.unique(np.stack([view.text.astype(np.uint64), minimisers(view.words, width, run)[view.place]]), axis=1) if len(view.place) else np.zeros((2, 0), np.uint64)
                value, n = np.unique(pairs[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["value", "n"])

    counted = sample.mapInArrow(note, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))
    least = max(4.0, min(total, SAMPLE) / SHARE)
    rows = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "value").limit(HEAVY).collect()
    return np.sort(np.array([r["value"] for r in rows], np.int64).view(np.uint64))


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW, run: int = RUN) -> DataFrame:
    """``id, starts, sizes``: for texts with repeated windows, runs of them as first words and numbers of windows."""
    spark = docs.sparkSession
    buckets = 4 * shuffle_partitions(spark)
    source = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NULL_ID)).alias("id"), F.col(text).alias("text"))
    heavy = common_minimisers(source, width, run)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, between, squeeze = WordHasher(), separators(*WHITE_SPACE), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, high, data, offsets in text_slices(batch.column(1), SLICE):
                view = Windows(hasher, between, data, offsets, width)
                if not len(view.place):
                    continue
                doc, start = ids[low:high][view.text], view.place - view.first[view.text]
                again = earlier(view.one[view.place], view.two[view.place], doc, start)
                runs = covered(doc[again], start[again])
                if len(runs[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *[pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in runs], pa.array([b""], pa.binary())], _PACK)
                left = np.flatnonzero(~again)
                place, doc, start = view.place[left], doc[left], start[left]
                least = minimisers(view.words, width, run)[place]
                common = np.isin(least, heavy)
                route = np.where(common, mixed(view.one[place]), mixed(least)) % np.uint64(buckets)
                # A super-k-mer: neighbouring windows of a text with the same minimiser (and so the same route).
                new = np.ones(len(place), bool)
                new[1:] = (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1]) | (least[1:] != least[:-1]) | (route[1:] != route[:-1]) | (view.text[left][1:] != view.text[left][:-1])
                heads = np.flatnonzero(new)
                count = np.diff(np.append(heads, len(place)))
                order = np.argsort(route[heads], kind="stable")
                heads, count = heads[order], count[order]
                goes = route[heads].astype(np.int64)
                begin = view.starts[place[heads]]
                end = view.ends[place[heads] + count - 1 + width - 1]
                whole = data.tobytes()
                cuts = np.append(np.flatnonzero(np.append(True, goes[1:] != goes[:-1])), len(goes))
                strings = [squeeze.compress(b"".join([whole[x:y] for x, y in zip(begin[a:b].tolist(), end[a:b].tolist())])) for a, b in zip(cuts, cuts[1:])]
                parts = [[x[a:b].astype(np.int64).tobytes() for a, b in zip(cuts, cuts[1:])] for x in (doc[heads], start[heads], end - begin)]
                yield pa.RecordBatch.from_arrays([pa.array(goes[cuts[:-1]], pa.int32()), *[pa.array(x, pa.binary()) for x in parts], pa.array(strings, pa.binary())], _PACK)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, between, expand = WordHasher(), separators(*WHITE_SPACE), zstandard.ZstdDecompressor()
        for group in whole_groups(batches, ["bucket"]):
            starts = group_starts(group, ["bucket"])
            for a, b in zip(starts, [*starts[1:], group.num_rows]):
                table = group.slice(a, b - a)
                if table.column("bucket")[0].as_py() < 0:
                    found = [tuple(np.frombuffer(table.column(c)[k].as_py(), np.int64) for c in ("docs", "starts", "sizes")) for k in range(table.num_rows)]
                    doc, start, size = (np.concatenate([x[c] for x in found]) for c in range(3))
                else:
                    seen = []
                    for k in range(table.num_rows):
                        docs_, begin, size = (np.frombuffer(table.column(c)[k].as_py(), np.int64) for c in ("docs", "starts", "sizes"))
                        data = np.frombuffer(expand.decompress(table.column("text")[k].as_py()), np.uint8)
                        view = Windows(hasher, between, data, np.append(0, np.cumsum(size)), width)
                        seen.append((view.one[view.place], view.two[view.place], docs_[view.text], begin[view.text] + view.place - view.first[view.text]))
                    one, two, doc, start = (np.concatenate([x[c] for x in seen]) for c in range(4))
                    again = earlier(one, two, doc, start)
                    doc, start, size = covered(doc[again], start[again])
                if len(doc):
                    order = np.argsort(doc, kind="stable")
                    doc, start, size = doc[order], start[order], size[order]
                    cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(doc[cuts[:-1]]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(start)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(size))], ["id", "starts", "sizes"])

    packs = source.mapInArrow(send, "bucket int, docs binary, starts binary, sizes binary, text binary")
    # What a slice settled by itself (bucket -1) is spread over all tasks.
    spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("docs"), F.lit(buckets)))
    dealt = packs.repartition(shuffle_partitions(spark), spread).sortWithinPartitions("bucket")
    runs = dealt.mapInArrow(sort, "id bigint, starts array<bigint>, sizes array<bigint>")
    return runs.groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("sizes")).alias("sizes"))


_PACK = ["bucket", "docs", "starts", "sizes", "text"]


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW, run: int = RUN) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept`` (the words that stay, joined by one space).

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, unchanged.  A word goes if a window of ``width`` words over it
    has an equal one that starts earlier: in a text with a smaller id, or in the same text.  Windows are judged on the
    input.  Null texts have no words; a null id counts as smaller than every other.  Rows that repeat id and text are
    the same text and treated alike; neither counts as earlier.
    """
    small_batches(docs.sparkSession)
    found = stored(repeated_words(docs, doc_id, text, width, run), "repeated-words")
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = separators(*WHITE_SPACE)
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(1)):
                starts, ends, first = word_bounds(data, offsets, between)
                gone = np.zeros(len(starts) + 1, np.int64)
                runs, sizes = batch.column(2).slice(low, high - low), batch.column(3).slice(low, high - low)
                each = np.diff(runs.offsets.to_numpy()) if runs.null_count == 0 else np.array([len(x) if x.is_valid else 0 for x in runs])
                at = np.repeat(first[:-1], each) + runs.flatten().to_numpy(zero_copy_only=False)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + sizes.flatten().to_numpy(zero_copy_only=False) + width - 1, -1)
                keep = np.cumsum(gone)[:-1] <= 0
                whole = data.tobytes()
                texts, removed = [], []
                for k in range(high - low):
                    mine = np.flatnonzero(keep[first[k]:first[k + 1]]) + first[k]
                    removed.append(int(first[k + 1] - first[k]) - len(mine))
                    texts.append(b" ".join([whole[x:y] for x, y in zip(starts[mine].tolist(), ends[mine].tolist())]).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(first).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=schema.names)

    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NULL_ID)).alias("id"), F.col(text).alias("text"))
    return source.join(found, "id", "left").select("doc_id", "text", "starts", "sizes").mapInArrow(cut, schema)
