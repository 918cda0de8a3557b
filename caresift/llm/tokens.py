"""Token-ID output in training order.

Texts are tokenised and packed: the ids of a task's documents, each closed by an end mark, form a stream that is cut
into sequences of equal length (only a task's last sequence is padded with end marks).  Sequences are numbered without
gaps, and a keyed Feistel permutation with cycle-walking gives each number a slot of the training order.  Slots are
dealt to shards by range; a shard is a headerless file of records of 2 * length bytes (little-endian 16-bit ids) in slot
order, closed by one newline byte.  Slot s is record s % per_shard of shard s // per_shard, so a reader can stop and go
on anywhere.  Reruns give the same files.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caresift.llm.common import fresh_folder, group_starts, mixed, small_batches, stored, whole_groups

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern by which the vocabulary's texts are cut before merging; a fixed value of this public tokeniser.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50_256
LENGTH = 512
PER_SHARD = 8_192
ROUNDS = 6
#: Compression of ids on their way: from this level on they come close to their entropy.
LEVEL = 6


def encoder(ranks: bytes):
    """A tokeniser from the bytes of a rank file (base64 token and rank per line)."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def permuted(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """A keyed bijection of 0 … total - 1: a Feistel network over the next even number of bits, walked back into range."""
    half = max(1, ((max(total - 1, 1)).bit_length() + 1) // 2)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def packed_sequences(docs: DataFrame, ranks: bytes, length: int, doc_id: str, text: str) -> DataFrame:
    """``task, number, ids, docs``: the sequences of each task's stream, and which documents lie where in them."""
    place = "array<struct<doc_id:bigint,from:int,at:int,n:int>>"
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("from", pa.int32()), ("at", pa.int32()), ("n", pa.int32())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, number = encoder(ranks), TaskContext.get().partitionId(), 0
        open_ids: list[np.ndarray] = []
        filled = 0
        spans: list[list[dict]] = [[]]
        done: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal spans, done, number
            batch = pa.RecordBatch.from_arrays([
                pa.array([task] * len(done), pa.int32()), pa.array(range(number, number + len(done)), pa.int64()), pa.array(done, pa.binary()), pa.array(spans[:len(done)], kind),
            ], ["task", "number", "ids", "docs"])
            number += len(done)
            spans, done = spans[len(done):] or [[]], []
            return batch

        for batch in batches:
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = np.append(own.encode_to_numpy(words.as_py() or "", disallowed_special=()), END).astype("<u2")
                at = 0
                while at < len(mine):
                    n = min(length - filled, len(mine) - at)
                    spans[-1].append({"doc_id": name, "from": at, "at": filled, "n": n})
                    open_ids.append(mine[at:at + n])
                    at, filled = at + n, filled + n
                    if filled == length:
                        done.append(b"".join(x.tobytes() for x in open_ids))
                        spans.append([])
                        open_ids, filled = [], 0
                if len(done) >= 2_048:
                    yield flush()
        if filled:
            done.append(b"".join(x.tobytes() for x in [*open_ids, np.full(length - filled, END, "<u2")]))
        if done:
            yield flush()

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(pack, f"task int, number bigint, ids binary, docs {place}")


@dataclass(frozen=True)
class TokenShards:
    """Where the shards are, and ``index``: one row per sequence with slot, shard, record and the documents in it."""

    folder: str
    sequences: int
    length: int
    per_shard: int
    index: DataFrame


def write_shards(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 20_240_501) -> TokenShards:
    """Tokenise, order and write ``docs``; see the module's text.

    Null texts count as empty: an end mark alone.  A null id is kept as null.  Repeated rows are written each.  An empty
    table gives no shard.  ``vocabulary`` is read on the driver and sent along; its ids must be below 65,536.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh_folder(spark, "token-shards")
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    sequences = stored(packed_sequences(docs, ranks, length, doc_id, text), "token-sequences", LEVEL)
    # One number per task of the scan: bounded by its tasks, not by the rows.
    counts = {r["task"]: r["n"] for r in sequences.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, base = 0, {}
    for task in sorted(counts):
        base[task] = total
        total += counts[task]

    def slots(task: np.ndarray, number: np.ndarray) -> np.ndarray:
        start = np.array([base[int(t)] for t in np.unique(task)])
        return permuted(start[np.searchsorted(np.unique(task), task)] + number, total, key)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            if not batch.num_rows:
                continue
            slot = slots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            ids = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(slot), 2 * length)
            order = np.argsort(slot)
            slot, ids = slot[order], ids[order]
            shard = slot // per_shard
            cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(slot))
            yield pa.RecordBatch.from_arrays([
                pa.array(shard[cuts[:-1]]), pa.array([slot[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([squeeze.compress(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.binary()),
            ], ["shard", "slots", "records"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for table in whole_groups(batches, ["shard"]):
            cuts = np.append(group_starts(table, ["shard"]), table.num_rows)
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = table.slice(a, b - a)
                shard = part.column("shard")[0].as_py()
                out = np.zeros((min(per_shard, total - shard * per_shard), 2 * length), np.uint8)
                for slot, records in zip(part.column("slots"), part.column("records")):
                    out[np.frombuffer(slot.as_py(), np.int64) - shard * per_shard] = np.frombuffer(expand.decompress(records.as_py()), np.uint8).reshape(-1, 2 * length)
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([out.tobytes()], pa.binary())], ["shard", "file"])

    blobs = sequences.select("task", "number", "ids").mapInArrow(deal, "shard bigint, slots binary, records binary")
    n_shards = -(-total // per_shard)
    if total:
        ordered = blobs.repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
        files = ordered.mapInArrow(write, "shard bigint, file binary")
        files.select("shard", F.col("file").cast("string").alias("value")).write.partitionBy("shard").mode("overwrite").text(folder)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                slot = slots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard), batch.column(2)], ["slot", "shard", "record", "docs"])

    index = sequences.select("task", "number", "docs").mapInArrow(number, f"slot bigint, shard bigint, record bigint, docs {sequences.schema['docs'].dataType.simpleString()}")
    return TokenShards(folder, total, length, per_shard, index)


def read_shards(spark: SparkSession, shards: TokenShards) -> DataFrame:
    """``slot, ids`` (binary) of every record, from the shard files."""
    if not shards.sequences:
        return spark.createDataFrame([], "slot bigint, ids binary")
    step, per_shard = 2 * shards.length, shards.per_shard

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                records = [data[k:k + step] for k in range(0, len(data) - 1, step)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(records)) + shard * per_shard), pa.array(records, pa.binary())], ["slot", "ids"])

    files = spark.read.format("binaryFile").load(shards.folder)
    return files.select(F.col("shard").cast("bigint").alias("shard"), "content").mapInArrow(cut, "slot bigint, ids binary")


def sequence_table(spark: SparkSession, shards: TokenShards) -> DataFrame:
    """One row per sequence, read back: ``slot, shard, record, n_docs, doc_ids, n_tokens`` and the digest of its ids."""
    read = read_shards(spark, shards).select("slot", F.sha2("ids", 256).alias("ids_sha256"))
    return shards.index.join(read, "slot").select(
        "slot", "shard", "record", F.size("docs").cast("bigint").alias("n_docs"), F.transform("docs", lambda d: d["doc_id"]).alias("doc_ids"),
        F.aggregate("docs", F.lit(0), lambda t, d: t + d["n"]).cast("bigint").alias("n_tokens"), "ids_sha256",
    )
