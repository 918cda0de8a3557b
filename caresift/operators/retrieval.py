"""Hybrid retrieval for a whole table of queries (JN-01, JN-03, JN-04, JN-06, LIM-01, WN-01/02, AG-38, FLT-06/08)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caresift import constants as K
from caresift.functions import text as X
from caresift.functions import weights as W
from caresift.functions.stemming import stem
from caresift.operators.sizes import checked_broadcast, parts_of
from caresift.session import cut_lineage, shared_dir

QUERY_BLOCK = 2_048
QUERY_BLOCK_BYTES = 64 * 1024 * 1024
#: So many postings are summed in one task.
POSTING_ROWS = 500_000
#: So many records are in one chunk, the most that one stem brings to a task.
CHUNK_RECORDS = 1_000_000
#: Bytes of text whose words are counted at once.
COUNTED_BYTES = 1 << 20
#: Bytes of text whose words are gathered in one block, and rows of a block that leave a task at once.
BLOCK_BYTES = 32 * 1024 * 1024
LISTED_ROWS = 1 << 15
HIT = ["query_id", "source_table", "record_id", "score"]
PAYLOAD = ["primary_category", "quality_tier", "chunk_text"]


def with_records(embeddings: DataFrame, records: DataFrame, keys: tuple[str, str] = ("source_table", "source_id")) -> DataFrame:
    """JN-01: embeddings with the category and tier of their record; keys are text on both sides already."""
    return embeddings.join(records, list(keys))


def best_per_query(hits: DataFrame, n: int, keys: list[str], score: str = "score", tie: tuple[str, ...] = ("source_table", "record_id"), rank: str = "rank") -> DataFrame:
    """WN-01/02: 1-based ranks and the best ``n``; tasks drop the rest of their rows before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(F.desc(score), *tie)
    return hits.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def list_top(hits: DataFrame, n: int = K.LIST_LENGTH) -> DataFrame:
    """OPT-4: top n per source table, then top n of the query, with its rank."""
    per_table = best_per_query(hits, n, ["query_id", "source_table"], rank="_t").drop("_t")
    return best_per_query(per_table, n, ["query_id"])


def _block_count(queries: DataFrame, embedding: str) -> int:
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(embedding)).alias("d")).first()
    rows = max(1, min(QUERY_BLOCK, QUERY_BLOCK_BYTES // max(1, 8 * (size.d or 1))))
    return -(-size.n // rows)


def semantic_hits(corpus: DataFrame, queries: DataFrame, n: int = K.LIST_LENGTH, embedding: str = "embedding") -> DataFrame:
    """JN-04: exact cosine search; ``(query_id, source_table, record_id, score)`` with the best ``n`` per query and table.

    ``corpus`` is ``(source_table, record_id, embedding)`` and is never shuffled or replicated: each task multiplies its
    Arrow batches with a block of query vectors and keeps only the best ``n`` per query and table, so no pair is ever
    written.  Query blocks are bounded (``QUERY_BLOCK`` rows and 64 MB); a larger query table is taken block by block,
    one corpus scan each, and a block's hits are written before the next block is fetched, so that the driver never
    holds more than one.  Similarities are rounded to 9 decimals and lie in 0 to 1 (opposite vectors: 0), so copies tie
    and ids decide.  Queries and records without a vector have no semantic hits.
    """
    has_vector = F.col(embedding).isNotNull() & (F.size(embedding) > 0)
    queries, corpus = queries.where(has_vector), corpus.where(has_vector)
    blocks = _block_count(queries, embedding)
    if blocks > 1:
        queries = cut_lineage(queries.select("query_id", embedding))
    id_type = queries.schema["query_id"].dataType.simpleString()
    rec_type = corpus.schema["record_id"].dataType.simpleString()
    schema = f"query_id {id_type}, source_table string, record_id {rec_type}, score double"
    parts = []
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", embedding).collect()
        if not mine:
            continue
        part = corpus.select("source_table", "record_id", embedding).mapInPandas(_scanner(mine, embedding, n), schema)
        parts.append(part if blocks == 1 else cut_lineage(part))
    if not parts:
        return corpus.sparkSession.createDataFrame([], schema)
    local = reduce(DataFrame.unionByName, parts)
    return best_per_query(local, n, ["query_id", "source_table"], rank="_r").drop("_r")


def _scanner(rows: list, embedding: str, n: int):
    ids = np.array([r.query_id for r in rows])
    wanted = np.array([r[embedding] for r in rows], dtype=np.float64)
    wanted /= np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-12)

    def best(names: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best n columns of each row of ``scores`` (rows: queries), smaller ids first among equals."""
        order = np.argsort(names, kind="stable")
        names, scores = names[order], scores[:, order]
        if len(names) > n:
            top = np.argsort(-scores, axis=1, kind="stable")[:, :n]
            return names[top], np.take_along_axis(scores, top, axis=1)
        return np.broadcast_to(names, scores.shape), scores

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for table, group in batch.groupby("source_table", sort=False):
                x = np.stack(group[embedding].to_numpy()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                names, scores = best(group["record_id"].to_numpy(), np.clip(np.round(wanted @ x.T, 9), 0.0, 1.0))
                if table in kept:
                    names = np.concatenate([kept[table][0], names], axis=1)
                    scores = np.concatenate([kept[table][1], scores], axis=1)
                    # ids differ per query here: order by id, then stably by score
                    by_id = np.argsort(names, axis=1, kind="stable")
                    names, scores = np.take_along_axis(names, by_id, 1), np.take_along_axis(scores, by_id, 1)
                    top = np.argsort(-scores, axis=1, kind="stable")[:, :n]
                    names, scores = np.take_along_axis(names, top, 1), np.take_along_axis(scores, top, 1)
                kept[table] = (names, scores)
        for table, (names, scores) in kept.items():
            yield pd.DataFrame({
                "query_id": np.repeat(ids, names.shape[1]), "source_table": table,
                "record_id": names.ravel(), "score": scores.ravel(),
            })

    return scan


@dataclass(frozen=True)
class Postings:
    """A written index: ``postings`` (source_table, record_id, stem, weight) and ``heads`` (stem, records, top), by bucket."""

    folder: str
    buckets: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("stem"), F.lit(buckets)).cast("int").alias("bucket")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _index_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"


def asked_stems(queries: DataFrame, stop_words: list[str] = K.STOP_WORDS) -> DataFrame:
    """``query_id, stem``: the distinct stems of each query's words that are no stop words."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    words = queries.select("query_id", F.explode_outer(F.array_except(F.array_distinct(X.words(F.col("text"))), stop)).alias("word"))
    return words.where(F.col("word").isNotNull()).select("query_id", stem("word").alias("stem")).distinct()


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch with a normalized text in its third column: the slice, its distinct words, the row, word and number of each pair of row and word, and the words of each row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.flatnonzero(np.diff((ends - 1) // COUNTED_BYTES, prepend=-2))
    for low, high in zip(starts, np.append(starts[1:], batch.num_rows)):
        part = batch.slice(low, high - low)
        # of white space, a normalized text has the six ASCII characters only
        split = pc.ascii_split_whitespace(part.column(2))
        flat, row = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy().astype(np.int64)
        held = pc.not_equal(flat, "")
        flat, row = flat.filter(held).dictionary_encode(), row[held.to_numpy(zero_copy_only=False)]
        width = max(1, len(flat.dictionary))
        both, tf = np.unique(row * width + flat.indices.to_numpy(), return_counts=True)
        yield part, flat.dictionary, both // width, both % width, tf, np.bincount(row, minlength=part.num_rows)


def _listed(block: list) -> Iterator[pa.RecordBatch]:
    """The counted slices of a block with a row for each word, and in it by chunk and table the records that have the word, how often, and how many words these have."""
    first = np.cumsum([0, *[part.num_rows for part, *_ in block]])
    table, record, chunk = (pa.concat_arrays([part.column(k) for part, *_ in block]) for k in (0, 1, 3))
    row = np.concatenate([x[2] + n for x, n in zip(block, first)])
    if not len(row):
        return
    words = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(x[3], pa.int32()), x[1]) for x in block]).unify_dictionaries()
    distinct, code = words.chunk(0).dictionary, np.concatenate([x.indices.to_numpy() for x in words.chunks]).astype(np.int64)
    tables = table.dictionary_encode(null_encoding="encode")
    groups, group = np.unique(chunk.to_numpy().astype(np.int64) * len(tables.dictionary) + tables.indices.to_numpy(), return_inverse=True)
    key = code * len(groups) + group[row]
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    at, row, ends = order[starts], row[order], pa.array(np.append(starts, len(order)), pa.int32())
    tf, length = np.concatenate([x[4] for x in block])[order], np.concatenate([x[5] for x in block])[row]
    lists = [pa.ListArray.from_arrays(ends, x) for x in (record.take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(length, pa.int32()))]
    head = pa.array(row[starts])
    groups = pa.StructArray.from_arrays([chunk.take(head), table.take(head), *lists], ["chunk", "source_table", "records", "tfs", "lens"])
    first = np.flatnonzero(np.diff(code[at], prepend=-1))
    word = distinct.take(pa.array(code[at][first]))
    every = pa.RecordBatch.from_arrays([word, pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), groups)], ["word", "groups"])
    for low in range(0, every.num_rows, LISTED_ROWS):
        yield every.slice(low, LISTED_ROWS)


def counted_words(corpus: DataFrame, chunks: int | None = None) -> DataFrame:
    """``source_table, record_id, word, tf, len``: how often a record has each word, and how many words it has.

    Words are counted in their row, by slices of an Arrow batch: no task holds more words than those of one slice.

    With ``chunks`` a row stands for a word and all records of a block of texts that have it: ``word, groups``, where a
    group is ``chunk, source_table, records, tfs, lens`` and chunk one of so many numbers that the records' keys are dealt
    to.  A task then holds the counts of one block.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, row, word, tf, length in _counted(batch):
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), words.take(pa.array(word)), pa.array(tf), pa.array(length[row]),
                ], schema.names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            for counted in _counted(batch):
                block.append(counted)
                size += counted[0].column(2).nbytes
                if size >= BLOCK_BYTES:
                    yield from _listed(block)
                    block, size = [], 0
        if block:
            yield from _listed(block)

    rows = corpus.select("source_table", "record_id", X.normalized(F.col("text")).alias("text"))
    table, record = rows.schema.fields[:2]
    word = T.StructField("word", T.StringType())
    if chunks is None:
        schema = T.StructType([table, record, word, T.StructField("tf", T.LongType()), T.StructField("len", T.LongType())])
        return rows.mapInArrow(count, schema)
    lists = [T.StructField(name, T.ArrayType(kind)) for name, kind in (("records", record.dataType), ("tfs", T.IntegerType()), ("lens", T.IntegerType()))]
    groups = T.StructType([T.StructField("chunk", T.IntegerType()), table, *lists])
    chunk = F.pmod(F.xxhash64("source_table", "record_id"), F.lit(chunks)).cast("int")
    return rows.withColumn("chunk", chunk).mapInArrow(gather, T.StructType([word, T.StructField("groups", T.ArrayType(groups))]))


def with_stems(held: DataFrame, stems: DataFrame) -> DataFrame:
    """Words of a table with their stems, where these are written; stems that are too many to broadcast are hashed by part, so that postings need no sort."""
    return held.join(checked_broadcast(stems, otherwise="shuffle_hash"), "word").select("source_table", "record_id", "stem", "weight")


def dealt_postings(words: DataFrame, parts: int, buckets: int) -> DataFrame:
    """``source_table, record_id, stem, weight, bucket`` from lists of records by stem (``chunk, source_table, stem, records, tfs, lens``).

    Lists are dealt once, a bucket in pieces, and only then become postings; what a record has in several lists is
    summed.  A piece holds about half a part, and of one stem at most the records of a chunk.
    """
    pieces = -(-2 * parts // buckets)
    piece = F.pmod(F.xxhash64("stem", "chunk"), F.lit(pieces))
    dealt = words.select(_bucket(buckets), piece.alias("piece"), "source_table", "stem", "records", "tfs", "lens").repartition(parts, "bucket", "piece")
    each = dealt.select("bucket", "piece", "source_table", "stem", F.inline_outer(F.arrays_zip("records", "tfs", "lens")).alias("record_id", "tf", "len"))
    weight = F.col("tf") / (1 + F.log(F.col("len").cast("double")))
    keys = ["source_table", "record_id", "stem"]
    return each.groupBy("bucket", "piece", *keys).agg(F.sum(weight).alias("weight")).select(*keys, "weight", "bucket")


def build_postings(corpus: DataFrame, folder: str | None = None, buckets: int = 64, stop_words: list[str] = K.STOP_WORDS, only: DataFrame | None = None) -> Postings:
    """Write the lexical index of ``corpus`` (``source_table, record_id, text``), by hash of the stem.

    A posting's weight is tf / (1 + ln(words in the record)); ``heads`` has each stem's number of records and its largest
    weight.  Words are stemmed once a block of texts, not once per occurrence.  With ``only`` (a column ``stem``) the
    index holds these stems alone.
    """
    spark = corpus.sparkSession
    folder = folder or _index_folder(spark)
    # by chunks of the records a frequent stem is dealt over several tasks
    listed = counted_words(corpus, parts_of(corpus, CHUNK_RECORDS)).where(~F.col("word").isin(stop_words))
    # Texts are split once, and written before stems are looked at: a join or filter on the stem would be pushed below it and compute it again.
    words = _written(listed.select(stem("word").alias("stem"), "groups").select("stem", F.inline_outer("groups")), f"{folder}/words")
    if only is not None:
        words = words.join(checked_broadcast(only.select("stem").distinct()), "stem", "left_semi")
    number = words.agg(F.sum(F.size("tfs"))).first()[0] or 0
    # dealt by their number, sorted so that the files are small
    postings = dealt_postings(words, max(1, -(-number // POSTING_ROWS)), buckets)
    index = Postings(folder, buckets)
    if not number:
        # partitioned folders of no rows have no files, hence no schema
        none = postings.limit(0)
        none.write.parquet(f"{folder}/postings")
        none.select("bucket", "stem", F.lit(0).cast("long").alias("records"), F.col("weight").alias("top")).write.parquet(f"{folder}/heads")
        return index
    postings.sortWithinPartitions("bucket", "stem", "source_table", "record_id").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings")
    held = index.table(spark, "postings")
    heads = held.groupBy("bucket", "stem").agg(F.count_if(F.col("weight") > 0).alias("records"), F.max("weight").alias("top"))
    heads.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{folder}/heads")
    return index


def search_postings(spark: SparkSession, index: Postings, queries: DataFrame, n: int | None = K.LIST_LENGTH, stop_words: list[str] = K.STOP_WORDS, asked: DataFrame | None = None) -> DataFrame:
    """Records that hold every stem of a query, best ``n`` per query and table, from a written index alone.

    Only buckets with an asked stem are read.  A query meets the records of its rarest stem.  Their weight for that
    stem and the largest weights of the others bound their score: the most promising are scored first, and of the
    rest only those whose bound reaches the n-th best score found.  Score: sum of weights, at most 1; ties go to the smaller id.
    """
    asked = _written(asked_stems(queries, stop_words), f"{_index_folder(spark)}/asked") if asked is None else asked
    stems = asked.select("stem").distinct()
    # at most as many numbers as there are buckets
    touched = [r.bucket for r in stems.select(_bucket(index.buckets)).distinct().collect()]
    wanted = checked_broadcast(stems)
    heads = index.table(spark, "heads").where(F.col("bucket").isin(touched)).join(wanted, "stem", "left_semi")
    postings = index.table(spark, "postings").where(F.col("bucket").isin(touched) & (F.col("weight") > 0)).join(wanted, "stem", "left_semi").drop("bucket")
    need = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    rarest = (
        asked.join(heads, "stem").groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("records", "stem", "top")).alias("r"), F.sum("top").alias("tops"))
        .join(need, "query_id").where(F.col("known") == F.col("need"))  # a stem that no record has rules the query out
        .select("query_id", "need", F.col("r.stem").alias("stem"), (F.col("tops") - F.col("r.top")).alias("others"))
    )
    candidates = postings.join(checked_broadcast(rarest), "stem").select(
        "query_id", "need", "source_table", "record_id", F.least(F.lit(1.0), F.round(F.col("weight") + F.col("others") + 1e-9, 9)).alias("bound"))

    def scored(some: DataFrame) -> DataFrame:
        # of the postings only those of the records to be scored travel
        theirs = postings.join(checked_broadcast(some.select("source_table", "record_id").distinct()), ["source_table", "record_id"], "left_semi")
        pairs = some.join(asked, "query_id").join(theirs, ["source_table", "record_id", "stem"])
        found = pairs.groupBy("query_id", "source_table", "record_id", "need").agg(F.count(F.lit(1)).alias("got"), F.sum("weight").alias("weight"))
        return found.where(F.col("got") == F.col("need")).select("query_id", "source_table", "record_id", F.round(F.least(F.lit(1.0), F.col("weight")), 9).alias("score"))

    if n is None:
        return scored(candidates)
    lists = ["query_id", "source_table"]
    folder = _index_folder(spark)
    candidates = _written(candidates, f"{folder}/candidates")
    order = Window.partitionBy(*lists).orderBy(F.desc("bound"), "record_id")
    first = _written(candidates.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= 4 * n), f"{folder}/first")
    best = _written(best_per_query(scored(first.drop("_p")), n, lists, rank="_r"), f"{folder}/best")
    # where n records are known, what lies behind the last one scored can only matter if its bound reaches the n-th
    floor = best.where(F.col("_r") == n).select(*lists, F.col("score").alias("floor"))
    last = first.where(F.col("_p") == 4 * n).select(*lists, F.col("bound").alias("seen"), F.col("record_id").alias("seen_id"))
    behind = (F.col("bound") < F.col("seen")) | ((F.col("bound") == F.col("seen")) & (F.col("record_id") > F.col("seen_id")))
    rest = _written(candidates.join(last, lists).where(behind).join(floor, lists, "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0.0))).select(candidates.columns), f"{folder}/rest")
    every = best.drop("_r") if rest.isEmpty() else best.drop("_r").unionByName(scored(rest))
    return best_per_query(every, n, lists, rank="_r").drop("_r")


def lexical_hits(corpus: DataFrame, queries: DataFrame, n: int | None = K.LIST_LENGTH, stop_words: list[str] = K.STOP_WORDS) -> DataFrame:
    """JN-03: records that contain every query word that is not a stop word, words compared by their stems.

    ``(query_id, source_table, record_id, score)`` with score the sum over the query's stems of tf / (1 + ln(words in
    the record)), at most 1.  ``corpus`` is ``(source_table, record_id, text)``, ``queries`` is ``(query_id, text)``.

    For one table of queries: the index written holds the asked stems only.  To search again and again, write all of
    it with ``build_postings`` and call ``search_postings``.
    """
    spark = corpus.sparkSession
    asked = _written(asked_stems(queries, stop_words), f"{_index_folder(spark)}/asked")
    return search_postings(spark, build_postings(corpus, buckets=8, stop_words=stop_words, only=asked), queries, n, stop_words, asked)


def fused(semantic: DataFrame, lexical: DataFrame, k: int, payload: tuple[str, ...] = ()) -> DataFrame:
    """JN-06, SET-02: Reciprocal Rank Fusion of two ranked lists in one shuffle; best ``k`` per query.

    A record missing from a list counts as rank 21.  Payload and relevance come from the semantic list when present.
    """
    def side(df: DataFrame, which: int) -> DataFrame:
        return df.select("query_id", "source_table", "record_id", F.lit(which).alias("side"), "rank", "score", *payload)

    both = side(semantic, 0).unionByName(side(lexical, 1))
    rank = lambda which: F.coalesce(F.min(F.when(F.col("side") == which, F.col("rank"))), F.lit(K.ABSENT_RANK))
    merged = both.groupBy("query_id", "source_table", "record_id").agg(
        rank(0).alias("sem_rank"), rank(1).alias("lex_rank"), F.min_by(F.struct("score", *payload), "side").alias("p")
    )
    scored = merged.select(
        "query_id", "source_table", "record_id", "sem_rank", "lex_rank",
        F.col("p.score").alias("relevance_score"), *[F.col(f"p.{c}").alias(c) for c in payload],
        (1.0 / (K.RRF_K + F.col("sem_rank")) + 1.0 / (K.RRF_K + F.col("lex_rank"))).alias("rrf_score"),
    )
    return best_per_query(scored, k, ["query_id"], score="rrf_score", rank="fused_rank")


def described(hits: DataFrame, records: DataFrame, how: str = "inner") -> DataFrame:
    """Fused hits with the columns of their records.  The few hits are written and meet the records where these lie, so no text is shuffled."""
    keys, held = ["source_table", "record_id"], cut_lineage(hits)
    found = records.join(checked_broadcast(held.select(*keys).distinct()), keys, "left_semi")
    return held.join(found, keys, how)


def reranked(hits: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """PRJ-27, LIM-01: graph weights of the query's plan applied to fused hits; best ``k`` per query."""
    weights = plan.select("query_id", F.col("category").alias("primary_category"), "weight", (F.col("bucket") == "must").alias("must"))
    scored = hits.join(weights, ["query_id", "primary_category"], "left").withColumn(
        "final_score", W.graph_rerank(F.col("rrf_score"), F.col("weight"), F.col("must"))
    )
    return best_per_query(scored, k, ["query_id"], score="final_score", rank="final_rank").drop("weight", "must")


def prefetch(k: int) -> int:
    """LIM-01, OPT-5: how many fused hits are re-ranked to return ``k``."""
    return min(3 * k, K.LIST_LENGTH)


def allowed_tables(hits: DataFrame, wanted: DataFrame, known: list[str]) -> DataFrame:
    """FLT-08: hits of the tables a query asks for; queries that name no known table keep all."""
    lists = wanted.select("query_id", F.filter("tables", lambda t: t.isin(known)).alias("_ts"))
    return (
        hits.join(lists, "query_id", "left")
        .where(F.coalesce(F.size("_ts") <= 0, F.lit(True)) | F.array_contains("_ts", F.col("source_table"))).drop("_ts")
    )


def relevant(hits: DataFrame, floor: float = K.MIN_RELEVANCE) -> DataFrame:
    """FLT-06: hits at or above the floor, or all hits of a query that has none there."""
    any_pass = hits.groupBy("query_id").agg(F.max("relevance_score").alias("_m"))
    return hits.join(any_pass, "query_id").where((F.col("relevance_score") >= floor) | (F.col("_m") < floor)).drop("_m")


def _weights(mapping: dict[str, float], key: Column, default: float) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def confidence(queries: DataFrame, hits: DataFrame, sources: dict[str, float] = K.SOURCE_WEIGHTS) -> DataFrame:
    """AG-38, CLS-15, PRJ-28: confidence, flags and disclaimer per query; queries without hits get 0.

    ``queries`` has ``query_id, category``.  Both versions of every average are kept in one aggregation — over the hits
    above the relevance floor and over all — so the floor rule needs no second pass.
    """
    from caresift.operators.classify import narrow_index_drug

    tier = _weights(K.TIER_WEIGHTS, F.col("quality_tier"), K.TIER_DEFAULT_WEIGHT)
    relevance = F.col("relevance_score") * _weights(sources, F.col("source_table"), 1.0)
    drug = narrow_index_drug(F.coalesce("chunk_text", F.lit("")))
    good = F.col("relevance_score") >= K.MIN_RELEVANCE

    # distinct tables per query: first per (query, table), then per query
    per_table = hits.groupBy("query_id", "source_table").agg(
        F.count_if(good).alias("n1"), F.count(F.lit(1)).alias("n0"),
        F.sum(F.when(good, tier)).alias("t1"), F.sum(tier).alias("t0"),
        F.sum(F.when(good, relevance)).alias("r1"), F.sum(relevance).alias("r0"),
        F.max(F.when(good, drug)).alias("d1"), F.max(drug).alias("d0"),
    )
    per_query = per_table.groupBy("query_id").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum("t1").alias("t1"), F.sum("t0").alias("t0"),
        F.sum("r1").alias("r1"), F.sum("r0").alias("r0"), F.max("d1").alias("d1"), F.max("d0").alias("d0"),
        F.count_if(F.col("n1") > 0).alias("u1"), F.count(F.lit(1)).alias("u0"),
    )
    pick = lambda a, b: F.when(F.col("n1") > 0, F.col(a)).otherwise(F.col(b))
    chosen = per_query.select(
        "query_id", pick("n1", "n0").alias("n"), pick("t1", "t0").alias("t"), pick("r1", "r0").alias("r"),
        pick("u1", "u0").alias("tables"), pick("d1", "d0").alias("drug"),
    )
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    tables = F.coalesce("tables", F.lit(0))
    raw = (
        0.5 * F.coalesce("t", F.lit(0.0)) / n + 0.5 * F.least(F.lit(1.0), F.coalesce("r", F.lit(0.0)) / n)
        + F.least(F.lit(0.10), 0.05 * (tables - 1))
    )
    meds = F.col("category") == K.MEDICATIONS
    scored = queries.join(chosen, "query_id", "left").withColumn(
        "confidence", F.when(meds & (tables < 2), F.least(X.clip01(raw), F.lit(0.80))).otherwise(X.clip01(raw))
    )
    return scored.select(
        *queries.columns, F.coalesce("n", F.lit(0)).alias("n_hits"), tables.alias("n_tables"), "confidence",
        (F.col("confidence") < 0.55).alias("uncertain"), (meds & F.coalesce("drug", F.lit(False))).alias("narrow_index"),
        W.disclaimer(F.col("confidence")).alias("disclaimer"),
    )


def citations(hits: DataFrame, order: str = "rank") -> DataFrame:
    """WN-05: first occurrence of each citation; presentation order by tier, then relevance."""
    others = [c for c in hits.columns if c not in ("query_id", "source_table", "record_id")]
    first = hits.groupBy("query_id", "source_table", "record_id").agg(F.min_by(F.struct(*others), order).alias("h"))
    table = F.create_map(*[F.lit(x) for pair in K.TIER_ORDER.items() for x in pair])
    out = first.select("query_id", "source_table", "record_id", "h.*").withColumn(
        "tier_order", F.coalesce(F.element_at(table, F.col("quality_tier")), F.lit(9))
    )
    window = Window.partitionBy("query_id").orderBy("tier_order", F.desc("relevance_score"), order)
    return out.withColumn("citation", F.row_number().over(window))
