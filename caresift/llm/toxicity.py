"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of UTF-8 bytes of the lower-cased text (with a blank before and after it).
Its value is the log of how much more often it occurs in positive than in negative documents; logistic regression with
an L2 penalty is fitted on these values.  Document counts and the regression use a bounded sample of labelled rows
(``max_rows``); scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caresift.llm.common import small_batches, stored, text_slices, unused

GRAM_SIZES = (3, 4, 5, 6)
HASH_BITS = 20


@dataclass(frozen=True)
class ToxicityModel:
    """Non-zero weights (at most ``max_features``), each already multiplied with its log-count ratio, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    sizes: tuple[int, ...] = GRAM_SIZES
    bits: int = HASH_BITS

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        weights = np.zeros(1 << self.bits, np.float32)
        weights[self.index] = self.weight
        used = np.zeros(1 << self.bits, bool)
        used[self.index] = True
        return weights, used


def gram_numbers(data: np.ndarray, offsets: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash number of the n-gram at every byte of the slice, and which of them cross the end of their text."""
    count = len(data) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    value = np.full(count, size * 0x1000193, np.uint32)
    for k in range(size):
        value *= np.uint32(0x85EBCA6B)
        value += data[k:k + count]
        value ^= value >> np.uint32(15)
    value *= np.uint32(0xC2B2AE35)
    crossing = (offsets[1:-1, None] - np.arange(1, size)[None, :]).ravel()
    return value >> np.uint32(32 - bits), np.unique(crossing[(crossing >= 0) & (crossing < count)])


def present(data: np.ndarray, offsets: np.ndarray, used: np.ndarray | None, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of a slice, each once; only features in ``used`` if that is given."""
    pairs = []
    for size in sizes:
        number, crossing = gram_numbers(data, offsets, size, bits)
        if not len(number):
            continue
        take = used[number] if used is not None else np.ones(len(number), bool)
        take[crossing] = False
        at = np.flatnonzero(take)
        text = np.searchsorted(offsets, at, "right") - 1
        pairs.append(text << bits | number[at].astype(np.int64))
    found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return found >> bits, found & ((1 << bits) - 1)


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def bounded_sample(labelled: DataFrame, key: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows at most, chosen by the hash of their key: all of them when there are no more."""
    total = labelled.count()
    if total <= max_rows:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))


def fit_toxicity(
    labelled: DataFrame,
    text: str = "text",
    label: str = "label",
    key: str = "doc_id",
    max_rows: int = 20_000,
    max_features: int = 1 << 13,
    min_documents: int = 3,
    min_z: float = 3.3,
    penalty: float = 1e-4,
    steps: int = 120,
) -> ToxicityModel:
    """Fit on labelled rows (label 0 or 1; rows with a null label or key are left out).

    At most about ``max_rows`` rows are used, ``max_features`` n-grams are kept: those found in at least
    ``min_documents`` documents whose log-count ratio is at least ``min_z`` standard errors from 0, strongest first.
    Without rows of either label the model knows no n-gram and scores every text with the share of label 1.
    """
    small_batches(labelled.sparkSession)
    sizes, bits = GRAM_SIZES, HASH_BITS
    rows = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    sample = stored(bounded_sample(rows, key, max_rows).select(F.col(label).cast("int").alias("label"), padded(F.col(text)).alias("text")), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for low, high, data, offsets in text_slices(batch.column("text")):
                doc, feature = present(data, offsets, None, sizes, bits)
                positive = labels[low:high][doc] == 1
                found[1] += np.bincount(feature[positive], minlength=1 << bits)
                found[0] += np.bincount(feature[~positive], minlength=1 << bits)
        held = np.flatnonzero(found.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[1][held]), pa.array(found[0][held])], ["feature", "pos", "neg"])

    classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = classes.get(1, 0), sum(n for k, n in classes.items() if k != 1)
    none = ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log((n_pos + 0.5) / (n_neg + 1.0))))
    if not n_pos or not n_neg:
        return none

    pos, neg = F.sum("pos"), F.sum("neg")
    ratio = F.log((F.col("pos") + 1) / (n_pos + 2)) - F.log((F.col("neg") + 1) / (n_neg + 2))
    error = F.sqrt(1 / (F.col("pos") + 1) + 1 / (F.col("neg") + 1))
    kept = (
        sample.mapInArrow(count, "feature bigint, pos bigint, neg bigint")
        .groupBy("feature").agg(pos.alias("pos"), neg.alias("neg"))
        .where(F.col("pos") + F.col("neg") >= min_documents)
        .select("feature", ratio.alias("ratio"), F.abs(ratio / error).alias("z"))
        .where(F.col("z") >= min_z)
        .orderBy(F.desc("z"), "feature").limit(max_features)
        .collect()
    )
    if not kept:
        return none
    kept.sort(key=lambda r: r["feature"])
    index = np.array([r["feature"] for r in kept], np.int64)
    ratios = np.array([r["ratio"] for r in kept])
    used = np.zeros(1 << bits, bool)
    used[index] = True

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                doc, feature = present(data, offsets, used, sizes, bits)
                cuts = np.searchsorted(doc, np.arange(high - low + 1))
                packed = [feature[cuts[i]:cuts[i + 1]].astype(np.int32).tobytes() for i in range(high - low)]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(low, high - low), pa.array(packed, pa.binary())], ["label", "features"])

    collected = sample.mapInArrow(features, "label int, features binary").toArrow()
    lists = [np.frombuffer(x.as_py(), np.int32) for x in collected.column("features")]
    target = (collected.column("label").to_numpy() == 1).astype(np.float64)
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = np.searchsorted(index, np.concatenate(lists)) if len(doc) else np.zeros(0, np.int64)
    weight, bias = logistic(doc, column, ratios[column], target, len(index), penalty, steps)
    return ToxicityModel(index, weight * ratios, bias)


def logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray, width: int, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the penalised mean log loss of a sparse matrix; returns weights and bias."""
    n = len(target)

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * w[column], n)

    def back(g: np.ndarray) -> np.ndarray:
        return np.bincount(column, value * g[row], width)

    # Largest eigenvalue of the (bias-extended) second moment, by power iteration, bounds the curvature.
    v, vb, size = np.ones(width), 1.0, 1.0
    for _ in range(20):
        u = times(v) + vb
        v, vb = back(u) / n, u.mean()
        size = float(np.sqrt(v @ v + vb * vb)) or 1.0
        v, vb = v / size, vb / size
    step = 1.0 / (0.25 * size * 1.2 + penalty)
    w, b, at, at_b, momentum = np.zeros(width), 0.0, np.zeros(width), 0.0, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(at) + at_b, -40, 40)))
        g = (p - target) / n
        new, new_b = at - step * (back(g) + penalty * at), at_b - step * float(g.sum())
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        at, at_b = new + (momentum - 1) / grown * (new - w), new_b + (momentum - 1) / grown * (new_b - b)
        w, b, momentum = new, new_b, grown
    return w, b


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null texts are scored as empty ones: by the bias alone.  Columns of these two names are replaced.
    """
    small_batches(docs.sparkSession)
    source = docs.drop("score", "predicted")
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    n_columns = len(source.columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, used = model.table()
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for low, high, data, offsets in text_slices(batch.column(n_columns)):
                doc, feature = present(data, offsets, used, model.sizes, model.bits)
                scores[low:high] = np.bincount(doc, weights[feature], high - low)
            scores = 1 / (1 + np.exp(-np.clip(scores + model.bias, -40, 40)))
            columns = [batch.column(i) for i in range(n_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=schema.names)

    return source.withColumn(unused(source, "_padded"), padded(F.col(text))).mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; rows without an id are not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a toxicity label outside the held-out fold (the largest label where an id has several)."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return docs.select("doc_id", "text").join(known, "doc_id")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that a model learned from the labelled ones among them does not reject."""
    model = fit_toxicity(training_rows(docs, labels))
    return score_toxicity(docs, model).where(F.col("predicted") == 0).select(*docs.columns)
