"""Mixing sources to target weights with soft membership.

A classifier learned from a labelled table gives every document a posterior over domains.  Nonnegative document rates r
are fitted so that the expected domain totals, the sum over documents of r * tokens * posterior, meet the targets: least
squares by projected gradient.  The gradient of a document is its posterior times the residuals of the domains, so one
iteration is one aggregation of as many sums as there are domains; the driver sees only these sums.  A rate is the fold
of its steps over the residuals so far, hence no iteration writes any state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caresift.llm.common import WHITE_SPACE, WordHasher, separators, small_batches, stored, text_slices, unused, word_bounds
from caresift.llm.toxicity import bounded_sample

HASH_BITS = 14


def word_numbers(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed number of every word, and the number of words of each text."""
    starts, ends, first = word_bounds(data, offsets, between)
    return (hasher(data, starts, ends) >> np.uint64(64 - HASH_BITS)).astype(np.int64), np.diff(first)


@dataclass(frozen=True)
class DomainModel:
    """Log probabilities of hashed words per domain, log priors, and the weight of the mean word against the prior."""

    domains: tuple[str, ...]
    words: np.ndarray
    prior: np.ndarray
    sharpness: float = 1.0

    def evidence(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean log probability of the words of each text, per domain (0 for texts without words)."""
        out = np.zeros((len(counts), len(self.domains)), np.float32)
        held = counts > 0
        if held.any():
            at = (np.cumsum(counts) - counts)[held]
            out[held] = np.add.reduceat(self.words[numbers], at, axis=0) / counts[held, None]
        return out

    def posterior(self, evidence: np.ndarray) -> np.ndarray:
        score = self.prior + self.sharpness * evidence
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)


def fit_domains(labelled: DataFrame, domains: list[str], text: str = "text", domain: str = "domain", key: str = "doc_id", max_rows: int = 20_000) -> DomainModel:
    """Naive Bayes on hashed words, its sharpness fitted to the labels, from at most about ``max_rows`` labelled rows.

    Rows of other domains, or with a null domain or key, are left out.  Without any row all domains are equally likely.
    """
    small_batches(labelled.sparkSession)
    names = sorted(set(domains))
    rows = labelled.where(F.col(domain).isin(names) & F.col(key).isNotNull())
    number = F.array_position(F.lit(names), F.col(domain)).cast("int") - 1
    sample = stored(bounded_sample(rows, key, max_rows).select(number.alias("domain"), F.coalesce(F.col(text), F.lit("")).alias("text")), "domain-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, between = WordHasher(), separators(*WHITE_SPACE)
        found = np.zeros(len(names) << HASH_BITS, np.int64)
        for batch in batches:
            label = batch.column("domain").to_numpy()
            for low, high, data, offsets in text_slices(batch.column("text")):
                numbers, counts = word_numbers(data, offsets, hasher, between)
                found += np.bincount((np.repeat(label[low:high], counts).astype(np.int64) << HASH_BITS) + numbers, minlength=len(found))
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], ["cell", "n"])

    cells = np.zeros(len(names) << HASH_BITS)
    for r in sample.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r["cell"]] = r["n"]
    per_domain = cells.reshape(len(names), -1)
    docs = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = np.log((np.array([docs.get(k, 0) for k in range(len(names))]) + 0.1) / (sum(docs.values()) + 0.1 * len(names)))
    common = (per_domain.sum(0) + 1) / (per_domain.sum() + per_domain.shape[1])
    smoothed = (per_domain + 100 * common) / (per_domain.sum(1, keepdims=True) + 100)
    start = DomainModel(tuple(names), np.ascontiguousarray(np.log(smoothed).T.astype(np.float32)), prior)
    if not docs:
        return start

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, between = WordHasher(), separators(*WHITE_SPACE)
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                evidence = start.evidence(*word_numbers(data, offsets, hasher, between))
                yield pa.RecordBatch.from_arrays([batch.column("domain").slice(low, high - low), pa.array([x.tobytes() for x in evidence], pa.binary())], ["domain", "evidence"])

    weighed = sample.mapInArrow(weigh, "domain int, evidence binary").toArrow()
    label = weighed.column("domain").to_numpy()
    evidence = np.stack([np.frombuffer(x.as_py(), np.float32) for x in weighed.column("evidence")])

    def loss(sharpness: float) -> float:
        model = DomainModel(start.domains, start.words, prior, sharpness)
        return float(-np.log(np.maximum(model.posterior(evidence)[np.arange(len(label)), label], 1e-12)).mean())

    best = min([float(2 ** (k / 2)) for k in range(0, 21)], key=loss)
    return DomainModel(start.domains, start.words, prior, best)


def posteriors(docs: DataFrame, model: DomainModel, text: str = "text", mix: Mix | None = None) -> DataFrame:
    """All rows and columns of ``docs`` but its text, plus ``n_tokens`` (words) and ``posterior`` (one share per domain).

    With a fitted ``mix`` also ``rate``, from the same pass.
    """
    added = [("n_tokens", T.LongType()), ("posterior", T.ArrayType(T.FloatType()))] + ([("rate", T.DoubleType())] if mix else [])
    kept = docs.drop(text, *[n for n, _ in added])
    width = len(kept.columns)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, t) for n, t in added]])
    n_domains = len(model.domains)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, between = WordHasher(), separators(*WHITE_SPACE)
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(width)):
                numbers, counts = word_numbers(data, offsets, hasher, between)
                share = model.posterior(model.evidence(numbers, counts)).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * n_domains), pa.array(share.ravel()))
                rates = [pa.array(rates_of(share.astype(np.float64), mix.steps, mix.least)[0])] if mix else []
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(low, high - low) for i in range(width)], pa.array(counts.astype(np.int64)), lists, *rates], names=schema.names)

    return docs.select(*kept.columns, F.col(text).alias(unused(kept, "_text"))).mapInArrow(judge, schema)


def _shares(batch: pa.RecordBatch, n_domains: int) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("posterior")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, n_domains), batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.float64)


def rates_of(share: np.ndarray, steps: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rates, extrapolated rates) after the given steps, starting at 1: accelerated projected gradient."""
    rate = np.full(len(share), max(1.0, least))
    ahead, momentum = rate, 1.0
    for step in steps:
        new = np.maximum(least, ahead - share @ step)
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + (momentum - 1) / grown * (new - rate)
        rate, momentum = new, grown
    return rate, ahead


@dataclass(frozen=True)
class Mix:
    """The fitted steps; ``expected`` and ``target`` are token totals per domain."""

    steps: list[np.ndarray]
    least: float
    expected: np.ndarray
    target: np.ndarray


def fit_rates(members: DataFrame, weights: np.ndarray, least: float = 0.0, keep_all: bool = False, tolerance: float = 1e-3, most: int = 40) -> Mix:
    """Fit rates of at least ``least`` so that the domain totals meet ``weights`` (shares that are made to sum to 1).

    The total is that of the corpus, or with ``keep_all`` the smallest at which no domain has to shrink.  Domains that
    no document may belong to are left out of the fit.  Ends when every domain is within ``tolerance`` of its target, or
    after ``most`` iterations: targets may be out of reach, and the rates are then those of the last iteration, which need not
    be the least squares yet.  ``expected`` and ``target`` of the result say how far they are.
    """
    n_domains = len(weights)

    def totals(steps: list[np.ndarray], with_square: bool) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * n_domains + n_domains * n_domains)
            for batch in batches:
                share, tokens = _shares(batch, n_domains)
                rate, ahead = rates_of(share, steps, least)
                total[:n_domains] += share.T @ (tokens * rate)
                total[n_domains:2 * n_domains] += share.T @ (tokens * ahead)
                if with_square:
                    total[2 * n_domains:] += ((share * tokens[:, None]).T @ share).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

        out = np.zeros(2 * n_domains + n_domains * n_domains)
        for r in members.mapInArrow(add, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r["k"]] = r["v"]
        return out

    now = totals([], True)
    plain, square = now[:n_domains] / max(1.0, least), now[2 * n_domains:].reshape(n_domains, n_domains)
    reached = plain > 1e-9 * max(plain.sum(), 1e-9)
    weights = np.where(reached, weights, 0.0)
    weights = weights / weights.sum() if weights.sum() > 0 else weights
    wanted = reached & (weights > 0)
    total = float((plain[wanted] / weights[wanted]).max()) if keep_all and wanted.any() else float(plain.sum())
    target = weights * total
    scale = np.where(reached, 1 / np.maximum(plain, 1e-9), 0.0)
    root = np.sqrt(scale)
    curve = float(np.linalg.eigvalsh(square * root[:, None] * root[None, :])[-1]) if reached.any() else 1.0
    steps: list[np.ndarray] = []
    while True:
        expected = now[:n_domains]
        off = np.abs(expected - target)[reached] / np.maximum(target[reached], 1e-3 * max(total, 1e-9))
        if not len(off) or off.max() <= tolerance or len(steps) >= most:
            return Mix(steps, least, expected, target)
        steps.append(scale * (now[n_domains:2 * n_domains] - target) / max(curve, 1e-9))
        now = totals(steps, False)


def with_rates(members: DataFrame, mix: Mix) -> DataFrame:
    """All rows and columns of ``members`` plus ``rate``."""
    schema = T.StructType([*members.schema.fields, T.StructField("rate", T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, _ = _shares(batch, len(mix.target))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates_of(share, mix.steps, mix.least)[0])], names=schema.names)

    return members.mapInArrow(rate, schema)


def copies(rate, key):
    """Whole copies for a rate: its floor, and one more with the chance of its fraction, decided by a hash of ``key``."""
    chance = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


#: Target shares of tokens by language and quality label; a language's tokens are to be nine parts good to one part poor.
LANGUAGE_SHARES = {"en": 0.52, "de": 0.17, "fr": 0.17, "es": 0.14}
TARGETS = {f"{lang}/{quality}": share * part for lang, share in LANGUAGE_SHARES.items() for quality, part in ((1, 0.9), (0, 0.1))}


def domain_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents with their domain, language and quality (the larger label where an id has several)."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.select("doc_id", "text", "lang").join(known, "doc_id").select("doc_id", "text", F.concat_ws("/", "lang", F.col("quality").cast("string")).alias("domain"))


def mixed_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, least: float = 0.0, keep_all: bool = False) -> tuple[DataFrame, DomainModel, Mix]:
    """Rows of ``doc_id, n_tokens, posterior, rate``, with the model and the fit.

    Null and empty texts have no tokens and the prior as posterior; they get a rate like any document.  Rows that repeat
    an id are rated each.
    """
    model = fit_domains(domain_rows(docs, labels), list(targets))
    members = stored(posteriors(docs.select("doc_id", "text"), model), "mix-members")
    mix = fit_rates(members, np.array([targets[d] for d in model.domains]), least, keep_all)
    return with_rates(members, mix), model, mix


def repeated_to_targets(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` with every row repeated as its rate says; rates are at least 1, so that no document is lost."""
    model = fit_domains(domain_rows(docs, labels), list(targets))
    members = stored(posteriors(docs.select("text"), model), "mix-members")
    mix = fit_rates(members, np.array([targets[d] for d in model.domains]), 1.0, True)
    judged = posteriors(docs.select(F.struct("*").alias("row"), "text"), model, "text", mix)
    times = F.greatest(copies(F.col("rate"), F.col("row.doc_id")), F.lit(1))
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select("row.*")
