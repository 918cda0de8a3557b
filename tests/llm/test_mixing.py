import numpy as np
import pytest
from pyspark.sql import functions as F

from caresift.llm import mixing


def reference_rates(share, tokens, target, least):
    """Plain projected gradient in the token-weighted metric, run to the end."""
    plain = share.T @ tokens
    root = 1 / np.sqrt(plain)
    curve = np.linalg.eigvalsh(((share * tokens[:, None]).T @ share) * root[:, None] * root[None, :])[-1]
    rate = np.full(len(share), max(1.0, least))
    for _ in range(20_000):
        rate = np.maximum(least, rate - share @ ((share.T @ (tokens * rate) - target) / plain / curve))
    return rate


@pytest.mark.parametrize("least, keep_all", [(0.0, False), (1.0, True)])
def test_rates_meet_targets(spark, least, keep_all):
    rng = np.random.default_rng(2)
    share = rng.dirichlet([0.3, 0.2, 0.6], 300).astype(np.float32)
    tokens = rng.integers(1, 500, 300)
    df = spark.createDataFrame([(i, int(n), [float(x) for x in s]) for i, (n, s) in enumerate(zip(tokens, share))], "doc_id long, n_tokens long, posterior array<float>").repartition(4)
    weights = np.array([0.45, 0.2, 0.35])
    mix = mixing.fit_rates(df, weights, least, keep_all, tolerance=1e-4, most=200)
    rates = {r.doc_id: r.rate for r in mixing.with_rates(df, mix).collect()}
    rate = np.array([rates[i] for i in range(300)])
    reached = share.astype(float).T @ (tokens * rate)
    assert rate.min() >= least and np.allclose(reached, mix.expected, rtol=1e-6)
    best = reference_rates(share.astype(float), tokens.astype(float), mix.target, least)
    wanted = share.astype(float).T @ (tokens * best)
    assert np.abs(reached - wanted).max() <= 0.01 * mix.target.max()
    if not keep_all:
        assert np.allclose(reached, mix.target, rtol=1e-3) and np.isclose(mix.target.sum(), tokens.sum(), rtol=1e-5)


def labelled(spark):
    rows = []
    for i in range(60):
        rows.append((i, ("der hund und die katze " if i % 2 else "the dog and the cat ") * (1 + i % 5), "de/1" if i % 2 else "en/1"))
    return spark.createDataFrame(rows + [(None, "the", "en/1"), (99, "the", None), (98, "el", "es/1"), (97, None, "en/1")], "doc_id long, text string, domain string")


def test_posteriors(spark):
    model = mixing.fit_domains(labelled(spark), ["en/1", "de/1"])
    assert model.domains == ("de/1", "en/1")
    docs = spark.createDataFrame([(1, "die katze", "x"), (2, "the cat", "x"), (3, None, "x"), (4, "", "x"), (2, "the cat", "x"), (None, "dog", "x")], "doc_id long, text string, n_tokens string")
    rows = mixing.posteriors(docs, model).collect()
    assert len(rows) == 6 and all(abs(sum(r.posterior) - 1) < 1e-5 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].posterior[0] > 0.9 and by_id[2].posterior[1] > 0.9 and by_id[None].posterior[1] > 0.6
    assert by_id[3].posterior == by_id[4].posterior and (by_id[3].n_tokens, by_id[1].n_tokens) == (0, 2)


def test_nothing_labelled_and_empty(spark):
    model = mixing.fit_domains(labelled(spark).limit(0), ["a", "b"])
    docs = spark.createDataFrame([(1, "x y"), (2, "z")], "doc_id long, text string")
    members = mixing.posteriors(docs, model)
    assert [r.posterior for r in members.collect()] == [[0.5, 0.5]] * 2
    mix = mixing.fit_rates(members, np.array([0.5, 0.5]))
    assert [round(r.rate, 6) for r in mixing.with_rates(members, mix).collect()] == [1.0, 1.0]
    none = mixing.posteriors(docs.limit(0), model)
    assert mixing.with_rates(none, mixing.fit_rates(none, np.array([0.5, 0.5]))).count() == 0


def test_copies(spark):
    df = spark.range(20_000).select("id", mixing.copies(F.lit(1.3), F.col("id")).alias("n"))
    assert {r.n for r in df.distinct().select("n").collect()} == {1, 2}
    assert abs(df.agg(F.avg("n")).first()[0] - 1.3) < 0.02


def test_every_document_stays(spark):
    docs = labelled(spark).select("doc_id", "text", F.substring("domain", 1, 2).alias("lang"), F.lit("x").alias("rate"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    out = mixing.repeated_to_targets(docs, labels, {"en/1": 0.8, "de/1": 0.2})
    assert out.columns == docs.columns
    got = {tuple(r) for r in out.collect()}
    assert got == {tuple(r) for r in docs.collect()}
    n = out.groupBy("lang").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert dict((r.lang, r.n) for r in n)["en"] > 2.5 * dict((r.lang, r.n) for r in n)["de"]
