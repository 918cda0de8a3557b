"""Hot groups take another road to the same numbers; brute force says which numbers."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caresift.operators import analysis as A
from caresift.operators import ordered as O
from caresift.operators import sampling
from conftest import values


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(3)
    # one prompt holds a third of all rows
    rows = [(m, p, r.choice([0.1, 0.2, 0.3, 0.5, 0.8, r.random()]), r.randint(0, 60)) for p, n in [(0, 9), (1, 3), (2, 3), (3, 3)] for m in "abc" for _ in range(n)]
    return rows, spark.createDataFrame(rows, "model string, prompt_id int, score double, length long").cache()


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_running_before(spark, hot_rows):
    rows = [(k, i, (i * 7) % 5) for k, n in (("x", 40), ("y", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, o int, v long").repartition(5)
    got = O.running_before(df, ["k"], ["o"], {"b": "v"}, hot_rows)
    expected = sorted((k, o, sum(v2 for k2, o2, v2 in rows if k2 == k and o2 < o)) for k, o, _ in rows)
    assert values(got, "k", "o", "b") == expected
    assert values(O.numbered(df, ["k", "o"], hot_rows=hot_rows), "k", "o", "row_idx") == [(k, o, i) for i, (k, o, _) in enumerate(sorted(rows))]


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_quantiles_and_mid_ranks(spark, hot_rows):
    r = random.Random(1)
    data = {g: [r.randint(0, 9) for _ in range(n)] for g, n in (("a", 31), ("b", 4))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v int")
    got = {(x.g, x.q): x.value for x in O.exact_quantiles(df, ["g"], "v", A.QUANTILES, hot_rows).collect()}
    for g, vs in data.items():
        for q in A.QUANTILES:
            assert got[g, q] == pytest.approx(np.quantile(vs, q))
    ranks = {(x.g, x.v): x.r for x in O.mid_ranks(df, ["g"], "v", "r", hot_rows).collect()}
    for g, vs in data.items():
        for v in vs:
            assert ranks[g, v] == sum(w < v for w in vs) + (sum(w == v for w in vs) + 1) / 2


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_worst_at_k(spark, samples, hot_rows):
    rows, df = samples
    got = {(r.model, r.prompt_id, r.k): r.value for r in A.worst_at_k(df, [1, 2, 3, 5], hot_rows=hot_rows).collect()}
    for m in "abc":
        for p in range(4):
            scores = [s for m2, p2, s, _ in rows if (m2, p2) == (m, p)]
            for k in (1, 2, 3, 5):
                if k <= len(scores):
                    subsets = list(itertools.combinations(scores, k))
                    assert got.pop((m, p, k)) == pytest.approx(sum(map(min, subsets)) / len(subsets))
    assert not got


def test_worst_at_k_fixture(spark):
    df = spark.createDataFrame([("m", 1, s) for s in (0.3, 0.9, 0.1, 0.5, 0.5)], "model string, prompt_id int, score double")
    got = {r.k: r.value for r in A.worst_at_k(df, [1, 2, 3, 5]).collect()}
    assert got == {1: pytest.approx(0.46), 2: pytest.approx(0.28), 3: pytest.approx(0.20), 5: pytest.approx(0.10)}


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
@pytest.mark.parametrize("limit", [None, 0.1, 0.4])
def test_wins(spark, samples, hot_rows, limit):
    rows, df = samples
    got = A.wins(df, hot_rows=hot_rows) if limit is None else A.length_controlled_wins(df, limit, hot_rows=hot_rows)
    expected = {}
    for (ma, pa, sa, la), (mb, pb, sb, lb) in itertools.product(rows, rows):
        if pa != pb or sa <= sb:
            continue
        if limit is not None and (la == 0 or lb == 0 or abs(la - lb) / ((la + lb) / 2) > limit):
            continue
        expected[pa, ma, mb] = expected.get((pa, ma, mb), 0) + 1
    assert {(r.prompt_id, r.model_a, r.model_b): r.wins for r in got.collect()} == expected
    rates = {(r.model_a, r.model_b): r.win_rate for r in A.win_rates(got).collect()}
    for (a, b), rate in rates.items():
        shares = []
        for p in range(4):
            won, lost = expected.get((p, a, b), 0), expected.get((p, b, a), 0)
            if won + lost:
                shares.append(won / (won + lost))
        assert rate == pytest.approx(sum(shares) / len(shares))


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
@pytest.mark.parametrize("limit", [None, 0.4])
def test_null_prompts_and_models_are_groups(spark, hot_rows, limit):
    r = random.Random(9)
    rows = [(m, p, r.choice([None, 0.1, 0.5, 0.9]), r.choice([None, 10, 12, 30])) for p in (None, 1) for m in (None, "a", "b") for _ in range(5)]
    df = spark.createDataFrame(rows, "model string, prompt_id int, score double, length long")
    got = A.wins(df, hot_rows=hot_rows) if limit is None else A.length_controlled_wins(df, limit, hot_rows=hot_rows)
    expected = {}
    for (ma, pa, sa, la), (mb, pb, sb, lb) in itertools.product(rows, rows):
        if pa != pb or sa is None or sb is None or sa <= sb or (limit is not None and (la is None or lb is None or abs(la - lb) / ((la + lb) / 2) > limit)):
            continue
        expected[pa, ma, mb] = expected.get((pa, ma, mb), 0) + 1
    assert {(r.prompt_id, r.model_a, r.model_b): r.wins for r in got.collect()} == expected
    assert {(r.model_a, r.model_b) for r in A.win_shrinkage(A.win_rates(got), A.win_rates(got)).collect()} == {k[1:] for k in expected} | {k[:0:-1] for k in expected}


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_correlations(spark, samples, hot_rows):
    rows, df = samples
    for r in A.correlations(df, "length", "score", hot_rows=hot_rows).collect():
        x = np.array([l for m, _, _, l in rows if m == r.model], float)
        y = np.array([s for m, _, s, _ in rows if m == r.model])
        slope, intercept = np.polyfit(x, y, 1)
        assert (r.pearson, r.slope, r.intercept) == (pytest.approx(np.corrcoef(x, y)[0, 1]), pytest.approx(slope), pytest.approx(intercept))


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_long_frontier(spark, hot_rows):
    r = random.Random(9)
    rows = [(g, i, r.random() + i / 300) for g, n in (("a", 90), ("b", 2)) for i in range(n)]
    expected, best = [], {}
    for g, i, v in rows:
        if v > best.get(g, -1):
            best[g] = v
            expected.append((g, i))
    got = O.running_max_frontier(spark.createDataFrame(rows, "g string, d int, v double"), ["g"], "d", "v", hot_rows=hot_rows)
    assert values(got, "g", "d") == sorted(expected)


def test_frontier(spark):
    rows = [(1, 0.5, "a"), (1, 0.7, "b"), (2, 0.7, "c"), (3, 0.6, "d"), (4, 0.9, "e")]
    df = spark.createDataFrame(rows, "cost int, score double, model string")
    assert values(A.cost_frontier(df), "cost", "score", "model") == [(1, 0.7, "b"), (4, 0.9, "e")]


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_spread_pages(spark, hot_rows):
    got = sampling.spread_pages(spark.range(100), ["id"], 4, 3, hot_rows)
    assert [r.id for r in got.orderBy("id").collect()] == [0, 1, 2, 25, 26, 27, 50, 51, 52, 75, 76, 77]


def test_seeded_samples(spark):
    a = {r.id for r in sampling.seeded_sample(spark.range(50), 10, "id", 1).collect()}
    b = {r.id for r in sampling.seeded_sample(spark.range(50).repartition(7), 10, "id", 1).collect()}
    assert a == b and len(a) == 10 and a != {r.id for r in sampling.seeded_sample(spark.range(50), 10, "id", 2).collect()}
    shots = sampling.companions(spark.range(5), spark.range(100).withColumnRenamed("id", "t"), 3, "id", "t")
    assert shots.groupBy("id").agg(F.countDistinct("train_id").alias("n")).where("n = 3").count() == 5
    many = sampling.companions(spark.range(3_000), spark.range(10).withColumnRenamed("id", "t"), 3, "id", "t")
    assert many.select("train_id").distinct().count() == 10  # every row can be drawn
    assert sampling.companions(spark.range(5), spark.range(2).withColumnRenamed("id", "t"), 3, "id", "t").count() == 10


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_page(spark, hot_rows):
    got = sampling.page(spark.range(100).repartition(5), ["id"], 40, 7, hot_rows)
    assert sorted(r.id for r in got.collect()) == list(range(40, 47))


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_null_groups_keep_their_values(spark, hot_rows):
    df = spark.createDataFrame([(None, float(k)) for k in range(9)] + [("a", 1.0), ("a", 3.0)], "g string, v double")
    got = {(r.g, r.q): r.value for r in O.exact_quantiles(df, ["g"], "v", [0.5], hot_rows).collect()}
    assert got == {(None, 0.5): 4.0, ("a", 0.5): 2.0}
    assert O.mid_ranks(df, ["g"], "v", "r", hot_rows).where("g IS NULL").count() == 9


@pytest.mark.parametrize("limit", [None, 0.4])
def test_small_prompts_are_shuffled_once_and_large_ones_are_counted(spark, limit):
    r = random.Random(4)
    rows = [(r.choice("abc"), p, r.randint(0, 6) / 7, r.choice([8, 10, 11, 30])) for p in (1, 1, 2, 3, 3, 3, 3, 4) for _ in range(5)]
    df = spark.createDataFrame(rows, "model string, prompt_id int, score double, length long")
    won = (lambda **k: A.wins(df, **k)) if limit is None else (lambda **k: A.length_controlled_wins(df, limit, **k))
    expected = {}
    for (ma, pa, sa, la), (mb, pb, sb, lb) in itertools.product(rows, rows):
        if pa == pb and sa > sb and (limit is None or abs(la - lb) / ((la + lb) / 2) <= limit):
            expected[pa, ma, mb] = expected.get((pa, ma, mb), 0) + 1
    for pair_rows in (0, 7, 10, 64):
        assert {(x.prompt_id, x.model_a, x.model_b): x.wins for x in won(pair_rows=pair_rows).collect()} == expected
    plan = A.win_rates(won())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(prompt_id") == 1  # samples, once; levels, blocks and opponents are not written
