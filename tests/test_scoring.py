import bisect
import random
import statistics

import pytest
from pyspark.sql import functions as F

from caresift.operators import agreement as G
from caresift.operators import failures
from caresift.operators import scoring as S
from caresift.plans import evaluation
from caresift.schemas import EVAL_EXAMPLE
from conftest import values


def test_rubric_score(spark):
    items = [("p", 7.0, True), ("p", 5.0, False), ("p", 10.0, True), ("p", -6.0, True), ("q", -1.0, True)]
    df = spark.createDataFrame(items, "example_id string, points double, criteria_met boolean")
    assert {r.example_id: r.score for r in S.example_scores(df, ["example_id"]).collect()} == {"p": 0.5, "q": None}


def test_metrics_of_graded_examples(spark):
    example = [("p1", [("user", "q")], [("c1", 7.0, ["axis:a"]), ("c2", 5.0, ["axis:b"]), ("c3", -6.0, ["axis:a", "axis:n"])], ["theme:x"], None)]
    grades = spark.createDataFrame([("p1", 0, True, "ok"), ("p1", 2, True, "no")], "prompt_id string, item_idx int, criteria_met boolean, explanation string")
    graded = evaluation.graded(spark.createDataFrame(example, EVAL_EXAMPLE), grades)
    rows, stats = evaluation.metrics(graded, ["prompt_id"])
    got = {r.metric: r.value for r in rows.collect()}
    assert got == {"overall_score": pytest.approx(1 / 12), "theme:x": pytest.approx(1 / 12), "axis:a": pytest.approx(1 / 7), "axis:b": 0.0}
    assert stats.where("metric = 'axis:b'").first().n_samples == 1


def test_bootstrap_is_close_to_the_standard_error(spark):
    r = random.Random(2)
    rows = [("m", min(1.0, max(0.0, r.gauss(0.5, 0.15)))) for _ in range(600)] + [("k", 0.25)] * 300 + [("k", 0.75)] * 300
    df = spark.createDataFrame(rows, "metric string, value double")
    one = {x.metric: x.bootstrap_std for x in S.bootstrap_std(df, [], 1000).collect()}
    for metric in "mk":
        vs = [v for m, v in rows if m == metric]
        assert one[metric] == pytest.approx(statistics.pstdev(vs) / len(vs) ** 0.5, rel=0.1)
    again = {x.metric: x.bootstrap_std for x in S.bootstrap_std(df.repartition(9), [], 1000).collect()}
    assert again == pytest.approx(one)


def test_agreement_fixture(spark):
    pairs = [(1, "a", True, [True, True, False]), (2, "a", False, [True, False]), (3, "b", True, [False])]
    counts = spark.createDataFrame([(e, c, s, sum(o), len(o) - sum(o)) for e, c, s, o in pairs], "example_id int, cluster string, label boolean, others_pos long, others_neg long")
    pr = G.precision_recall(counts)
    overall = {(r.metric, r.pred): (r.n, r.value) for r in pr.where("cluster is null").collect()}
    assert overall == {("precision", "pos"): (4, 0.5), ("precision", "neg"): (2, 0.5), ("recall", "pos"): (3, pytest.approx(2 / 3)), ("recall", "neg"): (3, pytest.approx(1 / 3))}
    f1 = {r.pred: r.value for r in G.f1_scores(pr, ["cluster"]).where("cluster is null").collect()}
    assert f1 == {"pos": pytest.approx(4 / 7), "neg": pytest.approx(0.4)}
    assert G.balanced(G.f1_scores(pr, ["cluster"]), ["cluster"]).where("cluster is null").first().value == pytest.approx((4 / 7 + 0.4) / 2)
    # cluster b has no agreeing negative prediction at all: no negative precision
    assert {(r.metric, r.pred) for r in pr.where("cluster = 'b'").collect()} == {("precision", "pos"), ("recall", "neg")}


def test_rater_counts_equal_pairs(spark):
    r = random.Random(4)
    labels = [(e, i, r.random() < 0.6, "xy"[e % 2]) for e in range(12) for i in range(r.randint(1, 6))]
    df = spark.createDataFrame(labels, "example_id int, rater_id int, label boolean, cluster string")
    expected = sorted((e, i, sum(l2 for e2, j, l2, _ in labels if e2 == e and j != i), sum(not l2 for e2, j, l2, _ in labels if e2 == e and j != i)) for e, i, _, _ in labels)
    assert values(G.rater_counts(df), "example_id", "rater_id", "others_pos", "others_neg") == expected


def test_percentile(spark):
    phys = spark.createDataFrame([("t", "a", 60.0, 0.5), ("t", "b", 60.0, 0.7), ("t", "c", 60.0, 0.6), ("t", "d", 10.0, 0.1)], "theme string, rater_id string, n double, value double")
    model = spark.createDataFrame([("t", 0.6)], "theme string, value double")
    got = G.model_percentile(phys, model).first()
    assert (got.physicians, got.percentile) == (3, 50.0)


def test_benchmark_metrics(spark):
    grades = spark.createDataFrame([("A",), ("A",), ("B",), ("C",)], "grade string")
    got = S.short_fact_metrics(grades).first()
    assert (got.is_correct, got.accuracy_given_attempted) == (0.5, pytest.approx(2 / 3)) and got.f1 == pytest.approx(2 * (2 / 3) * 0.5 / (2 / 3 + 0.5))
    passed = spark.range(1).select(S.pass_at_k(F.lit(5), F.lit(2), 2).alias("a"), S.pass_at_k(F.lit(5), F.lit(0), 2).alias("b"), S.pass_at_k(F.lit(3), F.lit(2), 2).alias("c")).first()
    assert (passed.a, passed.b, passed.c) == (pytest.approx(0.7), pytest.approx(0.0), 1.0)


def test_unified_score(spark):
    dims = ["answer_quality", "tool_selection", "retrieval_quality", "reasoning_trace", "self_correction"]
    rows = [("ok", d, 0.5) for d in dims] + [("short", d, 1.0) for d in dims[:-1]] + [("odd", d, 1.0) for d in dims + ["extra"]]
    got = {r.id: r for r in S.unified_scores(spark.createDataFrame(rows, "id string, dimension string, score double"), ["id"]).collect()}
    assert got["ok"].unified_score == pytest.approx(0.5)
    assert got["short"].unified_score is None and got["short"].missing == "self_correction"
    assert got["odd"].unified_score is None and got["odd"].unexpected == 1


def test_failures_and_patterns(spark):
    tags = [("t", f"e{i}", f"run_{i}") for i in range(5)] + [("g", "e", "run_1"), ("new", "e", "odd")]
    df = spark.createDataFrame(tags, "tag string, example_id string, run_id string")
    done = spark.createDataFrame([("g",)], "tag string")
    got = {r.tag: r for r in failures.pattern_counts(df, done).collect()}
    assert got["t"].ready and not got["g"].ready and not got["new"].ready and got["new"].last_run is None
    assert [r.tag for r in failures.stale_patterns(failures.pattern_counts(df, done), 21).collect()] == ["g"]
    assert failures.stale_patterns(failures.pattern_counts(df, done), 20).count() == 0
    merged = failures.merged_tags(df, spark.createDataFrame([("new", "t")], "new_tag string, existing_tag string"))
    known = spark.createDataFrame([("g", 4, False)], "tag string, cnt int, graduated boolean")
    s = failures.run_summary(merged, known).first()
    assert (s.failures_analyzed, s.new_tags, s.merged_tags, s.graduated) == (7, 1, 1, 2)


def test_merged_sketches_keep_their_rank_error(spark):
    from caresift.operators import analysis

    n = 60_000
    rows = spark.range(n).select((F.col("id") % 5).alias("day"), F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(0, "none", None), (1, "one", 7)], "day long, g string, v long"))
    days = analysis.quantile_sketches(rows, ["g", "day"], "v")
    got = {(r.g, r.q): (r.n, r.value) for r in analysis.sketched_quantiles(days, ["g"]).collect()}
    every = sorted(r.v for r in rows.where("g = 'g'").collect())
    assert {g for g, _ in got} == {"g", "one"} and got["one", 0.5] == (1, 7.0)
    for q in analysis.QUANTILES:
        count, value = got["g", q]
        assert count == n and abs(bisect.bisect_left(every, value) - q * n) <= 0.0035 * n + 1
    assert got["g", 0.0][1] == every[0] and got["g", 1.0][1] == every[-1]
