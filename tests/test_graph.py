import pytest
from pyspark.sql import functions as F

from caresift import constants as K
from caresift.operators import graph as G
from caresift.schemas import PROFILE
from conftest import values

HORMONES, KIDNEY, HEART, EYES = "hormones_metabolism_nutrition", "kidney_urinary", "heart_blood_vessels", "eye_health"


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(f"cat:{HEART}", f"cat:{EYES}", "weak", 0.2), (f"cat:{HORMONES}", f"cat:{KIDNEY}", "strong", 0.5), (f"cat:{HORMONES}", f"sub:{HORMONES}:diabetes", "parent_child", 1.0),
            (f"sub:{HORMONES}:diabetes", f"cat:{HORMONES}", "parent_child", 1.0), (f"sub:{HORMONES}:diabetes", f"cat:{EYES}", "related", 0.6), (f"sub:{KIDNEY}:ckd", f"cat:{KIDNEY}", "parent_child", 1.0)]
    return spark.createDataFrame(rows, "src string, dst string, edge_type string, base_weight double").cache()


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame([
        ("a", 55, "male", "low", [("Diabetes", HORMONES, "diabetes", True), ("CKD", KIDNEY, "ckd", True), ("Old", "cancer", "x", False)], [("metformin", HORMONES), ("lisinopril", HEART)]),
        ("b", 25, "female", "high", [("Anxiety", "mental_health", "anxiety", True)], [("sertraline", "mental_health")]),
        ("c", 30, "other", "medium", [], []),
    ], PROFILE).cache()


def test_stages(spark, graph, profiles):
    anchors = G.anchored(profiles, graph)
    cats = [f"cat:{c}" for c in K.CATEGORIES]
    whole = spark.createDataFrame([(a, b) for a, b in zip(cats, cats[1:])], "src string, dst string")
    assert values(anchors, "user_id", "cat") == [("a", f"cat:{HORMONES}"), ("a", f"cat:{KIDNEY}")]
    assert values(G.anchor_boosts(anchors, graph), "user_id", "dst", "boost") == [("a", f"cat:{KIDNEY}", 0.30)]
    assert values(G.expand_boosts(anchors, graph), "dst", "boost") == [(f"cat:{EYES}", 0.15)]
    assert values(G.comorbidity_boosts(profiles, whole), "src", "dst", "boost") == sorted([
        (f"cat:{HORMONES}", f"cat:{HEART}", 0.20), (f"cat:{KIDNEY}", f"cat:{HEART}", 0.20), (f"cat:{HORMONES}", f"cat:{EYES}", 0.15)])
    demo = G.demographic_boosts(profiles, anchors, whole)
    a = [r for r in demo.collect() if r.user_id == "a"]
    # age 55: cancer, heart, bones, eyes; male: kidney; from two anchored categories, never to itself
    assert len(a) == 2 * 4 + 1
    assert len([r for r in demo.collect() if r.user_id == "b"]) == 19 * 2  # two rules, from all categories
    assert values(G.medication_boosts(profiles, whole), "user_id", "src", "boost")[:2] == [("a", f"cat:{HEART}", 0.10), ("a", f"cat:{HORMONES}", 0.10)]


def test_boosts_stay_inside_the_graph(spark, profiles):
    two = spark.createDataFrame([(f"cat:{HORMONES}", f"cat:{HEART}", "strong", 0.8)], "src string, dst string, edge_type string, base_weight double")
    anchors = spark.createDataFrame([], "user_id string, cat string, sub string, condition string")
    assert values(G.comorbidity_boosts(profiles, two), "src", "dst") == [(f"cat:{HORMONES}", f"cat:{HEART}")]
    demo = G.demographic_boosts(profiles, anchors, two).collect()
    assert demo and {r.src for r in demo} | {r.dst for r in demo} <= {f"cat:{HORMONES}", f"cat:{HEART}"}
    assert G.medication_boosts(profiles, two).count() == 0


def test_plan(spark, graph, profiles):
    queries = spark.createDataFrame([(1, "a", HEART), (2, "c", HEART), (3, "a", "unknown")], "query_id int, user_id string, primary_category string")
    history = spark.createDataFrame([("c", f"cat:{HEART}", f"cat:{EYES}", 5, "2024-01-01")], "user_id string, src string, dst string, cnt long, last_used string").withColumn("last_used", F.to_timestamp("last_used"))
    boosts = G.user_overlay(profiles, graph)
    plan = {(r.query_id, r.category): r for r in G.retrieval_plan(queries, graph, boosts, history, G.anchored(profiles, graph), F.lit("2024-03-31").cast("timestamp")).collect()}
    assert plan[2, EYES].weight == pytest.approx(0.2 + 0.4 * (1 - __import__("math").exp(0)) + 5 * 0.02 * 0.5, abs=0.2)
    assert plan[1, KIDNEY].bucket in ("may", None) and plan[1, KIDNEY].weight > 0.2  # promoted: no direct edge
    assert not [k for k in plan if k[0] == 3]


def test_history_counts_in_plan(spark, graph):
    users = spark.createDataFrame([("z", None, "other", "low", [], [])], PROFILE)
    queries = spark.createDataFrame([(1, "z", HEART)], "query_id int, user_id string, primary_category string")
    history = spark.createDataFrame([("z", f"cat:{HEART}", f"cat:{EYES}", 5, "2024-01-01")], "user_id string, src string, dst string, cnt long, last_used string").withColumn("last_used", F.to_timestamp("last_used"))
    plan = G.retrieval_plan(queries, graph, G.user_overlay(users, graph), history, G.anchored(users, graph), F.lit("2024-03-31").cast("timestamp")).collect()
    assert [(r.category, round(r.weight, 6)) for r in plan] == [(EYES, 0.25)]


def test_memory_and_adjustments(spark):
    plan = spark.createDataFrame([("u", "cancer", 0.5), ("u", HEART, 0.9)], "user_id string, category string, weight double")
    facts = spark.createDataFrame([("u", "cancer", False), ("u", "cancer", True), ("u", EYES, False), ("u", HEART, True), ("u", "", True)], "user_id string, category string, graduated boolean")
    assert [(c, round(w, 6)) for c, w in values(G.memory_weights(plan, facts, ["user_id"]), "category", "weight")] == [("cancer", 0.75), (EYES, 0.4), (HEART, 0.95)]
    moved = spark.createDataFrame([("u", "cancer", 0.95), ("u", "new", 0.9)], "user_id string, category string, proposed double")
    got = G.adjusted_weights(plan, moved, ["user_id"])
    assert {r.category: (r.weight, r.bucket) for r in got.collect()} == {"cancer": (0.8, "must"), HEART: (0.9, "must"), "new": (0.3, None)}


def test_profile_change_keeps_other_users(spark, graph, profiles):
    old = G.user_overlay(profiles, graph)
    changed = profiles.where("user_id = 'a'").withColumn("medications", F.filter("medications", lambda _: F.lit(False)))
    new = G.rebuilt_for(changed, graph, old)
    assert new.where("user_id = 'b'").count() == old.where("user_id = 'b'").count()
    assert new.where("user_id = 'a' and source_type = 'medication'").count() == 0
    assert set(K.CATEGORIES) >= {r.c for r in new.select(F.substring("src", 5, 50).alias("c")).where("not c like '%:%'").distinct().collect()}


def test_users_and_their_edges_are_dealt_by_their_number(spark, graph, profiles, monkeypatch):
    monkeypatch.setattr(G, "USER_ROWS", 1)
    monkeypatch.setattr(G, "PLAN_ROWS", 1)
    one = profiles.coalesce(1)
    boosts, anchors = G.user_overlay(one, graph), G.anchored(one, graph)
    assert "RoundRobinPartitioning(3)" in boosts._jdf.queryExecution().toString()
    assert values(boosts, "user_id", "src", "dst") == values(G.user_overlay(profiles, graph), "user_id", "src", "dst")
    queries = spark.range(9).select(F.col("id").alias("query_id"), F.element_at(F.array(F.lit("a"), F.lit("c"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("user_id"), F.lit(HEART).alias("primary_category"))
    history = spark.createDataFrame([("c", f"cat:{HEART}", f"cat:{EYES}", 5, "2024-01-01")], "user_id string, src string, dst string, cnt long, last_used string").withColumn("last_used", F.to_timestamp("last_used"))
    plan = G.retrieval_plan(queries, graph, boosts, history, anchors, F.lit("2024-03-31").cast("timestamp"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_NUM") >= 3 and ", 9), REPARTITION_BY_NUM" in text
    assert {r.query_id for r in plan.where(F.col("category") == EYES).collect()} == set(range(9))
