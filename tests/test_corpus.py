from pyspark.sql import functions as F

from caresift import schemas as S
from caresift.functions.rules import rule_set
from caresift.operators import categorize as C
from caresift.plans import corpus as P
from conftest import values

RULES = {
    "topic": rule_set([(["cardio"], "heart_blood_vessels"), (["c.n.s"], "brain_nervous_system")]),
    "question": rule_set([(["heart", "stent"], "heart_blood_vessels"), (["tumor"], "cancer"), (["tooth"], "dental_oral")]),
    "pharmacology": rule_set([(["diuretic"], "kidney_urinary"), (["nsaid"], "medications_drug_safety")]),
    "mesh": rule_set([(["cardiac", "heart"], "heart_blood_vessels"), (["neoplasm"], "cancer")]),
}


def exam(spark, *rows):
    full = [(str(i), q, "w", "x", "y", "z", 1, e, s, t) for i, (s, t, q, e) in enumerate(rows)]
    return spark.createDataFrame(full, S.MCQ)


def test_exam_branches(spark):
    rows = exam(
        spark,
        ("Dental", "x", "a tumor near the heart", None), ("Dental", None, "the tooth", None),
        ("Pharmacology", "Diuretics", "q", None), ("Pharmacology", None, "which NSAID", None), ("Pharmacology", "x", "none", None),
        ("Medicine", "Cardiology", "q", None), ("Medicine", None, "a tooth and a tumor", None), ("Surgery", None, "q", None), ("Odd", None, "q", None),
        ("Medicine", "cardio", "metastasis", None),
    )
    got = C.categorize_mcq(rows, RULES["topic"], RULES["question"], RULES["pharmacology"]).orderBy(F.col("id").cast("int")).collect()
    assert [(r.primary_category, r.secondary_category) for r in got] == [
        ("dental_oral", "heart_blood_vessels"), ("dental_oral", None), ("kidney_urinary", "medications_drug_safety"),
        ("medications_drug_safety", "medications_drug_safety"), ("medications_drug_safety", None), ("heart_blood_vessels", None),
        ("cancer", None), ("digestive_liver", None), ("medications_drug_safety", None), ("heart_blood_vessels", "cancer"),
    ]


def test_literature_scores(spark):
    rows = spark.createDataFrame(
        [(1, "heart", "a", "y", ([], [], ["Cardiac Output", "Heart Failure"])), (2, "tumor", "a", "y", ([], [], ["Heart"])), (3, "q", "a", "y", ([], [], [])),
         (4, "heart tumor", "a", "y", ([], [], [])), (5, "tumor tooth", "a", "y", ([], [], ["Cardiac", "heart"]))],
        S.LITERATURE.replace("question string, long_answer string, final_decision string", "question string, long_answer string, final_decision string"))
    got = {r.pubid: (r.primary_category, r.secondary_category) for r in C.categorize_literature(rows, RULES["mesh"], RULES["question"]).collect()}
    assert got == {
        1: ("heart_blood_vessels", None), 2: ("cancer", None), 3: ("medications_drug_safety", None), 4: ("heart_blood_vessels", "cancer"),
        5: ("heart_blood_vessels", "cancer"),  # three categories with two points: the first scored wins
    }


def test_explanation_tiers(spark):
    texts = [None, "null", "Harrison 18th ed page 12", "Ans. b", "short", "This explains the mechanism of the disease at some length.", "Answer: it is the one that was named above"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in rows.select("i", C.explanation_tier(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == ["TIER_D", "TIER_D", "TIER_A", "TIER_C", "TIER_C", "TIER_B", "TIER_C"]


def test_dialogue_tiers(spark):
    texts = [
        "You have gastritis. It is caused by acid. Take one tablet daily and rest well.",
        "It looks like bronchitis so I suggest rest, fluids and a check with your doctor.",
        "I suggest rest and fluids for the next days, and please come back to us later on.",
        "I cannot say anything about this without an examination of the patient in person.",
        "This is a long reply which just stops in the middle of a sentence without any en",
        "ok", None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, output string")
    got = [r.quality_tier for r in C.dialogue_tier(rows, "output").orderBy("i").collect()]
    assert got == ["TIER_A", "TIER_B", "TIER_C", "TIER_D", "TIER_D", "TIER_D", "TIER_D"]


def test_whole_text_by_default_and_a_preview_on_demand(spark):
    rows = spark.createDataFrame([(1, "nothing", "." * 320 + " stent")], S.DIALOGUE)
    assert C.categorize_dialogue(rows, RULES["question"]).first().primary_category == "heart_blood_vessels"
    assert C.categorize_dialogue(rows, RULES["question"], preview_chars=300).first().primary_category == "public_health_prevention"


def test_build_load_and_report(spark, tmp_path):
    e = P.exam_rows(exam(spark, ("Medicine", "cardio", "heart tumor", "Harrison"), ("Medicine", "cardio", "heart", None)), RULES)
    lit_ = P.literature_rows(spark.createDataFrame([(7, "heart", "a", "y", (["c"], ["l"], ["Cardiac"]))], S.LITERATURE), RULES)
    con = P.consumer_rows(spark.createDataFrame([("q1", "treatment", "tooth", "see page 3", "1_CancerGov_QA"), ("q2", "x", "y", " ", "z")], S.CONSUMER + ", source string"), RULES)
    dia = P.dialogue_rows(spark.createDataFrame([(1, "tooth", "rest"), (2, "", "x")], S.DIALOGUE), RULES)
    assert con.count() == 1 and con.first().id == "1_CancerGov_QA::q1" and con.first().secondary_category == "medications_drug_safety"
    assert dia.count() == 1
    root = str(tmp_path / "db")
    assert P.load({"exam": (e, ["id"])}, root) == {"exam": 2}
    assert P.load({"exam": (e.unionByName(e), ["id"])}, root) == {"exam": 0}
    both = P.united(e, lit_, con, dia)
    assert both.columns == S.CATEGORIZED_COLUMNS and both.count() == 5
    reports = P.reports(both, ["medmcqa"])
    total = reports["stats"].where("stat = 'total'").first()
    assert total.cnt == 5
    assert values(reports["links"], "primary_category", "target", "cross_hits", "link_type") == [
        ("cancer", "medications_drug_safety", 1, "strong"), ("heart_blood_vessels", "cancer", 1, "strong")]


def test_insert_keeps_the_first_of_a_batch(spark, tmp_path):
    from caresift.sources.writers import insert_if_absent

    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "k int, v string, ord int")
    assert insert_if_absent(rows, path, ["k"], ["ord"]) == 2
    assert insert_if_absent(spark.createDataFrame([(2, "z", 9), (3, "d", 1)], rows.schema), path, ["k"]) == 1
    assert values(spark.read.parquet(path), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
