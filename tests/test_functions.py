import pytest
from pyspark.sql import functions as F

from caresift import constants as K
from caresift.functions import answers as A
from caresift.functions import text as X
from caresift.functions import weights as W
from caresift.functions.rules import read_rules, rule_set, first_match


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(v):
    return F.lit(v)


def test_weight_arithmetic(spark):
    assert one(spark, W.soft_cap(lit(0.0))) == 0
    assert one(spark, W.soft_cap(lit(-0.5))) == 0
    assert 0.08 < one(spark, W.soft_cap(lit(0.10))) < 0.12
    assert 0.39 < one(spark, W.soft_cap(lit(2.0))) < 0.40
    for count, days, expected in [(5, 0.0, 0.10), (5, 90.0, 0.05), (100, 0.0, 0.15), (0, 0.0, 0.0)]:
        assert one(spark, W.history_boost(lit(count), lit(days))) == pytest.approx(expected)
    assert one(spark, W.history_boost(lit(5), lit(360.0))) < 0.01
    assert one(spark, W.effective_weight(lit(0.85), lit(0.0), lit(0.0))) == 0.85
    assert one(spark, W.count_weight(lit(100), K.STRONG_MAX)) == pytest.approx(0.85)
    assert one(spark, W.count_weight(lit(980), K.STRONG_MAX)) == pytest.approx(0.85)
    assert one(spark, W.count_weight(lit(0), K.WEAK_MAX)) == 0.10


def test_guarded_adjustment(spark):
    assert one(spark, W.guarded_adjustment(lit(0.4), lit(0.95))) == 0.7
    assert one(spark, W.guarded_adjustment(lit(0.6), lit(0.0))) == 0.4
    assert one(spark, W.guarded_adjustment(lit(0.1), lit(-1.0))) == 0.05
    assert one(spark, W.guarded_adjustment(lit(None).cast("double"), lit(0.9))) == 0.3


def test_slugs(spark):
    assert one(spark, X.slugify(lit("Heart & Blood Vessels"))) == "heart_blood_vessels"
    assert one(spark, X.slugify(lit("Nephrotic / Nephritic Syndrome"))) == "nephrotic_nephritic_syndrome"
    assert one(spark, X.slugify(lit("Diabetes (Type 1, Type 2, Gestational)"))) == "diabetes_type_1_type_2_gestational"


def test_option_letters(spark):
    got = [one(spark, X.option_letter(lit(v).cast("int"))) for v in (1, 4, 7, 0, None)]
    assert got == ["a", "d", "7", None, None]


def test_lenient_json(spark):
    texts = ['{"score": 0.5, "explanation": "x"}', 'Sure:\n```json\n{"score": 1}\n```', 'I think {"score": 0.25} fits', "nothing", "  "]
    got = [one(spark, X.grade_from_text(lit(t))) for t in texts]
    assert [g.score for g in got] == [0.5, 1.0, 0.25, 0.0, 0.0]
    assert got[1].explanation == "" and got[3].explanation.startswith("Failed to parse") and got[4].explanation == "Empty grader response."


def test_english(spark):
    for t, expected in [("What is the dose", True), ("   ", False), ("Это вопрос the", False), ("dose warfarin", False)]:
        assert one(spark, X.looks_english(lit(t))) is expected


def test_answers(spark):
    clean = lambda t: A.without_markup(lit(t))
    assert one(spark, A.multilingual_letter(clean("**Answer:** $\\boxed{C}$"))) == "C"
    assert one(spark, A.multilingual_letter(clean("الإجابة: ب"))) == "B"
    assert one(spark, A.multilingual_letter(clean("উত্তর: ড"))) == "C"
    assert one(spark, A.multilingual_letter(clean("no letter here"))) is None
    assert one(spark, A.number_answer(lit("Answer: 3 then Answer: 1,250.0 or 7."), lit("Answer"))) == "7"
    assert one(spark, A.number_answer(lit("nothing"), lit("Answer"))) == ""
    assert one(spark, A.same_number(lit("1,250"), lit("1250.00"))) is True


def test_spans(spark):
    def best(p, refs):
        r = one(spark, A.best_span(lit(p), F.array(*[lit(x) for x in refs])))
        return r.em, r.f1

    assert best("The Denver Broncos", ["denver broncos"]) == (1.0, 100.0)
    assert best("12 yards", ["13 yards", " "]) == (0.0, 0.0)
    assert best("the 12 long yards", ["12.0 yards"]) == (0.0, 80.0)
    assert one(spark, A.fuzzy_match(lit("The dog!"), lit("a big dog"))) is True


def test_rules_from_a_table(spark):
    rows = [("topic", 1, "b", "beta"), ("topic", 0, "a", "Alpha"), ("other", 0, "x", "y"), ("topic", 1, "b", "bet")]
    rules = read_rules(spark.createDataFrame(rows, "rule_set string, rule_idx int, category string, keyword string"), "topic")
    assert rules == rule_set([(["Alpha"], "a"), (["bet", "beta"], "b")])
    assert one(spark, first_match(lit("some beta alpha"), rules)) == "a"


def test_retrieval_items(spark):
    text = "Found:\n- PMID 12: A study\n- PMID 3: Other\n"
    assert [i.source for i in one(spark, X.retrieval_items(lit("pubmed_search"), lit(text)))] == ["PMID 12", "PMID 3"]
    assert one(spark, X.retrieval_items(lit("pubmed_search"), lit("Error: no"))) == []
    assert one(spark, X.retrieval_items(lit("calculator"), lit(text))) == []


def test_last_user_text_of_parts(spark):
    from caresift.operators import turns

    part = "array<struct<type:string,text:string>>"
    rows = [(1, 0, "user", [("text", "old")]), (1, 2, "user", [("text", "a"), ("image", "x"), ("text", None), ("text", "b")]), (1, 3, "assistant", [("text", "z")]), (2, 0, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, text {part}")
    assert {r.conv_id: r.query for r in turns.last_user_text(df).collect()} == {1: "a  b", 2: ""}
