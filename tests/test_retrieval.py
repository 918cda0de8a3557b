import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caresift import constants as K
from caresift.functions import text as X
from caresift.functions.stemming import stem
from caresift.operators import classify as C
from caresift.operators import kb
from caresift.operators import retrieval as R
from caresift.operators.sizes import checked_broadcast
from caresift.plans import answering
from conftest import values


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, source_table string, record_id string, rank int, score double")


def test_fusion(spark):
    sem = ranked(spark, [(1, "t", "a", 1, 0.9), (1, "t", "b", 2, 0.8)])
    lex = ranked(spark, [(1, "t", "a", 1, 0.1), (1, "t", "c", 2, 0.2)])
    got = {r.record_id: r for r in R.fused(sem, lex, 10).collect()}
    assert got["a"].rrf_score == pytest.approx(2 / 61) and got["a"].relevance_score == 0.9
    assert got["b"].rrf_score == got["c"].rrf_score == pytest.approx(1 / 62 + 1 / 81)
    assert [got[x].fused_rank for x in "abc"] == [1, 2, 3]
    swapped = R.fused(ranked(spark, [(1, "t", "a", 1, 0.9), (1, "t", "b", 2, 0.9)]), ranked(spark, [(1, "t", "b", 1, 0.9), (1, "t", "a", 2, 0.9)]), 10)
    assert [r.rrf_score for r in swapped.collect()] == [pytest.approx(1 / 61 + 1 / 62)] * 2


def hit(q, table, rid, tier, text, score):
    return (q, table, rid, "c", tier, text, score)


def test_confidence(spark):
    rows = [hit(1, "medmcqa_records", str(i), "TIER_A", "x", 1.0) for i in range(5)]
    rows += [hit(2, "pubmedqa_records", str(i), "TIER_D", "x", 0.2) for i in range(2)] + [hit(2, "medquad_records", "z", "TIER_D", "x", 0.0)]
    rows += [hit(3, "medquad_records", "1", "TIER_A", "Takes WARFARIN daily", 0.9)]
    rows += [hit(5, "medquad_records", "1", "TIER_A", "x", 0.9), hit(5, "pubmedqa_records", "2", "TIER_D", "x", 0.1)]
    hits = spark.createDataFrame(rows, "query_id int, source_table string, record_id string, primary_category string, quality_tier string, chunk_text string, relevance_score double")
    queries = spark.createDataFrame([(1, "cancer"), (2, "cancer"), (3, K.MEDICATIONS), (4, "cancer"), (5, "cancer")], "query_id int, category string")
    got = {r.query_id: r for r in R.confidence(queries, hits).collect()}
    assert got[1].confidence == pytest.approx(0.925) and got[1].disclaimer is None and not got[1].uncertain
    assert got[2].confidence == pytest.approx(0.5 * 0.1 + 0.5 * (0.2 + 0.2) / 3 + 0.05) and got[2].disclaimer == K.DISCLAIMER_LOW
    assert got[3].confidence == 0.80 and got[3].narrow_index
    assert got[4].confidence == 0 and got[4].n_hits == 0
    assert (got[5].n_hits, got[5].n_tables) == (1, 1)  # the hit below the floor does not count


def test_citations(spark):
    rows = [(1, "t", "a", "TIER_B", 0.9, 1), (1, "t", "a", "TIER_B", 0.9, 2), (1, "t", "b", "TIER_A", 0.1, 3), (1, "t", "c", "odd", 1.0, 4)]
    df = spark.createDataFrame(rows, "query_id int, source_table string, record_id string, quality_tier string, relevance_score double, rank int")
    assert [r.record_id for r in R.citations(df).orderBy("citation").collect()] == ["b", "a", "c"]


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(60, 8))
    base[40:] = base[0]  # a third of the records are copies
    corpus = [("ab"[i % 2], i, [float(x) for x in v]) for i, v in enumerate(base)]
    queries = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(7, 8)))] + [(7, [float(x) for x in base[0]])]
    return corpus, queries


@pytest.mark.parametrize("block", [2048, 3])
def test_semantic_search_is_exact(spark, vectors, block, monkeypatch):
    corpus, queries = vectors
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = R.semantic_hits(
            spark.createDataFrame(corpus, "source_table string, record_id long, embedding array<float>").repartition(3),
            spark.createDataFrame(queries, "query_id long, embedding array<float>"), 5)
        got = {}
        for r in found.collect():
            got.setdefault((r.query_id, r.source_table), []).append((round(r.score, 5), r.record_id))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    f32 = lambda v: np.array(v, np.float32).astype(float)
    for q, qv in queries:
        for t in "ab":
            sims = [(round(float(f32(qv) @ f32(v) / np.linalg.norm(f32(qv)) / np.linalg.norm(f32(v))), 9), i) for t2, i, v in corpus if t2 == t]
            best = sorted(sims, key=lambda x: (-x[0], x[1]))[:5]
            assert sorted(got[q, t], key=lambda x: (-x[0], x[1])) == [(round(s, 5), i) for s, i in best]


def test_lexical_search_needs_every_word(spark):
    corpus = spark.createDataFrame(
        [("t", 1, "chest pain and heart pain"), ("t", 2, "heart only"), ("u", 3, "Pain, heart!"), ("u", 4, "")], "source_table string, record_id int, text string")
    queries = spark.createDataFrame([(1, "the heart PAIN"), (2, "heart zebra"), (3, "the of"), (4, "heart")], "query_id int, text string")
    got = values(R.lexical_hits(corpus, queries), "query_id", "source_table", "record_id")
    assert got == [(1, "t", 1), (1, "u", 3), (4, "t", 1), (4, "t", 2), (4, "u", 3)]
    score = R.lexical_hits(corpus, queries).where("query_id = 1 and record_id = 1").first().score
    assert score == 1.0 and R.lexical_hits(corpus, queries).where("query_id = 4 and record_id = 1").first().score == pytest.approx(1 / (1 + np.log(5)))


def test_rows_without_a_vector_have_no_centroid(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [])], "query_id int, embedding array<double>")
    means = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "category string, centroid array<double>")
    assert values(C.nearest_centroid(rows, means, threshold=None), "query_id", "category") == [(1, "x")]


STEMS = """consigned consign|consistency consist|consolatory consolatori|conspirators conspir|constancy constanc|knackeries knackeri|knavish knavish|knitting knit|
knives knive|ties tie|cries cri|gas gas|this this|gaps gap|kiwis kiwi|hoping hope|hopping hop|luxuriated luxuri|generously generous|generic generic|communism communism|
skies sky|dying die|exceed exceed|proceeds proceed|happily happili|by by|say say|cry cri|relational relat|rational ration|electricity electr|hopefulness hope|
possibly possibl|agreed agre|feed feed|youth youth|boyish boyish|diabetes diabet|medications medic|shed shed|bing bing|fizzed fizz|probate probat|cease ceas|
controlling control|roll roll|biology biolog|cats cat|été été|ü ü"""


def test_stems_of_known_words(spark):
    pairs = [tuple(p.split()) for p in STEMS.replace("\n", "").split("|")]
    df = spark.createDataFrame([*pairs, (None, None)], "word string, want string").select("word", "want", stem("word").alias("got"))
    assert [r for r in df.collect() if r.got != r.want] == []


def test_lexical_search_compares_stems(spark):
    corpus = spark.createDataFrame([("t", 1, "a cat sat"), ("t", 2, "cats were treated"), ("t", 3, "treatment of dogs")], "source_table string, record_id int, text string")
    queries = spark.createDataFrame([(1, "Cats"), (2, "the cat's treating"), (3, "dog treatments")], "query_id int, text string")
    assert values(R.lexical_hits(corpus, queries), "query_id", "record_id") == [(1, 1), (1, 2), (2, 2), (3, 3)]


@pytest.fixture(scope="module")
def indexed(spark):
    r = random.Random(17)
    words = ["pain", "pains", "heart", "hearts", "treated", "treat", "zeta", "of", "été"] + [f"w{k}" for k in range(12)]
    docs = [(r.choice("ab"), i, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(400)]
    corpus = spark.createDataFrame(docs, "source_table string, record_id int, text string")
    return docs, R.build_postings(corpus, buckets=16)


@pytest.mark.parametrize("n", [1, 3, None])
def test_search_in_a_written_index(spark, indexed, n):
    docs, index = indexed
    stems = {"pains": "pain", "hearts": "heart", "treated": "treat"}
    asked = [(1, "pains"), (2, "heart of pain"), (3, "w1 w2"), (4, "of"), (5, "pain nowhere"), (6, "w3 treat été"), (7, None)]
    got = {}
    for r in R.search_postings(spark, index, spark.createDataFrame(asked, "query_id int, text string"), n).collect():
        got.setdefault((r.query_id, r.source_table), []).append((-r.score, r.record_id))
    for q, text in asked:
        need = {stems.get(w, w) for w in (text or "").split()} - {"of"}
        for t in "ab":
            want = []
            for t2, i, d in docs:
                ws = [stems.get(w, w) for w in d.split()]
                if t2 == t and need and need <= set(ws):
                    want.append((-round(min(1.0, sum(w in need for w in ws) / (1 + math.log(len(ws)))), 9), i))
            assert sorted(got.get((q, t), [])) == sorted(want)[:n]


def test_a_search_reads_the_touched_buckets_of_the_index_only(spark, indexed):
    queries = spark.createDataFrame([(1, "heart")], "query_id int, text string")
    df = R.search_postings(spark, indexed[1], queries, None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert R.search_postings(spark, R.build_postings(spark.createDataFrame([], "source_table string, record_id int, text string")), queries).count() == 0


@pytest.mark.parametrize("inline", [1000, 0])
def test_contained_phrases_both_ways(spark, inline):
    r = random.Random(5)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(60)]
    texts = [(i, "".join(r.choice("abc ") for _ in range(r.randint(0, 80)))) for i in range(40)]
    phrases = sorted(set(words))
    got = C.contained(spark.createDataFrame(texts + texts[:3], "id int, text string"), F.col("text"), spark.createDataFrame([(p,) for p in phrases + ["", None]], "phrase string"), "phrase", inline=inline)
    assert values(got, "id", "phrase") == sorted((i, p) for i, t in texts + texts[:3] for p in phrases if p and p in t)


@pytest.mark.parametrize("part", [200_000, 50])
def test_many_phrases_in_parts(spark, part):
    r = random.Random(8)
    phrases = ["".join(r.choice("abcdé") for _ in range(r.choice([1, 2, 3, 4, 12]))) for _ in range(400)]
    texts = [(i, "".join(r.choice("abcdé") for _ in range(r.choice([0, 30, 3000])))) for i in range(25)] + [(None, "abc"), (99, None)]
    table = spark.createDataFrame([(p, k) for k, p in enumerate(phrases + ["", None])], "phrase string, number int")
    got = C.contained(spark.createDataFrame(texts, "id int, text string"), F.col("text"), table, "phrase", inline=0, part_phrases=part)
    want = sorted((str(i), k) for i, t in texts for k, p in enumerate(phrases) if t and p in t)
    assert sorted((str(x.id), x.number) for x in got.collect()) == want and len(want) > 3 * C.OUT_ROWS // 4


def test_200_000_phrases_with_common_prefixes(spark):
    phrases = spark.range(200_000).select(F.concat(F.lit("the "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("phrase"), F.col("id").alias("number"))
    texts = spark.createDataFrame([(i, " ".join(f"the {(i * 7919 + k * 131) % 250_000:06d}" for k in range(40))) for i in range(50)], "id int, text string")
    got = C.contained(texts, F.col("text"), phrases, "phrase", part_phrases=60_000)
    assert values(got, "id", "number") == sorted((i, n) for i in range(50) for n in {(i * 7919 + k * 131) % 250_000 for k in range(40)} if n < 200_000)


@pytest.mark.parametrize("part", [200_000, 40])
def test_first_rules_of_any_number(spark, part):
    r = random.Random(4)
    rules = [("t", k % 30, f"c{k % 7}", "".join(r.choice("abcD") for _ in range(r.randint(2, 6)))) for k in range(300)]
    noise = [("other", 0, "x", "a"), ("t", None, "x", "a"), ("t", 0, None, "a"), ("t", 0, "x", None), ("t", 0, "x", "")]
    texts = [(i, "".join(r.choice("abcd") for _ in range(r.choice([0, 2, 4, 9, 40])))) for i in range(60)] + [(70, None)]
    got = C.first_rules(spark.createDataFrame(texts, "id int, text string"), F.lower("text"), spark.createDataFrame(rules + noise, "rule_set string, rule_idx int, category string, keyword string"), "t", part_phrases=part)
    best = lambda t: min(((i, c) for _, i, c, k in rules if t and k.lower() in t), default=(0, None))[1]
    assert {x.id: x.category for x in got.collect()} == {i: best(t) for i, t in texts}
    empty = C.first_rules(spark.createDataFrame(texts, "id int, text string"), F.lower("text"), spark.createDataFrame(rules, "rule_set string, rule_idx int, category string, keyword string"), "none")
    assert empty.where("category is not null").count() == 0 and empty.count() == len(texts)


def test_keyword_classifier(spark):
    terms = spark.createDataFrame(
        [("heart", "heart attack", "MI"), ("heart", "heart flutter", "AF"), ("lung", "short breath", "dyspnea"), ("lung", "chest cold", "x"), ("heart", "chest pain", "angina")],
        "category string, consumer_term string, medical_term string")
    asked = [(1, "I had a heart attack"), (2, "short breath and heart attack"), (3, "flutter, flutter"), (4, "my chest"), (5, "nothing"), (6, "heart attack, chest pain and short breath")]
    got = values(C.keyword_category(spark.createDataFrame(asked, "query_id int, text string"), terms), "query_id", "category")
    # 2: one phrase each, then tokens: heart 2 + attack 1 against short 1 + breath 1; 4: chest once each
    assert got == [(1, "heart"), (2, "heart"), (3, "heart"), (6, "heart")]


def test_condition_matching(spark):
    registry = spark.createDataFrame([("diabetes", "h", "d"), ("type 2 diabetes", "h", "d2"), ("asthma", "b", "a")], "name string, category string, subcategory string")
    names = spark.createDataFrame([(1, " Asthma "), (2, "childhood asthma"), (3, "type 2"), (4, "gout")], "id int, name string")
    assert values(C.match_conditions(names, registry), "id", "subcategory") == [(1, "a"), (2, "a"), (3, "d2")]


DOC = """<!-- draft -->

# Heart & Blood Vessels

## Links
- **Strong links:**
  - [Kidney](kidney_urinary.md) — 100 cross-hits
- **Weak links:**
  - [Eyes](eye_health.md) -- related risk
  - [Cancer](cancer.md) (9 cross-hits)

## Terminology Map
| Consumer Term | Medical Term | Notes |
|--------------|-------------|-------|
| heart attack | myocardial infarction (MI) | urgent |
| high pressure | Hypertension | |

## Subcategory Details

### Hypertension & Blood Pressure
- **Related:** [Kidney](kidney_urinary.md) (renal damage), [Eyes](eye_health.md) (retinopathy)

### Heart Attack (Acute, Silent)
text

## Known Pitfalls
- [x](cancer.md) -- 7 cross-hits
"""


def test_knowledge_documents(spark):
    files = spark.createDataFrame([("/x/heart_blood_vessels.md", DOC)], "path string, text string")
    docs = kb.documents(files)
    assert docs.first().name == "Heart & Blood Vessels" and docs.first().slug == "heart_blood_vessels"
    assert values(kb.links(docs), "target", "link_type", "cross_hits", "reason") == [
        ("cancer", "weak", 9, "9 cross-hits"), ("eye_health", "weak", 1, "related risk"), ("kidney_urinary", "strong", 100, "100 cross-hits")]
    assert values(kb.terms(docs), "consumer_term", "medical_term", "notes") == [("heart attack", "myocardial infarction (MI)", "urgent"), ("high pressure", "Hypertension", "")]
    assert values(kb.subcategories(docs), "subcategory") == [("heart_attack_acute_silent",), ("hypertension_blood_pressure",)]
    assert values(kb.related(docs), "subcategory", "target", "reason") == [
        ("hypertension_blood_pressure", "eye_health", "retinopathy"), ("hypertension_blood_pressure", "kidney_urinary", "renal damage")]
    registry = {r.name: r.subcategory for r in kb.condition_registry(docs).collect()}
    assert registry["hypertension"] == registry["high pressure"] == registry["hypertension & blood pressure"] == "hypertension_blood_pressure"
    assert registry["acute heart attack"] == registry["heart attack silent"] == registry["heart attack"] == registry["myocardial infarction (mi)"] == "heart_attack_acute_silent"


def test_budget(spark):
    parts = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, ""), (1, 3, "bbbb"), (1, 4, "cccc"), (2, 1, "dd")], "query_id int, ord int, text string")
    cut = kb.budgeted(parts, budget=6)
    assert values(cut, "query_id", "ord", "text") == [(1, 1, "aaaa"), (1, 3, "bb"), (2, 1, "dd")]
    assert values(kb.joined_context(cut), "query_id", "context") == [(1, "aaaa\n\n---\n\nbb"), (2, "dd")]


def test_context_sections(spark):
    docs = spark.createDataFrame([(s, s * 2) for s in "abcd"], "slug string, text string")
    queries = spark.createDataFrame([(1, "a"), (2, "zz")], "query_id int, category string")
    plan = spark.createDataFrame([(1, "b", 0.4, "may"), (1, "c", 0.7, "must"), (1, "d", 0.1, None), (2, "b", 0.6, "must")], "query_id int, category string, weight double, bucket string")
    got = kb.joined_context(kb.budgeted(kb.context_sections(queries, plan, docs, "rules"), budget=9), separator="|")
    assert values(got, "query_id", "context") == [(1, "aa|cc|bb|rul"), (2, "bb|rules")]
    found = {r.slug: (r.found, r.known_slugs) for r in kb.lookup(spark.createDataFrame([("a",), ("q",)], "slug string").toDF("slug"), docs).collect()}
    assert found == {"a": (True, None), "q": (False, "a, b, c, d")}


def test_medications_without_a_name(spark):
    rows = spark.createDataFrame([(1, " Aspirin 100 "), (2, "  "), (3, None), (4, "other")], "id int, name string")
    got = C.resolve_medications(rows, "name", [("aspirin", "heart"), ("other", "x")])
    assert values(got, "id", "name", "category") == [(1, "Aspirin 100", "heart"), (4, "other", "x")]


def test_what_has_no_record_takes_no_place(spark):
    corpus = spark.createDataFrame([("t", f"{i:03d}", "heart pain", [1.0, 0.0]) for i in range(60)], "source_table string, record_id string, text string, embedding array<float>")
    records = corpus.where("record_id >= '055'").select("source_table", "record_id", F.lit("cancer").alias("primary_category"), F.lit("TIER_A").alias("quality_tier"), F.col("text").alias("chunk_text"))
    queries = spark.createDataFrame([(1, "heart", [1.0, 0.0])], "query_id int, text string, embedding array<float>")
    assert values(answering.search(corpus, records, queries), "record_id", "rank") == [(f"{i:03d}", i - 54) for i in range(55, 60)]


def test_answering_end_to_end(spark):
    r = np.random.default_rng(1)
    vec = lambda i: [float(x) for x in r.normal(size=4) * 0.01 + np.eye(4)[i % 4]]
    corpus = spark.createDataFrame([("medquad_records", str(i), f"heart pain number {i}", vec(i)) for i in range(12)], "source_table string, record_id string, text string, embedding array<float>")
    records = corpus.select("source_table", "record_id", F.lit("cancer").alias("primary_category"), F.lit("TIER_A").alias("quality_tier"), F.col("text").alias("chunk_text"))
    queries = spark.createDataFrame([(1, 1, "heart pain", vec(0)), (2, 1, "zzz", vec(1))], "query_id int, user_id int, text string, embedding array<float>")
    terms = spark.createDataFrame([("heart_blood_vessels", "heart pain", "x")], "category string, consumer_term string, medical_term string")
    means = spark.createDataFrame([("cancer", [0.0, 1.0, 0.0, 0.0])], "category string, centroid array<double>")
    docs = kb.documents(spark.createDataFrame([("heart_blood_vessels.md", DOC), ("cancer.md", "# Cancer\n"), ("kidney_urinary.md", "# K\n"), ("eye_health.md", "# E\n")], "path string, text string"))
    from caresift.operators import graph as G
    from caresift.schemas import PROFILE

    graph = G.edges(docs)
    profiles = spark.createDataFrame([("1", 55, "male", "low", [("d", "heart_blood_vessels", "hypertension_blood_pressure", True)], [])], PROFILE).withColumn("user_id", F.col("user_id").cast("int"))
    history = spark.createDataFrame([], "user_id int, src string, dst string, cnt long, last_used timestamp")
    model = spark.createDataFrame([], "query_id int, category string")
    hits, confidence = answering.answer(queries, corpus, records, terms, means, model, graph, profiles, history, F.current_timestamp(), k=4)
    assert {r.query_id: r.method for r in confidence.collect()} == {1: "keyword", 2: "embedding"}
    got = hits.groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {1: 4, 2: 4}


def test_phrases_beyond_one_part_are_searched_for_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(C, "phrase_parts", lambda *_: pytest.fail("the phrase table was sent to the driver"))
    r = random.Random(3)
    phrases = ["".join(r.choice("abé") for _ in range(r.randint(1, 5))) for _ in range(300)]
    texts = [(i, "".join(r.choice("abé ") for _ in range(60))) for i in range(20)] + [(20, None), (21, "")]
    table = spark.createDataFrame([(p, k) for k, p in enumerate(phrases + ["", None])], "phrase string, number int").repartition(3)
    got = C.contained(spark.createDataFrame(texts, "id int, text string"), F.col("text"), table, "phrase", inline=0, part_phrases=70)
    assert values(got, "id", "number") == sorted((i, k) for i, t in texts for k, p in enumerate(phrases) if t and p in t)


def test_words_are_counted_in_their_row_and_postings_dealt_by_their_number(spark, monkeypatch):
    plans, write = [], R._written
    monkeypatch.setattr(R, "_written", lambda df, path: plans.append((path, df._jdf.queryExecution().executedPlan().toString())) or write(df, path))
    monkeypatch.setattr(R, "POSTING_ROWS", 3)
    corpus = spark.createDataFrame([("t", 1, "b x b"), ("t", 1, "x"), ("t", None, "x  x"), ("t", 2, None), ("t", 3, " ")], "source_table string, record_id int, text string")
    index = R.build_postings(corpus)
    words = next(plan for path, plan in plans if path.endswith("/words"))
    assert "Aggregate" not in words and "Exchange" not in words
    got = sorted((str(r.record_id), r.stem, round(r.weight, 9)) for r in index.table(spark, "postings").collect())
    three, two = 1 / (1 + math.log(3)), 1 / (1 + math.log(2))
    assert got == sorted([("1", "x", round(three + 1, 9)), ("1", "b", round(2 * three, 9)), ("None", "x", round(2 * two, 9))])


def test_described_hits_do_not_shuffle_texts(spark):
    hits = spark.createDataFrame([(1, "t", 1), (2, "t", 9), (3, "t", None)], "query_id int, source_table string, record_id int")
    records = spark.range(1, 9).select(F.lit("t").alias("source_table"), F.col("id").cast("int").alias("record_id"), F.col("id").cast("string").alias("chunk_text"))
    assert values(R.described(hits, records.union(records.where("record_id = 1"))), "query_id", "chunk_text") == [(1, "1"), (1, "1")]
    left = R.described(hits, records, "left")
    assert {(r.query_id, r.chunk_text) for r in left.collect()} == {(1, "1"), (2, None), (3, None)}
    assert "LeftSemi, BuildRight" in left._jdf.queryExecution().executedPlan().toString()


def test_counted_words_by_small_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "COUNTED_BYTES", 16)
    r = random.Random(5)
    held = ["Été", "été", "x_1", "don't", "a\u00a0b", "\U0001d518z", "\x0b", "\r\n", "", "\u2003", "ﬁ"]
    texts = [" ".join(r.choice(held) for _ in range(r.randint(0, 12))) for _ in range(60)] + [None, "", " \t", "\x0bw\f w"]
    corpus = spark.createDataFrame([("t", k // 2, t) for k, t in enumerate(texts)], "source_table string, record_id int, text string").repartition(2)
    got = [tuple(x) for x in R.counted_words(corpus).collect()]
    words = corpus.select("source_table", "record_id", X.words(F.col("text")).alias("w")).collect()
    want = [(x.source_table, x.record_id, w, x.w.count(w), len(x.w)) for x in words for w in set(x.w or [])]
    assert sorted(got) == sorted(want)


def test_few_stems_and_few_scored_records_are_broadcast(spark, indexed, monkeypatch):
    plans, write = [], R._written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(R, "_written", lambda df, path: plans.append((path, plan(df))) or write(df, path))
    words = spark.createDataFrame([("t", 1, "pains", 1.0)], "source_table string, record_id int, word string, weight double")
    stems = spark.createDataFrame([("pains", "pain")], "word string, stem string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = R.with_stems(words, stems)
        assert "BroadcastHashJoin" in plan(joined) and values(joined, "record_id", "stem") == [(1, "pain")]
        assert "ShuffledHashJoin" in plan(words.join(checked_broadcast(stems, 0, "shuffle_hash"), "word"))
        R.search_postings(spark, indexed[1], spark.createDataFrame([(1, "pain heart")], "query_id int, text string"), 3).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    best = next(p for path, p in plans if path.endswith("/best"))
    assert re.search(r"BroadcastHashJoin \[source_table#\d+, record_id#\d+L?\], .*LeftSemi", best)


def test_lists_of_records_are_dealt_once_and_then_summed(spark, monkeypatch):
    plans, write = {}, R._written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(R, "_written", lambda df, path: plans.update({path.rpartition("/")[2]: plan(df)}) or write(df, path))
    r = random.Random(11)
    words = ["pain", "pains", "the", *(f"w{k}" for k in range(20))]
    docs = [(r.choice(["a", "b", None]), r.choice([None, *(str(k) for k in range(90))]), " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for _ in range(300)]
    corpus = spark.createDataFrame(docs, "source_table string, record_id string, text string").coalesce(1)
    want = {}
    for table, record, text in docs:
        for w in text.split():
            if w != "the":
                key = (str(table), str(record), w.removesuffix("s"))
                want[key] = want.get(key, 0) + 1 / (1 + math.log(len(text.split())))
    for block, chunk in ((1 << 20, 1000), (400, 40)):
        monkeypatch.setattr(R, "BLOCK_BYTES", block)
        monkeypatch.setattr(R, "COUNTED_BYTES", min(block, 300))
        monkeypatch.setattr(R, "CHUNK_RECORDS", chunk)
        monkeypatch.setattr(R, "POSTING_ROWS", 200)
        index = R.build_postings(corpus, buckets=4)
        rows = index.table(spark, "postings").collect()
        assert {(str(x.source_table), str(x.record_id), x.stem): round(x.weight, 9) for x in rows} == {k: round(v, 9) for k, v in want.items()} and len(rows) == len(want)
        heads = {x.stem: (x.records, round(x.top, 9)) for x in index.table(spark, "heads").collect()}
        assert heads == {s: (sum(k[2] == s for k in want), round(max(v for k, v in want.items() if k[2] == s), 9)) for s in {k[2] for k in want}}
        if block > 400:  # a row for each word and table of a block, not for each word of a record
            lists = spark.read.parquet(f"{index.folder}/words")
            assert lists.count() == 22 * 3 and "Exchange" not in plans["words"] and "stems" not in plans
            dealt = plan(R.dealt_postings(lists, 5, 4))
            assert dealt.count("Exchange") == 1 and "Join" not in dealt


def test_texts_stay_where_they_are_while_labels_are_two_million_at_most(spark, tmp_path):
    from caresift.catalog import retrieval

    spark.createDataFrame([(1, "a", 1), (200_001, "b", 400), (300_000, None, None)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(200_002).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = retrieval.records(spark, str(tmp_path))
        assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
        assert values(df, "record_id", "source_table") == [(1, retrieval.TABLES[0]), (200_001, retrieval.TABLES[0]), (300_000, retrieval.TABLES[0])]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
