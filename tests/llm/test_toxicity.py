import random
import zlib

import numpy as np

from caresift.llm import toxicity


def corpus(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ing", "le"]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(n):
        w, bad = [word() for _ in range(rng.randint(5, 80))], int(rng.random() < 0.3)
        for _ in range(2 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "Moron", "scum"]))
        rows.append((i, " ".join(w), bad))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    train = toxicity.training_rows(docs, labels)
    assert {r.doc_id for r in train.collect()} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5}
    model = toxicity.fit_toxicity(train)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 120 and np.mean([p == y for p, y in held]) > 0.98
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()} == {i for i in got if got[i].predicted == 0}


def test_score_is_the_sum_over_present_grams(spark):
    model = toxicity.fit_toxicity(spark.createDataFrame([(i, t, y) for i, t, y in corpus(300)], "doc_id long, text string, label int"))
    weights, used = model.table()
    text = "You IDIOT idiot, é"
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    grams = set()
    for size in model.sizes:
        for k in range(len(data) - size + 1):
            number, _ = toxicity.gram_numbers(data[k:k + size], np.array([0, size]), size, model.bits)
            grams.add(int(number[0]))
    want = 1 / (1 + np.exp(-(sum(float(weights[g]) for g in grams if used[g]) + model.bias)))
    df = spark.createDataFrame([(1, text, "a"), (2, "other text before", "b"), (1, text, "a")], "doc_id long, text string, score string")
    rows = toxicity.score_toxicity(df, model).collect()
    assert [r.doc_id for r in rows].count(1) == 2 and all(abs(r.score - want) < 1e-5 for r in rows if r.doc_id == 1)


def test_nulls_empties_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "x" * 200_000)], "doc_id long, text string")
    model = toxicity.fit_toxicity(spark.createDataFrame([(i, t, y) for i, t, y in corpus(300)] + [(None, "z", 1), (1000, None, 0), (1001, "z", None)], "doc_id long, text string, label int"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert got[1] == got[2] < 0.5 and got[None] > got[2] and len(got) == 4
    none = toxicity.fit_toxicity(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.without_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 4


def test_sample_is_bounded(spark):
    rows = spark.createDataFrame([(i, "t", 1) for i in range(2_000)], "doc_id long, text string, label int")
    assert 350 < toxicity.bounded_sample(rows, "doc_id", 500).count() < 650
    assert toxicity.bounded_sample(rows, "doc_id", 2_000).count() == 2_000
