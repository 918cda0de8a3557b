import random
import re

import numpy as np
import pytest

from caresift.llm import decontaminate as D


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, items):
    out = {}
    for i, text in docs:
        w = words(text)
        for q, item in items:
            v = words(item)
            near = [distance(w[k:k + len(v)], v) for k in range(len(w) - len(v) + 1)] if v else []
            if near and min(near) <= (1 - D.SIMILARITY) * len(v) + 1e-9:
                out[i, q] = min(near)
    return out


def test_edit_distances():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (50, 9)).astype(np.uint64), rng.integers(0, 4, (50, 9)).astype(np.uint64)
    n = rng.integers(1, 10, 50)
    assert D.edit_distances(a, b, n).tolist() == [distance(a[k][:n[k]].tolist(), b[k][:n[k]].tolist()) for k in range(50)]


def corpus(edits, seed=7):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"] + [f"w{k}" for k in range(300)])
    items = [(q, " ".join(word() for _ in range(rng.randint(14, 50)))) for q in range(25)]
    docs = []
    for i in range(75):
        body = [word() for _ in range(rng.randint(0, 120))]
        if i % 3:
            item = words(items[i % 25][1])
            for _ in range(int(edits * len(item))):
                kind, at = rng.randrange(3), rng.randrange(len(item))
                item[at:at + (kind != 1)] = [] if kind == 0 else [f"new{rng.random()}"[:9].replace(".", "")]
            body[10:10] = item
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body).replace("w", rng.choice("wW"))))
    return docs, items


@pytest.mark.parametrize("edits, recall", [(0.0, 1.0), (0.1, 0.99), (0.19, 0.9)])
def test_recall_and_exactness(spark, edits, recall):
    docs, items = corpus(edits)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, distance string")
    got = {(r.doc_id, r.item_id): r.distance for r in D.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert set(got) <= set(want) and len(got) >= recall * len(want) and len(want) >= 30
    assert all(got[k] >= want[k] for k in got) and (edits or got == want)


def test_blocks_and_short_items(spark):
    docs, items = corpus(0.0)
    items += [(90, "w5"), (91, ""), (92, None), (93, "w1 W2, w3"), (None, docs[4][1]), (94, items[3][1])]
    docs += [(80, "W5"), (81, None), (82, ""), (83, "x w1 - w2 w3"), (80, "W5")]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    whole = sorted((r.doc_id, -1 if r.item_id is None else r.item_id) for r in D.leaks(df, benchmark).collect())
    assert set(whole) == {(i, -1 if q is None else q) for i, q in want} and whole.count((80, 90)) == 2
    cut = sorted((r.doc_id, -1 if r.item_id is None else r.item_id) for r in D.leaks(df, benchmark, block_words=60).collect())
    assert cut == whole
    kept = [r.doc_id for r in D.without_leaks(df, benchmark, block_words=300).collect()]
    assert sorted(kept) == sorted(i for i, _ in docs if i not in {i for i, _ in want})


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0
    assert D.without_leaks(docs, items.limit(0)).count() == 1 and D.without_leaks(docs, items).count() == 0


@pytest.mark.parametrize("n, front, back", [(43, 4, 4), (43, 3, 3), (60, 6, 6), (15, 2, 1), (91, 9, 9), (10, 1, 1)])
def test_edits_at_both_ends(n, front, back):
    rng = random.Random(n)
    found, finder_words = 0, D.WordHasher()
    for k in range(40):
        item = [f"w{rng.random()}".replace(".", "") for _ in range(n)]
        copy = [f"x{j}" for j in range(front)] + item[front:n - back] + [f"y{j}" for j in range(back)]
        data, offsets = next(D.text_slices(D.pa.array([" ".join(["a", "b", *copy, "c"])])))[2:]
        own = next(D.text_slices(D.pa.array([" ".join(item)])))[2:]
        hashes = finder_words(own[0], *D.word_bounds(*own, D.separators(*D.NOT_WORD))[:2])
        _, _, begin, distance = D.Finder([D.Item(k, hashes)], D.SIMILARITY, 0.99)(data, offsets)
        found += list(zip(begin, distance)) == [(2, front + back)]
    assert found >= 39


def test_repetitions_reach_every_pattern():
    for n in (5, 9, 15, 40, 91, 1_000):
        edits = int((1 - D.SIMILARITY) * n + 1e-9)
        steps, sampled, count = D.repetitions(0.99, n, edits)
        assert 1 <= sampled <= steps <= min(n, D.STEPS) and 1 <= count <= 24
    rng = np.random.default_rng(3)
    item = np.arange(1, 44, dtype=np.uint64)
    assert all(distance(item.tolist(), x.tolist()) <= 8 for x in D.edit_patterns(item, 8, rng))


def nearest_passage(w, v):
    """(distance, first word) over all passages of ``w``, the nearest and then earliest."""
    best = None
    reach = [0] * (len(w) + 1)
    # Backwards, so that the column of the table is where the passage begins.
    for i, x in enumerate(reversed(v), 1):
        new = [i]
        for j, y in enumerate(reversed(w), 1):
            new.append(min(reach[j] + 1, new[-1] + 1, reach[j - 1] + (x != y)))
        reach = new
    for j, d in enumerate(reach):
        best = (d, len(w) - j) if best is None or (d, len(w) - j) < best else best
    return best


@pytest.mark.parametrize("kind", ["cut", "insert", "mixed"])
def test_passages_against_brute_force(spark, kind):
    rng = random.Random(len(kind))
    vocabulary = [f"v{k}" for k in range(2_000)]
    items = [(q, " ".join(rng.choices(vocabulary, k=rng.choice([15, 20, 38, 43, 59])))) for q in range(20)]
    docs = []
    for i in range(60):
        item = words(items[i % 20][1])
        for e in range(int(0.2 * len(item) + 1e-9)):
            at = rng.randrange(len(item))
            what = kind if kind != "mixed" else rng.choice(["cut", "insert", "swap"])
            item[at:at + (what != "insert")] = [] if what == "cut" else [f"n{i}x{e}"]
        around = [rng.choices(vocabulary, k=rng.randint(0, 9)) if i % 3 else [] for _ in range(2)]
        docs.append((i, " ".join(around[0] + item + around[1])))
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, q): nearest_passage(words(t), words(v)) for i, t in docs for q, v in items}
    want = {k: d for k, d in want.items() if d[0] <= 0.2 * len(words(items[k[1]][1])) + 1e-9}
    got = {(r.doc_id, r.item_id): (r.distance, r.first_word) for r in D.leaks(df, benchmark, passages=True).collect()}
    assert len(want) >= 60 and set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert all(got[k] == want[k] for k in got)
    kept = {r.doc_id for r in D.without_leaks(df, benchmark, passages=True).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_item_with_one_word_dropped(spark):
    item = " ".join(f"w{k}" for k in range(43))
    docs = spark.createDataFrame([(1, item.replace("w7 ", "")), (2, " ".join(f"w{k}" for k in range(8, 43))), (3, " ".join(f"w{k}" for k in range(9, 43))), (4, "x y " + item.replace("w7 ", "") + " z")], "doc_id long, text string")
    rows = D.leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string"), passages=True).collect()
    assert sorted((r.doc_id, r.first_word, r.distance) for r in rows) == [(1, 0, 1), (2, 0, 8), (4, 2, 1)]


def test_lingering_walks_leave_few_candidates_and_short_items_are_found(spark):
    rng = random.Random(2)
    items = [(q, " ".join(f"s{rng.random()}"[:9].replace(".", "") for _ in range(1 + q % 4))) for q in range(200)]
    docs = spark.createDataFrame([(q, f"a {t} b") for q, t in items], "doc_id long, text string")
    rows = D.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), passages=True).collect()
    assert {(r.doc_id, r.item_id, r.first_word, r.distance) for r in rows} >= {(q, q, 1, 0) for q, _ in items}
    # All positions of one common word: a key that reads that word only would make each of them a candidate.
    walk = D.walks(1)[0]
    left, _ = D.walked(np.full(1_000, 7, np.uint64), np.arange(10, 900), walk)
    assert len(left) in (0, 890) and sum(len(D.walked(np.full(1_000, 7, np.uint64), np.arange(10, 900), w)[0]) > 0 for w in D.walks(64)) < 32
