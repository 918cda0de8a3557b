import random
import re

import numpy as np
import pytest

from caresift.llm import substrings
from caresift.llm.common import WordHasher, separators, window_hashes


def brute(rows, width):
    texts = {(i, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    order = lambda i: (i is not None, i or 0)
    for (i, _), w in texts.items():
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, (order(i), k)), (order(i), k))
    out = {}
    for (i, t), w in texts.items():
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k:k + width])] < (order(i), k) for j in range(width)}
        out[i, t] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [rng.choice("abcdeé") * rng.randint(1, 4) for _ in range(400)]
    passages = [words[k:k + rng.randint(18, 60)] for k in range(0, 300, 50)]
    rows = [(None, " ".join(passages[0])), (0, None), (1, ""), (2, "\n\t "), (3, "loop " * 90), (4, "loop " * 30)]
    for i in range(5, 60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", " \x0b "]).join(parts)))
    return rows + [rows[10], (99, rows[9][1])]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("share", [500, 1])
def test_against_brute_force(spark, monkeypatch, seed, share):
    monkeypatch.setattr(substrings, "SHARE", share)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, starts string").repartition(5)
    want = brute(rows, substrings.WINDOW)
    got = substrings.without_repeats(df).collect()
    assert len(got) == len(rows)
    by_id = {i: want[i, t] for i, t in rows}
    assert all((r.n_words, r.n_removed, r.kept) == by_id[r.doc_id] for r in got)


def test_common_minimisers_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARE", 20)
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(50)]
    rows = [(i, " ".join([str(rng.random()) for _ in range(8)] + passage + [str(rng.random()) for _ in range(9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert len(substrings.common_minimisers(df.withColumnRenamed("doc_id", "id"), 20, 8)) > 0
    want = brute(rows, 20)
    assert all((r.n_words, r.n_removed, r.kept) == want[rows[r.doc_id]] for r in substrings.without_repeats(df).collect())


def test_empty_table(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minimisers_and_window_hashes():
    data = np.frombuffer(" ".join(str(k % 13) for k in range(300)).encode(), np.uint8)
    from caresift.llm.common import word_bounds

    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), separators(32))
    words = WordHasher()(data, starts, ends)
    assert len(np.unique(words)) == 13
    for width in (1, 2, 5, 8, 20):
        hashes = window_hashes(words, width)
        assert len(hashes) == 300 - width + 1
        assert [hashes[k] == hashes[k + 13] for k in range(20)] == [True] * 20 and len(np.unique(hashes)) == 13
    runs = window_hashes(words, 8)
    assert substrings.minimisers(words, 20, 8).tolist() == [runs[k:k + 13].min() for k in range(281)]


def thue_morse(n):
    letters = "a"
    while len(letters) < n:
        letters += letters.translate(str.maketrans("ab", "ba"))
    return letters[:n], letters[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_under_a_polynomial(spark, n):
    one, other = thue_morse(n)
    words = [f"w{k}" for k in range(30)]
    rows = [(0, " ".join(words[:10] + [one] + words[10:])), (1, " ".join(words[:10] + [other] + words[10:]))]
    want = brute(rows, 20)
    assert [(r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [want[r] for r in rows]
