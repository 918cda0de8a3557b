import itertools
import random

import numpy as np
import pytest

from caresift.llm import ngram_join
from caresift.llm.common import stored
from caresift.llm.components import components


def shingles(text):
    w = (text or "").split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    rows = [(i, t) for i, t in rows if i is not None]
    links, root = dict.fromkeys((i for i, _ in rows), 0), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(rows, 2):
        x, y = shingles(s), shingles(t)
        if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(i), links[i]) for i, _ in rows}


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    base = [[word() for _ in range(rng.choice([1, 3, 5, 40, 120]))] for _ in range(30)]
    rows = []
    for text in base:
        for edits in (0, 0, 1, 2, 5):
            w = list(text)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edited" + str(rng.random())
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "ü ß é"), (1004, "ü ß é")]


def test_depth_follows_target():
    assert ngram_join.forest_depth(0.8, 20, 0.9999, 8) == 4
    assert ngram_join.forest_depth(0.8, 20, 0.9, 8) > 4 and ngram_join.forest_depth(0.8, 1, 0.9999, 8) == 1


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_classes(df).collect()}
    assert got == brute(rows)


def test_large_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 4)
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 3)
    rng = random.Random(9)
    words = [str(rng.random()) for _ in range(60)]
    rows = []
    for i in range(45):
        w = list(words)
        w[i % 40] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_repeats_nulls_and_one_of_each(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two  three four five six"), (None, "one two three four five six"), (3, None), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.copy_id or 0, r.n_links) for r in ngram_join.jaccard_classes(df).collect())
    assert got == [(0, 0, 0, 0), (1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 2), (3, 3, 3, 0), (4, 4, 4, 0), (4, 4, 4, 0)]
    assert sorted(r.doc_id or 0 for r in ngram_join.one_of_each_class(df).collect()) == [0, 1, 3, 4]
    assert ngram_join.jaccard_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 52), (60, 50)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {k: v for k, v in root.items() if any(x != y and k in (x, y) for x, y in edges)}
    assert {r.node: r.component for r in components(df).collect()} == want


def test_words_that_collide_under_a_polynomial(spark):
    one = "a"
    while len(one) < 4096:
        one += one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, one), (2, one.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert [(r.class_id, r.copy_id, r.n_links) for r in ngram_join.jaccard_classes(df).orderBy("doc_id").collect()] == [(1, 1, 0), (2, 2, 0)]


def test_prefix_lengths_reach_the_target_whatever_is_crowded():
    forest = ngram_join.forest_of(0.8, 20, 0.9999, 8)
    assert (forest.shortest, forest.deepest) == (3, 8)
    small = np.random.default_rng(3).integers(3, 10, (500, 20))
    small[0], small[1] = 3, 9
    lengths = forest.prefix_lengths(small)
    found = 1 - np.prod(1 - 0.8 ** lengths, axis=1)
    assert (found >= 0.9999).all() and lengths.min() >= 3 and lengths.max() <= 8
    # Nothing crowded, or everything: all trees within one level; otherwise crowded prefixes stay long while others make up.
    assert set(lengths[0]) <= {4, 5} and set(lengths[1]) <= {4, 5}
    half = forest.prefix_lengths(np.array([[3] * 16 + [9] * 4]))[0]
    assert set(half[16:]) == {8} and half[:16].max() <= 4
    loose = ngram_join.forest_of(0.8, 1, 0.9999, 8)
    assert loose.prefix_lengths(np.array([[2]])).tolist() == [[1]]


def boilerplate_corpus():
    """Texts that share half of their words, and groups of near copies among them."""
    rng = random.Random(21)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for g in range(60):
        own = [f"o{g}w{k}" for k in range(40)]
        for c in range(5 if g % 6 == 0 else 1):
            w = shared + own
            for _ in range(c):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_crowded_prefixes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 4)
    rows = boilerplate_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_classes(df).collect()}
    assert got == brute(rows)


def test_crowded_nodes_are_split_by_longer_prefixes(spark):
    rows = boilerplate_corpus()
    forest = ngram_join.forest_of(0.8, 20, 0.9999, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = ngram_join.signatures(df, forest, "doc_id", "text").withColumnRenamed("doc_id", "node")
    rows_signed = signed.collect()
    labels = {r.node: np.frombuffer(r.sketch, np.uint8).reshape(20, 8) for r in rows_signed}
    keys = {r.node: r["keys"] for r in rows_signed}
    asked = ngram_join.asked_prefixes(signed, forest, 4).collect()
    assert {r.length for r in asked} - {4, 5}, "some prefixes stay longer or get shorter than without crowds"
    together = {}
    for r in asked:
        together.setdefault((r.tree, r.bucket), []).append((r.node, r.length))
    for r in asked:
        assert r.m == len(together[r.tree, r.bucket])
    # Whoever shares the prefix that a label asks for (key of three values, then bytes) stands in its node.
    for r in asked:
        own = labels[r.node][r.tree][3:r.length]
        same = {y for y in labels if keys[y][r.tree] == keys[r.node][r.tree] and (labels[y][r.tree][3:r.length] == own).all()}
        assert same <= {n for n, _ in together[r.tree, r.bucket]}
    forest_nodes = sum(len(h) ** 2 for h in together.values())
    flat = {}
    for node, held in keys.items():
        for tree, key in enumerate(held):
            flat.setdefault((tree, key), []).append(node)
    assert forest_nodes < sum(len(h) ** 2 for h in flat.values() if len(h) > 1), "pairs within nodes, against the shortest prefixes alone"


def test_steps_of_few_edges_are_written_by_few_tasks(spark, monkeypatch):
    from caresift.llm import components as M

    written = []
    monkeypatch.setattr(M, "stored", lambda df, name: written.append(stored(df, name)) or written[-1])
    monkeypatch.setattr(M, "forget", lambda df: None)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 10] + [(7, None)], "a bigint, b bigint")
        got = {r.node: r.component for r in M.components(edges).collect()}
        files = [len(df.inputFiles()) for df in written]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {k: max(1, (k - 1) // 10 * 10 + 1) for k in range(1, 301)}
    assert max(files[1:]) <= spark.sparkContext.defaultParallelism < files[0]
