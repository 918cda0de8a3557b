import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from caresift.llm import audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    rows = [(i, t or "", s or "") for i, t, s in rows]
    out = []
    for part in {s for _, _, s in rows}:
        docs = []
        for i, t, s in rows:
            if s != part:
                continue
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            failed = {
                "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in rows),
            }
            mine = [x for x in labels if i is not None and x[0] == i]
            docs.append(({k for k, v in failed.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
        removed, shapley = {}, dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for k in order:
                gone = [d for d in left if k in d[0]]
                left = [d for d in left if k not in d[0]]
                removed[order, k] = (len(left), gone)
                shapley[k] += len(gone)
        for order in permutations("ABCDE"):
            for step, k in enumerate(order, 1):
                kept, gone = removed[order, k]
                redundant = sum(k in d[0] for d in docs) - len(gone)
                out.append((part, "".join(order), step, kept, len(gone), redundant, sum(d[0] == {k} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), shapley[k]))
    return sorted(out)


def tables(spark, n=160):
    rng = random.Random(11)
    texts = ["", None, "few words", "UPPER CASE", "a # b", " \t\n", "éé ÀÀ"]
    for _ in range(25):
        words = [rng.choice(["one", "Two", "three", "é", "x|y"]) + (str(k) if rng.random() < 0.6 else "") for k in range(rng.choice([20, 199, 200, 201, 300]))]
        texts.append(" ".join(words))
    texts += [texts[-1] + " ", "long " * 30_000]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(n)]
    rows += rows[:10]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    docs = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], "doc_id long, text string, source string, id int, bits int, hash string")
    return rows, labels, docs, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")


def test_against_brute_force(spark):
    rows, labels, docs, known = tables(spark)
    got = audit.audit(docs, known)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, labels)


def test_hashes_that_stand_for_several_texts(spark):
    rows, labels, docs, known = tables(spark, 90)
    weak = audit.audit(docs, known, digest=lambda t: F.length(t) % 3)
    assert sorted(tuple(r) for r in weak.collect()) == brute(rows, labels)


def test_empty_tables(spark):
    rows, labels, docs, known = tables(spark, 20)
    assert audit.audit(docs.limit(0), known).count() == 0
    assert sorted(tuple(r) for r in audit.audit(docs, known.limit(0)).collect()) == brute(rows, [])
