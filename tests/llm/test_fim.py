import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from caresift.llm import fim

PIECES = ["a", "Zz", "word", " ", "\n", "é", "中", "𝔘", "1", "@", "[", "`", "{", "\x00", " ", "<", ">", "<S", "ab" * 40]


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(p), len(m), (f"<P>{p}<S>{s}" if form == "psm" else f"<S>{s}<P>{p}") + f"<M>{m}"


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 30, 300])))) for i in range(1_500)]
    rows += [(2_000, None), (2_001, ""), (2_002, "x<P>y"), (None, "no id"), (2_003, "long é中" * 60_000), (2_004, "w" * 400_000), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in rows], "doc_id long, text string, form string, n int, output string")
    out = fim.fill_in_middle(df)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = out.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-2])
    assert sorted((tuple(r) for r in back), key=key) == sorted(((i, *brute(i, t), t or "") for i, t in rows), key=key)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_marks():
    text = "Ab1é中 zZ" * 9
    data = np.frombuffer((text * 2).encode(), np.uint8)
    half = len(data) // 2
    ends, starts = fim.text_marks(data, np.array([0, half, half, 2 * half]))
    units = [len(u.encode()) for u in re.findall("[A-Za-z]+|[^A-Za-z]", text)]
    want = np.cumsum(units + units)
    assert (ends.behind(np.arange(1, len(want) + 1)) == want).all() and (ends.rank(want) == np.arange(1, len(want) + 1)).all()
    assert starts.rank(np.array([half, 2 * half])).tolist() == [len(text), 2 * len(text)]


def test_shares_and_empty_table(spark):
    df = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    n = {r.form: r["count"] for r in fim.fill_in_middle(df).groupBy("form").count().collect()}
    assert abs(n["plain"] - 400) < 80 and abs(n["spm"] - 720) < 110
    assert fim.fill_in_middle(df, transformed=0).where("form <> 'plain'").count() == 0
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    named = df.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("body"))
    assert fim.fill_in_middle(named, "key", "body").where("n = 5").count() == 4_000
