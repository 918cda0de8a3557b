import hashlib
import math
import random
import re

from caresift.llm import pii

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]
TEXTS = [
    "a@b.c_d@e.f", "x@y..z@q.w", "1.2.3.4.5.6.7.8", "999.1.1.1 01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-11111111", "+1 (386) 555-3733 é +1-", "😀 a@b.co 😀 1.1.1.1", None, "",
    ".@.@a.b", "a" * 3000 + "@b.c", "1 " * 5000, "+" * 50 + "12 345 678 901", "12 4111111111111111", "4111111111111111 2", "a@b.c@d.e", "%@-.-", "4242 4242 4242 4242 4242", "0000000255.1.1.1", "+1.1.1.1.1.1.1.1.1", "4111111111111111@x.y 5500-0000-0000-0004",
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def spans(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m.group()))
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found)


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "q@r.st", "x"), (7, TEXTS[7], "x")], "doc_id long, text string, base string")
    rows = pii.digest_columns(pii.sanitised(df)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = spans("q@r.st" if r.doc_id is None else TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("term")) == want


def test_revealing_terms(spark):
    secret = ["call zebrafish now: k@x.io the plain", "zebrafish and the k@x.io plain", "the plain zealot k@x.io zebrafish"]
    others = ["the plain weather", "the plain zebra", "weather zeal the plain"] * 10 + ["zebu the plain"] * 5
    df = spark.createDataFrame(list(enumerate(secret + others)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.sanitised(df, min_documents=2).collect()}
    # "zebrafish" occurs with the entity only; its first letters occur in 10 + 5 other documents.
    n, share = len(secret + others), lambda pair, term: math.log2(pair * len(secret + others) / (3 * term)) / math.log2(len(secret + others) / 3)
    assert n == 38 and share(3, 3) >= 0.8 > share(3, 18)
    for k in range(3):
        assert [(t.value, t.start, t.stays) for t in rows[k].terms] == [("zebrafish", secret[k].index("zebrafish"), True)]
    assert rows[0].sanitised == "call zeb* now: [EMAIL] the plain"
    assert all(not rows[k].terms and rows[k].sanitised == (secret + others)[k] for k in range(3, n))


def told_terms(texts, threshold=0.8):
    """Brute force: the terms of every text that reveal one of its entities, and whether their first letters may stay."""
    base = [[(m.start(), m.end(), k, m.group().lower()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(t) if ok(m.group())] for t in texts]
    masked = ["".join(" " if any(a <= i < b for a, b, _, _ in spans) else c for i, c in enumerate(t)) for t, spans in zip(texts, base)]
    terms = lambda t: {x for w in re.findall(r"[^\W\d_]{3,}", t.lower()) for x in (w, w[:3] + "*")}
    held, clear, n = [terms(t) for t in texts], [terms(t) for t in masked], len(texts)
    owners = {}
    for i, spans in enumerate(base):
        for _, _, k, v in spans:
            owners.setdefault((k, v), set()).add(i)

    def share(entity, term):
        rows = owners[entity]
        pair, total = sum(term in clear[i] for i in rows), sum(term in h for h in held)
        return math.log2(pair * n / (len(rows) * total)) / math.log2(n / len(rows))

    told = []
    for i, text in enumerate(texts):
        mine = {(k, v) for _, _, k, v in base[i] if len(owners[k, v]) < n}
        out = []
        for m in re.finditer(r"[^\W\d_]{3,}", masked[i]):
            risky = [e for e in mine if share(e, m.group().lower()) >= threshold]
            if risky:
                out.append((m.start(), m.group(), all(share(e, m.group().lower()[:3] + "*") < threshold for e in risky)))
        told.append(out)
    return told


def test_terms_equal_brute_force(spark):
    r = random.Random(11)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(3, 7))) for _ in range(500)]
    names = [f"user{i}@mail.net" for i in range(12)] + [f"10.0.0.{i}" for i in range(6)]
    texts = []
    for i in range(160):
        text = [r.choice(words[:20] if r.random() < 0.6 else words) for _ in range(r.randint(0, 25))]
        for _ in range(r.choice([0, 0, 0, 1, 2, 5])):
            text.insert(r.randint(0, len(text)), r.choice(names))
        texts.append(" ".join(text))
    texts += texts[:15]  # repeated rows
    texts.append(" ".join(f"only{i}@here.org" for i in range(40)) + " uniqueword and mail")  # many entities of one row
    want = told_terms(texts)
    assert sum(map(len, want)) > 50 and want[-1]
    got = {x.doc_id: [(t.start, t.value, t.stays) for t in x.terms] for x in pii.sanitised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_empty_table(spark):
    assert pii.sanitised(spark.createDataFrame([], "doc_id long, text string")).count() == 0
