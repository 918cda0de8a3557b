import random

from caresift.llm import urls

HOSTS = ["a.net", "b.a.net", "net", "x.example.com", "example.com", "org", "q.r.org", "annet", "", "a..net", "c.b.a.net"]
PATHS = ["", "/", "/de/", "/de/x", "/dex", "/en/a/b", "/é/ü", "/de/x/y"]


def brute(host, path, rules):
    fits = [(len(h + p), h.count("."), v == "block", h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (best[3], best[4]) if best else (None, "allow")


def test_against_brute_force(spark):
    rng = random.Random(3)
    rules = [(v, rng.choice(HOSTS), rng.choice(PATHS)) for v in ("allow", "block") for _ in range(14)]
    pages = [(i, f"http://{h}{p}{t}", "kept") for i, (h, p, t) in enumerate((h, p, t) for h in HOSTS for p in PATHS for t in ("", "?q=/de/", "#x"))]
    df = spark.createDataFrame(pages, "page_id int, url string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judged_urls(df, urls.rule_table(spark, rules)).collect()}
    want = {i: brute(u[7:].split("/")[0].split("?")[0].split("#")[0], "/" + u[7:].split("?")[0].split("#")[0].partition("/")[2] if "/" in u[7:].split("?")[0].split("#")[0] else "", rules) for i, u, _ in pages}
    assert got == want


def test_nulls_repeats_and_parts(spark):
    df = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://Ä.Net/A?b"), (3, "HTTP://Ä.Net/A?b"), (None, "x://net/"), (4, "a://b://c/d")], "page_id int, url string")
    rows = urls.judged_urls(df, urls.rule_table(spark, [("block", "net", "/"), (None, "net", "/"), ("allow", None, "/"), ("allow", "net", "x")])).collect()
    assert sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in rows) == [
        (0, "net", "/", "net/", "block"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "Ä.net", "/A", "net/", "block"), (3, "Ä.net", "/A", "net/", "block"), (4, "b:", "//c/d", None, "allow"),
    ]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id int, url string")
    rules = urls.rule_table(spark, [("block", "net", "/")])
    assert urls.judged_urls(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://net/")], "page_id int, url string")
    assert [(r.rule, r.verdict) for r in urls.judged_urls(one, rules.limit(0), default="block").collect()] == [(None, "block")]
