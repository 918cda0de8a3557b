import gzip
import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from caresift.llm import warc
from caresift.session import shared_dir


def brute(rows):
    out = []
    for i, u, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same, default=None) if len(data) >= 100 else None
        copy = first is not None and first != i
        out.append((None if i is None else str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if copy else "response", str(first) if copy else None))
    return sorted(out, key=str)


def read(df):
    rows = df.collect()
    assert not [r.error for r in rows if r.error]
    return sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")

    def put(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield put
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def pages():
    rng = random.Random(8)
    letters = [chr(c) for c in range(32, 127)] + ["é", "\r\n\r\n", "\n", "中", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 98, 99, 100, 101, 3_000]))) for _ in range(60)] + ["é" * 50, "é" * 49 + "x", None, "z" * 500_000]
    rows = [(rng.choice([None, *range(500)]), rng.choice([None, "http://a/b c\r\nX: y", "http://é.net/?q=%20"]), rng.choice(texts)) for _ in range(300)]
    return rows + [(7, "u", texts[-1]), (7, "u", texts[-1]), (9, "u", texts[-1]), (None, None, "n" * 200), (None, None, "n" * 200)]


def test_against_brute_force_in_ranges(spark, small_ranges):
    rows = pages()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, first string")
    folder = warc.write_warc(df.repartition(2))
    want = brute(rows)
    assert read(warc.read_warc(spark, folder)) == want
    for size in ("4000b", "700b"):
        small_ranges(size)
        assert read(warc.read_warc(spark, folder)) == want
    full = warc.with_full_payloads(warc.read_warc(spark, folder, True)).collect()
    assert sorted(r.payload.decode() for r in full) == sorted(h or "" for _, _, h in rows)


def test_files_are_plain_gzip_members(spark):
    folder = warc.write_warc(spark.createDataFrame([(1, "http://x/", "hé"), (2, None, None)], "page_id long, url string, html string").coalesce(1))
    local = folder.removeprefix("file:")
    text = b"".join(gzip.open(os.path.join(local, f)).read() for f in sorted(os.listdir(local)) if f.startswith("part-"))
    assert text.count(b"WARC/1.1\r\n") == 2 and b"\r\n\r\nh\xc3\xa9\r\n\r\n" in text and b"WARC-Target-URI: http://x/\r\n" in text


def archive(spark, name, data):
    folder = os.path.join(shared_dir(spark).removeprefix("file:"), f"archive-{name}-{random.getrandbits(60):x}")
    os.makedirs(folder)
    with open(os.path.join(folder, "a.warc"), "wb") as f:
        f.write(data)
    return folder


def record(payload, key="1"):
    body = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:" + key.encode() + b">\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    squeeze = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored as it is, so that what the payload holds stands in the file
    return squeeze.compress(body) + squeeze.flush()


def test_archive_inside_a_record_and_false_magic(spark, small_ranges):
    inner = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    payloads = [b"a" * 90 + inner * 3 + b"b" * 300, b"x" * 50 + warc.MAGIC + b"y" * 80 + warc.MAGIC * 2, inner, warc.MAGIC]
    folder = archive(spark, "nested", b"".join(record(p, str(k)) for k, p in enumerate(payloads)))
    want = sorted((str(k), len(p), hashlib.sha256(p).hexdigest()) for k, p in enumerate(payloads))
    for size in ("128m", "64b", "150b", "13b"):
        small_ranges(size)
        assert sorted((r.record_id, r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, folder).collect()) == want, size


def test_damage_is_told_and_the_rest_is_read(spark):
    good, bad = record(b"p" * 400), bytearray(record(b"q" * 400, "2"))
    bad[200] ^= 1
    rows = warc.read_warc(spark, archive(spark, "damaged", b"junk" + good + bytes(bad) + record(b"r", "3") + record(b"s" * 90, "4")[:60])).collect()
    assert {r.record_id for r in rows if not r.error} == {"1", "3"}
    assert {r.error for r in rows if r.error} == {"no gzip member", "damaged member", "cut off member"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(spark, warc.write_warc(df)).count() == 0
    one = spark.createDataFrame([(1, "a", "b")], "page_id long, url string, html string")
    assert warc.read_warc(spark, warc.write_warc(one)).select(F.col("payload_bytes")).first()[0] == 1
