"""Tables whose other columns are called like names used inside, and damaged images."""

import struct

from pyspark.sql import functions as F

from caresift.llm import decontaminate, mixing, tiff, toxicity, urls


def test_columns_with_inner_names(spark):
    words = " ".join(f"w{k}" for k in range(30))
    names = ["_lower", "_padded", "_text", "best", "_best", "_variant", "rate", "copy", "row", "label", "score_"]
    docs = spark.createDataFrame([(i, words if i % 2 else f"other text {i}", "en") for i in range(40)], "doc_id long, text string, lang string").withColumns({n: F.lit(7) for n in names})
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, words)], "item_id long, text string")
    left = decontaminate.without_leaks(docs, benchmark, passages=True)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(0, 40, 2))
    clean = toxicity.without_toxic(docs, labels)
    assert clean.columns == docs.columns and all(r["_padded"] == 7 for r in clean.collect())
    mixed = mixing.repeated_to_targets(docs, labels, {"en/1": 0.5, "en/0": 0.5})
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == set(range(40))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.net/x").alias("url"), *names)
    assert {(r.rule, r.best) for r in urls.judged_urls(pages, urls.rule_table(spark, [("block", "net", "/")])).collect()} == {("net/", 7)}


def entries(*tags):
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", t, 4, n, v) for t, n, v in tags) + struct.pack("<I", 0)


def test_damaged_images_become_errors(spark):
    size = [(tiff.WIDTH, 1, 4), (tiff.HEIGHT, 1, 4), (tiff.BITS, 1, 8)]
    bad = [
        entries(*size, (tiff.STRIP_OFFSETS, 1, 8), (tiff.STRIP_SIZES, 1, 16), (tiff.ROWS_PER_STRIP, 1, 0)),
        entries(*size, (tiff.TILE_WIDTH, 1, 0), (tiff.TILE_HEIGHT, 1, 16), (tiff.TILE_OFFSETS, 1, 8), (tiff.TILE_SIZES, 1, 16)),
        entries(*size, (tiff.STRIP_OFFSETS, 2, 0), (tiff.STRIP_SIZES, 1, 16), (tiff.ROWS_PER_STRIP, 1, 2)),
        entries((tiff.WIDTH, 0, 4), *size[1:], (tiff.STRIP_OFFSETS, 1, 8), (tiff.STRIP_SIZES, 1, 16)),
        entries(*size, (tiff.COMPRESSION, 1, tiff.LZW), (tiff.STRIP_OFFSETS, 1, 86), (tiff.STRIP_SIZES, 1, 60)) + b"\xff" * 60,
        b"", b"II*\0", b"not an image", None,
    ]
    df = spark.createDataFrame(list(enumerate(bytearray(b) if b is not None else None for b in bad)), "id int, image binary")
    rows = tiff.tiff_pages(df, "image").collect()
    assert all(r.error and r.pixels is None for r in rows) and {r.id for r in rows} >= {0, 1, 2, 3, 4}


def test_lzw_codes_worked_out_by_hand():
    # clear, A, B, 258 (AB), end: nine bits each, highest bit first
    bits = "".join(f"{c:09b}" for c in (256, 65, 66, 258, 257))
    bits += "0" * (-len(bits) % 8)
    data = bytes(int(bits[k:k + 8], 2) for k in range(0, len(bits), 8))
    assert tiff.lzw_decode(data, 4) == b"ABAB"
