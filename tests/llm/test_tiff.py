import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caresift.llm import tiff


@pytest.mark.parametrize("size", [0, 1, 2, 127, 128, 129, 3_000, 40_000])
@pytest.mark.parametrize("letters", [1, 3, 256])
def test_codecs(size, letters):
    data = bytes(random.Random(size).choices(range(letters), k=size))
    assert tiff.lzw_decode(tiff.lzw_encode(data), size) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data), size) == data


@pytest.mark.parametrize("size", [1, 5, 64, 65, 700])
def test_written_files_read_back(size):
    for seed in range(6):
        payload = random.Random(seed * 100 + size).randbytes(192 * size)
        pages = tiff.pages_of(tiff.tiff_of(payload))
        assert b"".join(p.pixels for p in pages) == payload
        assert len(pages) == -(-size // tiff.PAGE_ROWS)


def image(order, pixels, planar=1, predictor=1):
    """A one-strip-per-plane file of 16-bit samples; pixels: rows, columns, samples."""
    height, width, samples = pixels.shape
    planes = [pixels[:, :, k:k + 1] for k in range(samples)] if planar == 2 else [pixels]
    if predictor == 2:
        planes = [np.diff(p, axis=1, prepend=np.zeros_like(p[:, :1])) for p in planes]
    raw = [zlib.compress(p.astype(f"{order}u2").tobytes()) for p in planes]
    at, offsets = 8, []
    for r in raw:
        offsets.append(at)
        at += len(r)
    lists = at
    tags = [(256, 3, [width]), (257, 3, [height]), (258, 3, [16]), (259, 3, [8]), (273, 4, offsets), (277, 3, [samples]), (278, 3, [height]), (279, 4, [len(r) for r in raw]), (284, 3, [planar]), (317, 3, [predictor])]
    entries, extra = b"", b""
    for tag, kind, values in tags:
        value = struct.pack(f"{order}{len(values)}{tiff.FIELD[kind]}", *values)
        if len(value) > 4:
            place = lists + len(extra)
            extra += value
            value = struct.pack(order + "I", place)
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
    directory = lists + len(extra)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, directory)
    return head + b"".join(raw) + extra + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", directory)  # turns back to itself


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("planar", [1, 2])
@pytest.mark.parametrize("predictor", [1, 2])
def test_sixteen_bits_planes_and_predictor(order, planar, predictor):
    pixels = np.random.default_rng(1).integers(0, 1 << 16, (5, 7, 3), np.uint16)
    pages = tiff.pages_of(image(order, pixels, planar, predictor))
    assert len(pages) == 1 and pages[0].pixels == pixels.tobytes() and (pages[0].width, pages[0].height, pages[0].samples) == (7, 5, 3)


def test_pages_as_rows(spark):
    good = tiff.tiff_of(b"ab" * 96 * 70)
    df = spark.createDataFrame([(1, bytearray(good), "x"), (2, None, "x"), (3, bytearray(b""), "x"), (4, bytearray(good[:-40]), "x"), (5, bytearray(b"II*\0" + b"\xff" * 4), "x"), (1, bytearray(good), "x")], "id int, image binary, page string")
    rows = tiff.tiff_pages(df, "image").orderBy("id", "page").collect()
    assert [(r.id, r.page, r.error is None) for r in rows] == [(1, 0, True), (1, 0, True), (1, 1, True), (1, 1, True), (3, 0, False), (4, 0, True), (4, 1, False), (5, 0, False)]
    assert tiff.tiff_pages(df.limit(0), "image").count() == 0


def test_texts_round_trip(spark):
    texts = [None, "", "é" * 97, "x" * 192, "long " * 9_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    images = tiff.texts_as_tiff(df).withColumns({"media_bytes": F.length("image").cast("bigint"), "media_sha256": F.sha2("image", 256)})
    rows = {r.doc_id: r for r in tiff.page_digests(tiff.tiff_pages(images, "image")).collect()}
    for i, t in enumerate(texts):
        payload = (t or "").encode()
        payload += b" " * (-len(payload) % 192 if payload else 192)
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].tail_crc32) == (len((t or "").encode()), len(payload), zlib.crc32(payload[-16:]))
