"""TIFF columns: one row per page of every image.

Reads both byte orders; walks the chain of image directories; strips and tiles; no compression, LZW, deflate and
PackBits; horizontal predictor; 8 and 16 bits per sample; interleaved and planar samples.  A small writer stores bytes
as pages, to have something to read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caresift.llm.common import group_starts, small_batches, whole_groups

#: Fixed values of the format: numbers of tags, compressions and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: "B", 3: "H", 4: "I", 16: "Q"}

#: A page may not claim more bytes than this; a larger claim is reported as an error, not read.
PAGE_BYTES = 1 << 30


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, widened one code early; stops at ``size`` bytes."""
    clear, end = 256, 257
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, bits, held, done = list(start), 9, 0, 0, 0
    out: list[bytes] = []
    before = b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == clear:
            table, width, before = list(start), 9, b""
            continue
        if code == end or done >= size:
            break
        if not before:
            if code >= len(table):
                raise ValueError("LZW code out of range")
            piece = table[code]
        else:
            if code < len(table):
                piece = table[code]
            elif code == len(table):
                piece = before + before[:1]
            else:
                raise ValueError("LZW code out of range")
            table.append(before + piece[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(piece)
        done += len(piece)
        before = piece
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    clear, end = 256, 257
    out, held, bits, width = bytearray(), clear, 9, 9
    table: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    following, word = 258, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        if bits >= 512:
            rest = bits & 7
            out.extend((held >> rest).to_bytes((bits - rest) // 8, "big"))
            held, bits = held & ((1 << rest) - 1), rest

    for k in range(len(data)):
        longer = word + data[k:k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        word = data[k:k + 1]
        if following >= (1 << width) and width < 12:
            width += 1
        if following == 4094:
            put(clear)
            table, following, width = {bytes((i,)): i for i in range(256)}, 258, 9
    if word:
        put(table[word])
        following += 1
        if following >= (1 << width) and width < 12:
            width += 1
    put(end)
    pad = -bits % 8
    out.extend((held << pad).to_bytes((bits + pad) // 8, "big"))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, done = [], 0, 0
    while at < len(data) and done < size:
        n = data[at]
        at += 1
        if n < 128:
            piece = data[at:at + n + 1]
            at += n + 1
        elif n > 128:
            piece = data[at:at + 1] * (257 - n)
            at += 1
        else:
            continue
        out.append(piece)
        done += len(piece)
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    out = bytearray()

    def literal(part: bytes) -> None:
        for k in range(0, len(part), 128):
            piece = part[k:k + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    at = 0
    for run in re.finditer(rb"(.)\1{2,}", data, re.DOTALL):
        literal(data[at:run.start()])
        left = run.end() - run.start()
        while left:
            n = min(left, 128)
            if n == 1:
                literal(run.group(1))
            else:
                out.append(257 - n)
                out.extend(run.group(1))
            left -= n
        at = run.end()
    literal(data[at:])
    return bytes(out)


def expanded(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return packbits_decode(data, size)
    raise ValueError(f"compression {compression} is not supported")


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: bytes


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of every image directory, in the order of the chain; a chain that turns back ends."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in FIELD:
                form = f"{order}{n}{FIELD[kind]}"
                size = struct.calcsize(form)
                place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
                if place + size > len(data):
                    raise ValueError("a field lies outside the file")
                tags[tag] = struct.unpack_from(form, data, place)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def read_page(data: bytes, order: str, tags: dict[int, tuple]) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag not in tags and default is None:
            raise ValueError(f"tag {tag} is missing")
        if tag in tags and not tags[tag]:
            raise ValueError(f"tag {tag} has no value")
        return tags[tag][0] if tag in tags else default

    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    compression, planar, predictor = one(COMPRESSION, NONE), one(PLANAR, 1), one(PREDICTOR, 1)
    if bits not in (8, 16) or predictor not in (1, 2):
        raise ValueError(f"{bits} bits with predictor {predictor} are not supported")
    if width * height * samples * bits // 8 > PAGE_BYTES:
        raise ValueError("the page is too large")
    kind = np.dtype(f"{order}u{bits // 8}")
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    page = np.zeros((planes, height, width, deep), kind.newbyteorder("="))
    tiled = TILE_OFFSETS in tags
    wide, high = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_SIZES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_SIZES])
    if min(width, height, samples, wide, high) < 1:
        raise ValueError("a page, strip or tile has no pixels")
    across, down = -(-width // wide), -(-height // high)
    if min(len(offsets), len(sizes)) < planes * across * down:
        raise ValueError("strips or tiles are missing")
    for k in range(planes * across * down):
        plane, row, column = k // (across * down), k % (across * down) // across * high, k % across * wide
        rows = high if tiled else min(high, height - row)
        size = rows * wide * deep * kind.itemsize
        raw = expanded(data[offsets[k]:offsets[k] + sizes[k]], compression, size)
        if len(raw) < size:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(raw, kind, rows * wide * deep).reshape(rows, wide, deep).astype(page.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=page.dtype)
        part = block[:height - row, :width - column]
        page[plane, row:row + part.shape[0], column:column + part.shape[1]] = part
    pixels = page.transpose(1, 2, 0, 3) if planes > 1 else page
    return Page(width, height, samples, bits, compression, np.ascontiguousarray(pixels).tobytes())


def pages_of(data: bytes | None) -> list[Page | str]:
    """Pages in order; one that can't be read is a string saying why, and a broken directory ends the list."""
    out: list[Page | str] = []
    if data is None:
        return out
    try:
        for order, tags in directories(data):
            try:
                out.append(read_page(data, order, tags))
            except (ValueError, KeyError, struct.error, zlib.error) as error:
                out.append(str(error))
    except (ValueError, struct.error) as error:
        out.append(str(error))
    return out


def tiff_pages(images: DataFrame, column: str) -> DataFrame:
    """One row per page: all columns of ``images`` but ``column``, then page, width, height, samples, bits, compression,
    pixels (rows of interleaved samples in the machine's byte order) and error.

    A null image has no page.  A page or file that can't be read gives a row with an error and nulls.  Input columns of
    these names are replaced.  Rows of one image stay together and in order.
    """
    extra = [("page", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("samples", T.IntegerType()), ("bits", T.IntegerType()), ("compression", T.IntegerType()), ("pixels", T.BinaryType()), ("error", T.StringType())]
    kept = [f for f in images.schema.fields if f.name != column and f.name not in dict(extra)]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in extra]])
    width = len(kept)
    kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, cells = [], [[] for _ in extra]
                for row, data in enumerate(batch.column(width)):
                    for number, page in enumerate(pages_of(data.as_py())):
                        rows.append(row)
                        good = isinstance(page, Page)
                        values = (page.width, page.height, page.samples, page.bits, page.compression, page.pixels, None) if good else (None,) * 6 + (page,)
                        for cell, value in zip(cells, (number, *values)):
                            cell.append(value)
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(taken) for i in range(width)], *[pa.array(c, k) for c, k in zip(cells, kinds)]], names=schema.names)

    return images.select(*[f.name for f in kept], F.col(column)).mapInArrow(read, schema)


# --- a writer ---------------------------------------------------------------------------------------------------------

#: Bytes of a row, and rows of a page, of what ``tiff_of`` writes.
ROW_BYTES, PAGE_ROWS, STRIP_ROWS, TILE = 192, 64, 16, 64

#: Layouts that pages take in turn: compression, predictor, samples per pixel, tiled.
LAYOUTS = ((DEFLATE, 2, 1, False), (PACKBITS, 1, 1, True), (LZW, 2, 3, False), (DEFLATE, 2, 3, True), (NONE, 1, 1, False))


def tiff_of(payload: bytes) -> bytes:
    """A TIFF file whose pages, read in order, are ``payload`` (a multiple of ``ROW_BYTES``) as 8-bit samples.

    Byte order and the first page's layout follow from the payload's checksum.
    """
    mark = zlib.crc32(payload)
    order = "<>"[mark & 1]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    for number, at in enumerate(range(0, len(rows), PAGE_ROWS)):
        compression, predictor, samples, tiled = LAYOUTS[(mark // 2 + number) % len(LAYOUTS)]
        image = rows[at:at + PAGE_ROWS].reshape(-1, ROW_BYTES // samples, samples)
        height, width = image.shape[:2]
        wide, high = (TILE, STRIP_ROWS) if tiled else (width, STRIP_ROWS)
        offsets, sizes = [], []
        for row in range(0, height, high):
            for column in range(0, width, wide):
                block = image[row:row + high, column:column + wide]
                if tiled and block.shape[:2] != (high, wide):
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, samples), np.uint8))
                raw = block.tobytes()
                packed = {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress, PACKBITS: packbits_encode}[compression](raw)
                offsets.append(len(out))
                sizes.append(len(packed))
                out += packed
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [wide]), (TILE_HEIGHT, 4, [high]), (TILE_OFFSETS, 4, offsets), (TILE_SIZES, 4, sizes)] if tiled else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [high]), (STRIP_SIZES, 4, sizes)]
        entries = b""
        out += b"\0" * (len(out) % 2)
        for tag, kind, values in sorted(tags):
            value = struct.pack(f"{order}{len(values)}{FIELD[kind]}", *values)
            if len(value) > 4:
                place = struct.pack(order + "I", len(out))
                out += value + b"\0" * (len(value) % 2)
                value = place
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack(order + "H", len(tags)) + entries + b"\0" * 4
    return bytes(out)


def padded_payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * (-len(data) % ROW_BYTES if data else ROW_BYTES)


def texts_as_tiff(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (a number of the task's rows), ``doc_id, n_bytes, image``: every text as a TIFF file."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("image", T.BinaryType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + len(texts)), pa.int64()), batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([tiff_of(padded_payload(t)) for t in texts], pa.binary()),
                ], names=schema.names)
                row += len(texts)

    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(write, schema)


def page_digests(pages: DataFrame) -> DataFrame:
    """Pages of one image (consecutive rows with the same ``row``) put together again: digests of what was read."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = T.StructType([T.StructField("doc_id", pages.schema["doc_id"].dataType), *[T.StructField(n, T.StringType() if n.endswith("sha256") or n == "feature" else T.LongType()) for n in names[1:]]])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["row"]):
            starts = group_starts(table, ["row"])
            cells: list[list] = [[] for _ in names[2:]]
            pixels, heights, layouts = table.column("pixels").to_pylist(), table.column("height").to_pylist(), table.column("compression").to_pylist()
            size, digests = table.column("media_bytes").to_pylist(), table.column("media_sha256").to_pylist()
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                payload = b"".join(x or b"" for x in pixels[a:b])
                values = np.frombuffer(payload, np.uint8)
                counts = np.bincount(values, minlength=256)
                feature = f"pages={b - a};rows={sum(h or 0 for h in heights[a:b])};layouts={'+'.join(str(x) for x in layouts[a:b])};sum={int(counts @ np.arange(256))};values={int((counts > 0).sum())};most={int(counts.argmax())}"
                for cell, value in zip(cells, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), size[a], digests[a], feature)):
                    cell.append(value)
            first = table.take(pa.array(starts))
            columns = [first.column("doc_id").combine_chunks(), first.column("n_bytes").combine_chunks(), *[pa.array(c) for c in cells]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pages.mapInArrow(digest, schema)
