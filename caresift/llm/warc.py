"""WARC archives: pages written as records of their own gzip members, and read back by ranges of bytes.

Writer.  Of pages with equal payloads the one with the smallest id is written as ``response``, the others as ``revisit``
records that refer to it.  Each record is one gzip member; members stand one after the other, as in any ``.warc.gz``.

Reader.  Spark's scan cuts the files into ranges and each range at the bytes a gzip member begins with; a piece belongs to
the range its first byte lies in, and the scan reads on past the range's end to finish it.  A task validates each candidate
by decoding it: a member must begin with the version line of a record, and it ends where its own trailer says.
The magic may occur inside a member too; pieces are joined until the member ends.  Where a member runs into the next
range's pieces, its file is read once more in one piece, so that no record is lost or made up.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caresift.llm.common import fresh_folder, small_batches, stored

#: Fixed values of the formats: the bytes of a gzip member that is deflated, and the first of a record.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = 31  # zlib's number for its largest window with a gzip header
_NAME = "urn:page:"
LEVEL = 6


def _member(key: str | None, first: str | None, url: str | None, payload: bytes, digest: str, is_copy: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_copy else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_copy else 'response'}", f"WARC-Record-ID: <{_NAME}{quote(key or '', safe='')}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + quote(url or "", safe="".join(chr(c) for c in range(33, 127))), f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if is_copy:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_NAME}{quote(first or '', safe='')}>"]
    record = "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
    return squeeze.compress(record) + squeeze.flush()


def write_warc(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write a record per row of ``pages``; returns the folder of the archives.

    Payloads are UTF-8; null payloads are empty, null urls and ids empty strings.  Payloads of fewer than ``least_bytes``
    bytes are all written as responses.  Rows that repeat the smallest id of a payload are responses too; a row with a null
    id refers to the smallest id, and where no row of a payload has an id, all are responses.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or fresh_folder(spark, "warc")
    held = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), held.alias("payload"), F.sha2(held, 256).alias("digest"))
    long = rows.where(F.octet_length("payload") >= least_bytes).groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stored(long.where("n > 1 and first is not null").select("d", "first"), "warc-firsts")
    planned = rows.join(firsts, F.col("digest") == F.col("d"), "left").select(
        F.col("id").cast("string").alias("id"), F.col("first").cast("string").alias("first"), "url", "payload", "digest",
        (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))).alias("is_copy"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, firsts, urls, _, digests, copies = (batch.column(k).to_pylist() if k != 3 else None for k in range(6))
            members = []
            for k, content in enumerate(batch.column(3).cast(pa.large_binary())):
                member = _member(ids[k], firsts[k], urls[k], content.as_py(), digests[k], copies[k], date)
                # The text writer closes each value with a zero byte: the last byte of a member below 16 MB, else padding.
                members.append(member[:-1] if member[-1] == 0 else member)
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    planned.mapInArrow(build, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(folder)
    return folder


# --- reading --------------------------------------------------------------------------------------------------------

def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _named(value: str | None) -> str | None:
    if not value:
        return None
    return unquote(value.strip("<>").removeprefix(_NAME)) or None


def parsed(record: bytes, with_payload: bool) -> dict:
    """The columns of a record's bytes; ``error`` says what is wrong with it."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = fields.get("content-length", "")
    out = {"record_type": fields.get("warc-type"), "record_id": _named(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "refers_to": _named(fields.get("warc-refers-to"))}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if not size.isdigit() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        return out | {"error": "content length"}
    block = rest[:-4]
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    else:
        http, payload = b"", block
    if out["record_type"] == "revisit":
        n = _fields(http).get("content-length", "")
        return out | {"payload_bytes": int(n) if n.isdigit() else None, "payload_digest": digest}
    found = hashlib.sha256(payload).hexdigest()
    out |= {"payload_bytes": len(payload), "payload_digest": found, "payload": payload if with_payload else None}
    return out | {"error": "payload digest"} if digest not in (None, found) else out


class Members:
    """Puts the pieces of one range (or of one whole file) together to members and yields their records."""

    def __init__(self, with_payload: bool, at_start: bool) -> None:
        self.with_payload = with_payload
        self.at_start, self.synced = at_start, at_start
        self.inflate, self.found = None, []

    def __call__(self, piece: bytes) -> Iterator[dict]:
        if self.at_start:
            # What stands in front of the first magic of a file.
            self.at_start = False
            if piece.strip(b"\0"):
                yield {"error": "no gzip member"}
            return
        piece = MAGIC + piece
        if self.inflate is not None:
            try:
                self.take(piece)
            except zlib.error:
                yield {"error": "damaged member"}
                self.inflate = None
            else:
                yield from self.closed()
                return
        self.inflate, self.found = zlib.decompressobj(_GZIP), []
        try:
            head = self.inflate.decompress(piece, len(VERSION))
        except zlib.error:
            head = None
        if head is None or not VERSION.startswith(head):
            self.inflate = None
            # In a range's first pieces: the rest of a member that began before the range.
            yield {"error": "no record"} if self.synced else {"open": True}
            return
        self.found.append(head)
        try:
            self.take(self.inflate.unconsumed_tail)
        except zlib.error:
            self.inflate = None
            yield {"error": "damaged member"}
            return
        self.synced = True
        yield from self.closed()

    def take(self, piece: bytes) -> None:
        self.found.append(self.inflate.decompress(piece))

    def closed(self) -> Iterator[dict]:
        if not self.inflate.eof:
            return
        padding, record = self.inflate.unused_data, b"".join(self.found)
        self.inflate, self.found = None, []
        yield parsed(record, self.with_payload)
        if padding.strip(b"\0"):
            yield {"error": "bytes behind a member"}

    def end(self, whole: bool) -> Iterator[dict]:
        """A member that is still open goes on in a later range, or is cut off if there is none."""
        if self.inflate is not None:
            yield {"error": "cut off member"} if whole else {"open": True}


_COLUMNS = {"record_type": pa.string(), "record_id": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "error": pa.string(), "payload": pa.binary(), "open": pa.bool_()}
_SCHEMA = "file string, record_type string, record_id string, url string, payload_bytes bigint, payload_digest string, refers_to string, error string, payload binary, open boolean"


def _records(pieces: DataFrame, with_payload: bool, whole: bool) -> DataFrame:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, members, rows, size = None, None, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            columns = [pa.array([r[0] for r in rows], pa.string())] + [pa.array([r[1].get(c) for r in rows], kind) for c, kind in _COLUMNS.items()]
            rows, size = [], 0
            return pa.RecordBatch.from_arrays(columns, ["file", *_COLUMNS])

        for batch in batches:
            files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for file, start, piece in zip(files, starts, batch.column(2)):
                here = (file,) if whole else (file, start)
                if here != where:
                    if members is not None:
                        rows += [(where[0], r) for r in members.end(whole)]
                    where, members = here, Members(with_payload, start == 0)
                for r in members(piece.as_py()):
                    rows.append((file, r))
                    size += len(r.get("payload") or b"") + 200
                if size > 4 << 20:
                    yield flush()
        if members is not None:
            rows += [(where[0], r) for r in members.end(whole)]
        if rows:
            yield flush()

    return pieces.select("file", "start", "piece").mapInArrow(decode, _SCHEMA)


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record below ``folder``: ``file, record_type, record_id, url, payload_bytes, payload_digest, refers_to, error, payload``.

    Length and digest (SHA-256, lower-case hex) are counted from the payload read, and taken from the headers of a
    ``revisit``.  ``payload`` is filled on demand.  What is damaged, cut off or no record becomes a row with an ``error``;
    an empty folder gives no row.  Files are members one after the other, under names that Spark does not take for
    compressed ones (it would unpack ``.gz`` by itself, in one task a file).
    """
    small_batches(spark)
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
    place = F.col("_metadata")
    pieces = lines.select(place["file_path"].alias("file"), place["file_block_start"].alias("start"), F.col("value").cast("binary").alias("piece"))
    ranges = stored(_records(pieces, with_payload, False), "warc-ranges")
    kept = ranges.where("open is null").drop("open")
    # Names of files only: few members hold the magic by chance and cross the end of a range there.
    across = [r["file"] for r in ranges.where("open").select("file").distinct().toLocalIterator()]
    if not across:
        return kept
    ordered = pieces.where(F.col("file").isin(across)).withColumn("place", F.monotonically_increasing_id()).repartition("file").sortWithinPartitions("file", "start", "place")
    return kept.where(~F.col("file").isin(across)).unionByName(_records(ordered, with_payload, True).drop("open"))


def with_full_payloads(records: DataFrame) -> DataFrame:
    """``records`` (read with payloads) with the payload of each revisit taken from the response it refers to."""
    responses = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), F.col("payload_digest")).agg(F.first("payload").alias("held"))
    joined = records.join(responses, ["refers_to", "payload_digest"], "left")
    return joined.withColumn("payload", F.coalesce("payload", "held")).select(*records.columns)
