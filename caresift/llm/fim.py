"""Fill-in-middle: documents cut at two places into prefix, middle and suffix, and put together in another order.

Cuts stand between units: a run of ASCII letters, or any other code point.  They are found on 64-bit words of the UTF-8
bytes: arithmetic on a word marks the last byte of every unit in that byte's top bit, a population count per word and
its running sum say in which word the k-th mark lies, and a multiplication in that word counts its marks byte by byte.
Texts are scanned once, in slices, and never decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caresift.llm.common import small_batches, text_slices

#: The marks in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _each(byte: int) -> np.uint64:
    return np.uint64(byte * 0x0101010101010101)


_ONES, _TOP, _LOW, _CASE = _each(0x01), _each(0x80), _each(0x7F), _each(0x20)
#: Added to seven bits, these carry into the top bit from "a" on, and from the character behind "z" on.
_FROM_A, _BEHIND_Z = _each(0x80 - ord("a")), _each(0x80 - ord("z") - 1)


class Marks:
    """One mark per byte of some bytes, in the top bits of little-endian words; rank and select on them."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many marks stand before each byte."""
        word, byte = place >> 3, (place & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def behind(self, number: np.ndarray) -> np.ndarray:
        """The byte behind the mark of each number, counted from 1."""
        word = np.searchsorted(self.before, number, "left") - 1
        left = (number - self.before[word]).astype(np.uint64)
        # Byte j of the product is the number of marks in bytes 0 to j; those below the wanted number come first.
        counts = (self.words[word] >> np.uint64(7)) * _ONES
        reached = ((counts | _TOP) - left * _ONES) & _TOP
        return (word << 3) + 9 - np.bitwise_count(reached)


def text_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[Marks, Marks]:
    """Marks of the last bytes of units and of the first bytes of code points, for texts that lie one after the other."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[:len(data)] = data
    words = padded.view("<u8")
    seven = (words | _CASE) & _LOW
    letter = (seven + _FROM_A) & ~(seven + _BEHIND_Z) & ~words & _TOP
    inner = words & ~(words << np.uint64(1)) & _TOP  # 10xxxxxx: a later byte of a code point

    def following(marks: np.ndarray) -> np.ndarray:
        out = marks >> np.uint64(8)
        out[:-1] |= marks[1:] << np.uint64(56)
        return out

    ends = (letter & ~following(letter)) | (~letter & ~following(inner) & _TOP)
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    # A letter at the end of a text ends its unit, whatever the next text begins with.
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) << np.uint64(3)))
    return Marks(ends), Marks(~inner & _TOP)


def _draws(doc_id: Column) -> list[Column]:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", transformed: int = 90, suffix_first: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: one row per row of ``docs``.

    ``n`` is the number of units.  Four numbers drawn from the id's hash place both cuts and choose the form: ``plain``
    (the text as it is) for all but ``transformed`` in a hundred, else ``spm`` (suffix, prefix, middle) for
    ``suffix_first`` in a hundred and ``psm`` (prefix, suffix, middle).  Texts that are empty or hold one of the marks stay
    plain, so that ``restored`` can undo every form.  A null text counts as empty, a null id as the empty string; repeated rows
    come out alike; other columns of ``docs`` are not looked at.
    """
    small_batches(docs.sparkSession)
    held = F.coalesce(F.col(text), F.lit(""))
    first, second, third, fourth = _draws(F.col(doc_id))
    plain = (held == "") | held.contains(PREFIX) | held.contains(SUFFIX) | held.contains(MIDDLE) | (third % 100 >= transformed)
    form = F.when(plain, "plain").when(fourth % 100 < suffix_first, "spm").otherwise("psm")
    source = docs.select(F.col(doc_id).alias("doc_id"), form.alias("form"), first.alias("first"), second.alias("second"), held.alias("text"))
    schema = T.StructType([
        source.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, draws = batch.column(1).to_pylist(), [batch.column(k).to_numpy() for k in (2, 3)]
            for low, high, data, offsets in text_slices(batch.column(4)):
                ends, starts = text_marks(data, offsets)
                before = ends.rank(offsets)
                n = np.diff(before)
                cuts = np.sort(np.stack([x[low:high] % (n + 1) for x in draws]), axis=0)
                # A cut before the first unit has no unit in front of it.
                places = np.where(cuts > 0, ends.behind(np.maximum(before[:-1] + cuts, 1)), offsets[:-1])
                chars = starts.rank(np.concatenate([offsets[:-1], places[0], places[1]])).reshape(3, -1)
                here = forms[low:high]
                whole = np.array([f == "plain" for f in here])
                raw = data.tobytes()
                out = [_joined(f, raw[a:p], raw[p:m], raw[m:b]) for f, a, p, m, b in zip(here, offsets[:-1], places[0], places[1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), pa.array(n), pa.array(here), pa.array(chars[1] - chars[0], mask=whole), pa.array(chars[2] - chars[1], mask=whole),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ], names=schema.names)

    return source.mapInArrow(cut, schema)


def _joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "plain":
        return prefix + middle + suffix
    before, behind = PREFIX.encode() + prefix, SUFFIX.encode() + suffix
    return (before + behind if form == "psm" else behind + before) + MIDDLE.encode() + middle


def restored(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made."""
    # No mark ends as another begins, so that parts without a mark are cut exactly where marks were put.
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix, suffix = F.when(form == "psm", part[1]).otherwise(part[2]), F.when(form == "psm", part[2]).otherwise(part[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))
