"""Filter interaction audit: what each filter removes at each place of every order of filters.

Four filters look at one text alone.  The fifth asks whether a smaller id has the identical text: an existential self-join,
written as a left-semi join of the rows with the least id of every text, on hash, exact text and smaller id.  The rows it
keeps fail the fifth filter; they are united with the rows as the other filters left them, and both become one count per
part and combination of failed filters.  All orders are worked out from these counts, at most 32 for a part.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift.llm.common import stored

FILTERS = "ABCDE"
#: The last filter's bit; the first filter has bit 1.
COPY = 16
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GROUP = ("part", "bits", "good", "toxic")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, a special character."""
    def by_words(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        return F.when(n < 200, 1).otherwise(0) + F.when(100 * distinct < 50 * n, 2).otherwise(0)

    # A lambda over one element, so that the words are cut out once.
    few = F.transform(F.array(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))), by_words)[0]
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return few + F.when(100 * capitals > 2 * F.length(text), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def _repeated(rows: DataFrame, texts: DataFrame, judged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows (``id, hash`` and others) whose text also belongs to a smaller id; ``texts``: ``id, part, hash, text``.

    Texts travel once, to find the least id of every text, and are combined before they travel.  A hash that turns out to
    stand for one text alone is as good as that text, so rows are joined by it.  Where a hash stands for several
    texts, rows (made by ``judged``) and least ids are joined by the texts themselves.  A text that a third of all rows
    have is one row on the one side of either join; the other side may be split.
    """
    least = (F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    firsts = texts.where(F.col("id").isNotNull()).groupBy("hash", "text").agg(*least)
    per_hash = firsts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("least"), F.sum("rows").alias("rows"))
    heads = stored(per_hash.where("rows > 1").withColumnRenamed("hash", "h"), "audit-heads")
    later = (F.col("hash") == F.col("h")) & (F.col("id") > F.col("least"))
    out = rows.join(heads.where("texts = 1"), later, "left_semi")
    several = heads.where("texts > 1").select(F.col("h").alias("hash"))
    if several.isEmpty():
        return out
    exact = stored(texts.join(several, "hash", "left_semi"), "audit-several-texts")
    by_text = exact.where(F.col("id").isNotNull()).groupBy("hash", "text").agg(*least).withColumnsRenamed({"hash": "h", "text": "t"})
    again = judged(exact).withColumnRenamed("text", "exact").join(stored(by_text, "audit-firsts"), later & (F.col("exact") == F.col("t")), "left_semi")
    return out.unionByName(again.select(*rows.columns))


def combinations(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``part, bits, good, toxic, n``: documents per part, combination of failed filters, and labels (0 or 1).

    Null texts and parts count as empty.  A row is a document: repeated rows count each, and rows of one id are no
    copies of each other.  A null id has no smaller id, is smaller than none, and has no label.  Of several labels of an id
    the larger holds.
    """
    held = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), digest(held).alias("hash"), held.alias("text"))
    one = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = stored(labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1))).groupBy(F.col("doc_id").alias("id")).agg(*one), "audit-labels")

    def labelled(some: DataFrame) -> DataFrame:
        # Null ids would all meet in one task of the outer join.
        with_id = some.where(F.col("id").isNotNull()).join(known, "id", "left").fillna(0, ["good", "toxic"])
        return with_id.unionByName(some.where(F.col("id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)}))

    bits = text_failures(F.col("text"))
    # Only numbers travel to the labels: the text ends at its bits.
    numbers = stored(texts.withColumn("bits", bits).drop("text"), "audit-bits")
    rows = stored(labelled(numbers), "audit-rows")
    copied = _repeated(rows, texts, lambda some: labelled(some.withColumn("bits", bits)))
    # A copy leaves the combination of its other failures and enters that one with the last filter's.
    moved = F.explode(F.array(F.struct(F.col("bits").alias("bits"), F.lit(-1).alias("n")), F.struct((F.col("bits").bitwiseOR(COPY)).alias("bits"), F.lit(1).alias("n"))))
    both = rows.select(*_GROUP, F.lit(1).alias("n")).unionByName(copied.select("part", "good", "toxic", moved.alias("m")).select("part", "m.bits", "good", "toxic", "m.n"))
    return both.groupBy(*_GROUP).agg(F.sum("n").alias("n")).where("n <> 0")


def _orders() -> Column:
    """Every order of the filters with its steps, the filter's bit and the bits of the filters before it."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            steps.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the result of ``combinations``: counts of documents within the part.

    ``kept`` after the step and ``removed`` by it; ``redundant``: removed earlier although failing the step's filter;
    ``unique_fails``: failing this filter only; ``good_lost`` and ``toxic_lost``: removed here with that label;
    ``shapley``: what the filter removes, summed over all orders.
    """
    cells = counts.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
    ).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))
    steps = cells.select("part", "cells", F.explode(_orders()).alias("s")).select("part", "cells", "s.*")

    def total(where: Callable[[Column], Column], what: Callable[[Column], Column] = lambda c: c["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda t, c: t + F.when(where(c["bits"]), what(c)).otherwise(0))

    def fails(bits: Column) -> Column:
        return bits.bitwiseAND(F.col("bit")) != 0

    def in_time(bits: Column) -> Column:
        return bits.bitwiseAND(F.col("before")) == 0

    def here(bits: Column) -> Column:
        return fails(bits) & in_time(bits)

    n_orders = len(list(permutations(FILTERS)))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda b: in_time(b) & ~fails(b)).alias("kept"),
        total(here).alias("removed"),
        total(lambda b: fails(b) & ~in_time(b)).alias("redundant"),
        total(lambda b: b == F.col("bit")).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        # Of the filters a document fails, each comes first in the same number of orders.
        total(fails, lambda c: c["n"] * F.floor(n_orders / F.bit_count(c["bits"]))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``interactions`` of the ``combinations`` of ``docs``; an empty table gives no row."""
    return interactions(combinations(docs, labels, doc_id, text, part, digest))
