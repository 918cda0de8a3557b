"""Personal data: pattern spans, and information-theoretic sanitisation of what else reveals them.

The protected entities are the values that the patterns find (an address, a number).  Over the whole corpus, the
pointwise mutual information of entity and term in documents says how strongly a term reveals an entity; as a share of
the entity's own information it is at most 1, reached by a term that occurs with the entity only.  In a document with
the entity, terms whose share reaches the threshold are generalised to their first letters, if these reveal it less
than the threshold, and removed otherwise.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift.llm.common import stored

#: The kinds in their order, with patterns that match what the stated ones match.  Quantifiers are
#: possessive and starts inside a run are skipped, where that changes nothing, so that long runs take linear time.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}{3,}+"
STEM = 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(\.{_PART}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _positions(text: Column, pattern: str, keep) -> Column:
    """Matches with start and end: the lengths of matches and of what stands between them add up to the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["between"])
        end = start + F.length(pair["found"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("value"))
        spans = F.when(pair["found"].isNotNull() & keep(pair["found"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(F.coalesce(end, state["at"]).alias("at"), spans.alias("spans"))

    pairs = F.arrays_zip(between.alias("between"), found.alias("found"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"]


def base_spans(text: Column) -> Column:
    """Pattern spans of a text (null: none), by start and then kind: start, number of the kind, end, value."""
    text = F.coalesce(text, F.lit(""))
    hints = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    parts = []
    for number, kind in enumerate(KINDS[:4]):
        spans = F.when(hints[kind], _positions(text, PATTERNS[kind], lambda v, k=kind: F.coalesce(_valid(k, v), F.lit(False)))).otherwise(none)
        parts.append(F.transform(spans, _of_kind(number)))
    return F.sort_array(F.concat(*parts))


def _of_kind(number: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))


def _replaced(text: Column, spans: Column, put) -> Column:
    """``text`` with spans (sorted by start) replaced by ``put(span)``; what overlaps an earlier one is left out."""
    def step(state: Column, span: Column) -> Column:
        fits = span["start"] >= state["at"]
        head = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(
            F.when(fits, span["end"]).otherwise(state["at"]).alias("at"),
            F.when(fits, F.concat(state["text"], head, put(span))).otherwise(state["text"]).alias("text"),
        )

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step)
    return F.concat(done["text"], F.substring(text, done["at"] + 1, F.length(text)))


def _masked(text: Column, spans: Column) -> Column:
    """Pattern spans blanked out; every position stays what it was, but for partly overlapping spans' tails."""
    def step(state: Column, span: Column) -> Column:
        start = F.greatest(span["start"], state["at"])
        head = F.substring(text, state["at"] + 1, F.greatest(start - state["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(span["end"] - start, F.lit(0)))
        return F.struct(F.greatest(span["end"], state["at"]).alias("at"), F.concat(state["text"], head, blank).alias("text"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step)
    return F.concat(done["text"], F.substring(text, done["at"] + 1, F.length(text)))


def _terms(text: Column) -> Column:
    """Distinct lower-cased terms of a text and their first letters, the latter marked with a star."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    return F.concat(words, F.array_distinct(F.transform(words, _stem)))


def _stem(term: Column) -> Column:
    return F.concat(F.substring(term, 1, STEM), F.lit("*"))


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, min_documents: int = 1) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, terms, sanitised``.

    ``base``: pattern spans (start, kind, end, value); ``terms``: start, end, term and whether its first letters may
    stay.  ``sanitised``: the text with every span replaced (null texts: empty).  Positions count code points.

    Counts are over all rows, repeated ones included, and entities found in one row only are protected like others.  An
    entity or pair found in fewer than ``min_documents`` rows is taken as no evidence and reveals nothing; at 1, the
    default, none is left out.  Terms inside pattern spans are not terms of their document.
    """
    base = base_spans(F.col("text"))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Written once: the patterns run once, and texts without an entity need not be carried on.
    found = stored(source.withColumn("base", base), "pii-spans")
    n_rows = found.count()
    holding = found.where(F.size("base") > 0)
    # Copies of a text are worked on once, with their number as weight; the id is written, so it stays the same.
    texts = stored(
        holding.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count(F.lit(1)).alias("n"))
        .withColumn("text_id", F.monotonically_increasing_id()),
        "pii-texts",
    )

    entities = texts.select("text_id", "n", F.explode(F.array_distinct(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("value"))))).alias("value"))
    # Entities that stand in the same texts have the same counts with every term: they are counted once, as one class,
    # known by two sums over the hashes of its texts.  A row of many addresses is mostly one class.
    in_texts = F.struct(*[F.bit_xor(F.xxhash64(F.lit(seed), "text_id")).alias(f"sum{seed}") for seed in (1, 2)])
    classes = (
        entities.groupBy("value").agg(F.sum("n").alias("n_entity"), in_texts.alias("class"), F.count(F.lit(1)).alias("n_texts"))
        .where((F.col("n_entity") >= min_documents) & (F.col("n_entity") < n_rows))
        .select("value", F.struct("class", "n_entity", (F.col("n_texts") == 1).alias("alone")).alias("entity"))
    )
    protected = (
        entities.join(classes, "value").groupBy("text_id").agg(F.collect_set("entity").alias("entities"))
        .withColumn("most", F.array_max(F.transform("entities", lambda e: e["n_entity"])))
    )
    document_counts = source.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))

    def share(pair: Column, entity: Column, term: Column) -> Column:
        return F.log2(pair * n_rows / (entity * term)) / F.log2(F.lit(float(n_rows)) / entity)

    def most_share(entity: Column) -> Column:
        """No pair can have a greater share: it occurs at most as often as the rarer of the two."""
        return share(F.least(entity, F.col("n_term")), entity, F.col("n_term"))

    # A bound falls with the count of the term and rises with that of the entity, so that terms too common to reveal even
    # the text's most frequent entity go before they meet its entities.
    spread = (
        texts.join(protected.select("text_id", "most"), "text_id")
        .select("text_id", "n", "most", F.explode(_terms(_masked(F.col("text"), F.col("base")))).alias("term"))
        .join(document_counts, "term").where(most_share(F.col("most")) >= threshold - 1e-9).drop("most")
        .join(protected.drop("most"), "text_id")
        .select("text_id", "n", "term", "n_term", F.explode("entities").alias("e"))
        .select("text_id", "n", "term", "n_term", F.col("e.class").alias("class"), "e.n_entity", "e.alone")
        .where(most_share(F.col("n_entity")) >= threshold - 1e-9)
    )
    spread = stored(spread, "pii-pairs")
    # Entities of one text occur with its terms as often as the text does: nothing to count.
    alone = spread.where(F.col("alone") & (F.col("n") >= min_documents) & (share(F.col("n"), F.col("n_entity"), F.col("n_term")) >= threshold))
    pairs = spread.where(~F.col("alone")).groupBy("class", "term").agg(F.sum("n").alias("n_pair"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    telling = pairs.where((F.col("n_pair") >= min_documents) & (share(F.col("n_pair"), F.col("n_entity"), F.col("n_term")) >= threshold)).select("class", "term")
    risky = alone.select("text_id", "class", "term").unionByName(
        spread.where(~F.col("alone")).select("text_id", "class", "term").join(telling, ["class", "term"])
    )
    # First letters that are risky themselves stand among the terms of the same text and entity.
    is_stem = F.col("term").endswith("*")
    told = (
        risky.groupBy("text_id", "class", F.when(is_stem, F.col("term")).otherwise(_stem(F.col("term"))).alias("stem"))
        .agg(F.collect_list(F.when(~is_stem, F.col("term"))).alias("words"), (~F.bool_or(is_stem)).alias("stays"))
        .select("text_id", F.explode("words").alias("term"), "stays")
        .groupBy("text_id", "term").agg(F.bool_and("stays").alias("stays"))
        .groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "stays"))).alias("told"))
    )
    spotted = F.filter(
        F.transform(
            _positions(_masked(F.col("text"), F.col("base")), TERM, lambda v: F.map_contains_key(F.col("told"), F.lower(v))),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.element_at(F.col("told"), F.lower(s["value"])).alias("stays")),
        ),
        lambda s: s["stays"].isNotNull(),
    )
    by_text = texts.join(told, "text_id").select("digest", spotted.alias("terms"))
    no_terms = F.array().cast(by_text.schema["terms"].dataType)
    # Rows without an entity find nothing: their key only spreads them.
    key = F.when(F.size("base") > 0, F.sha2("text", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id", "text")))
    with_terms = found.withColumn("digest", key).join(by_text, "digest", "left")
    spans = F.sort_array(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.upper(F.concat(F.lit("["), F.element_at(F.lit(list(KINDS)), s["kind"] + 1), F.lit("]"))).alias("put"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end"), F.when(s["stays"], _stem(s["value"])).otherwise("").alias("put"))),
    ))
    return with_terms.select("doc_id", "text", "base", F.coalesce("terms", no_terms).alias("terms")).select("doc_id", "base", "terms", _replaced(F.col("text"), spans, lambda s: s["put"]).alias("sanitised"))


def span_string(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, of spans with start, kind and end."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _if_kind(number: int):
    return lambda s: F.when(s["kind"] == number, F.lit(1))


def digest_columns(result: DataFrame) -> DataFrame:
    """The columns of the test query, from the result of ``sanitised``."""
    every = F.sort_array(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end"))),
    ))
    counts = [F.size(F.array_compact(F.transform("base", _if_kind(n)))).cast("bigint").alias(f"n_{k}") for n, k in enumerate(KINDS[:4])]
    return result.select("doc_id", *counts, F.sha2(span_string(F.col("base")), 256).alias("base_sha256"), span_string(every).alias("spans"), F.size("terms").cast("bigint").alias("n_term"))
