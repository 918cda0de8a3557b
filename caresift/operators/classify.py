"""Query classification and condition matching (CLS-09 … CLS-13, JN-05).

Computed arrays are exploded with ``explode_outer`` and a null test: for a plain ``explode`` the optimizer adds a
``size > 0`` filter below it and evaluates the array twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from caresift import constants as K
from caresift.functions import text as X
from caresift.functions.rules import any_keyword, bound
from caresift.session import cut_lineage

MAX_INLINE = 2_000
#: Bounds of one automaton (its nodes are at most its characters) and of the rows written at once.
PART_PHRASES = 200_000
PART_CHARS = 4_000_000
OUT_ROWS = 4_096
MAX_CENTROIDS = 4_096


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must be small, or an error; never more than ``limit`` rows reach the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def contained(df: DataFrame, text: Column, phrases: DataFrame, phrase: str, inline: int = MAX_INLINE,
              part_phrases: int = PART_PHRASES, part_chars: int = PART_CHARS) -> DataFrame:
    """JN-05: rows of ``df`` with every phrase that is a substring of ``text``, as ``(df columns, phrase columns)``.

    Null and empty phrases are contained in nothing.  Up to ``inline`` phrases become one literal array that is searched
    inside the row.  More than that go into Aho-Corasick automata, which find all of them in one pass over a text:
    short or common phrases are no hot keys, and texts are not shuffled.  A phrase table beyond ``part_phrases`` rows or
    ``part_chars`` characters is split: if the texts are few (``part_phrases`` rows and ``part_chars`` characters at most), they
    go to the tasks that hold the phrases, and each task builds automata of its own phrases; else by the hash of the phrase, one
    automaton and one pass over ``df`` each.  Phrases are computed once, and written first.
    """
    phrases = cut_lineage(phrases.where(F.length(phrase) > 0))
    sample = phrases.limit(inline + 1).collect()
    if len(sample) <= inline:
        if not sample:
            return df.join(phrases, F.lit(False))
        names = phrases.columns
        table = F.from_json(F.lit(json.dumps([row.asDict() for row in sample])), ArrayType(phrases.schema))  # folds to one literal
        return (
            df.withColumn("_hit", F.explode_outer(bound(text, lambda t: F.filter(table, lambda p: F.contains(t, p[phrase])))))
            .where(F.col("_hit").isNotNull())
            .select(*df.columns, *[F.col(f"_hit.{n}").alias(n) for n in names])
        )
    source = df.select(*df.columns, text.alias("_searched"))
    schema = StructType([*df.schema.fields, *phrases.schema.fields])
    if _part_count(phrases, phrase, part_phrases, part_chars) > 1:
        source = source.where(F.length("_searched") > 0)
        if _part_count(source, "_searched", part_phrases, part_chars) == 1:
            return phrases.mapInArrow(_searcher(_sent(source), phrase, part_phrases, part_chars), schema)
    found = [source.mapInArrow(_finder(part, phrase), schema) for part in phrase_parts(phrases, phrase, part_phrases, part_chars)]
    return reduce(DataFrame.unionAll, found)


def phrase_parts(phrases: DataFrame, phrase: str, part_phrases: int = PART_PHRASES, part_chars: int = PART_CHARS) -> Iterator[Broadcast]:
    """The phrase table in bounded parts, each sent to the tasks as Arrow data; the driver holds one part at a time."""
    parts = _part_count(phrases, phrase, part_phrases, part_chars)
    for number in range(parts):
        yield _sent(phrases if parts == 1 else phrases.where(F.pmod(F.xxhash64(phrase), F.lit(parts)) == number))


def _part_count(rows: DataFrame, text: str, part_rows: int, part_chars: int) -> int:
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars")).first()
    return max(-(-size.n // part_rows), -(-(size.chars or 0) // part_chars), 1)


def _sent(df: DataFrame) -> Broadcast:
    """A bounded table as Arrow data for all tasks."""
    sink = pa.BufferOutputStream()
    rows = df.toArrow()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    """Automaton whose values are the positions of a phrase in ``words``."""
    places: dict[str, list[int]] = {}
    for at, word in enumerate(words):
        places.setdefault(word, []).append(at)
    automaton = ahocorasick.Automaton()
    for word, found in places.items():
        automaton.add_word(word, found)
    if places:
        automaton.make_automaton()
    return automaton


def _finder(part: Broadcast, phrase: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(part.value).read_all().combine_chunks()
        automaton = _automaton(table.column(phrase).to_pylist())
        yield from _hits(automaton, table, batches)

    return find


def _hits(automaton: ahocorasick.Automaton, table: pa.Table, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``batches``, whose last column is searched, with the rows of ``table`` whose phrases are found."""
    for batch in batches:
        if not len(automaton):
            continue
        at: list[int] = []
        hits: list[int] = []
        for row, text in enumerate(batch.column(batch.num_columns - 1)):
            value = text.as_py()
            if value:
                for places in {places[0]: places for _, places in automaton.iter(value)}.values():
                    at.extend([row] * len(places))
                    hits.extend(places)
            if len(at) >= OUT_ROWS:
                yield from _joined(batch, table, at, hits)
                at, hits = [], []
        yield from _joined(batch, table, at, hits)


def _searcher(texts: Broadcast, phrase: str, part_phrases: int, part_chars: int):
    """As ``_finder``, the other way round: a few texts are searched for the phrases a task holds, one automaton per bounded part of them."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.ipc.open_stream(texts.value).read_all().combine_chunks().to_batches()
        for table in _bounded(batches, phrase, part_phrases, part_chars):
            yield from _hits(_automaton(table.column(phrase).to_pylist()), table, rows)

    return search


def _bounded(batches: Iterator[pa.RecordBatch], phrase: str, part_phrases: int, part_chars: int) -> Iterator[pa.Table]:
    """Batches put together until they have ``part_phrases`` rows or ``part_chars`` characters."""
    held, n, chars = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, chars = n + batch.num_rows, chars + (pc.sum(pc.utf8_length(batch.column(phrase))).as_py() or 0)
        if n >= part_phrases or chars >= part_chars:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n, chars = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _joined(batch: pa.RecordBatch, table: pa.Table, at: list[int], hits: list[int]) -> Iterator[pa.RecordBatch]:
    """Found rows with their phrases, at most ``OUT_ROWS`` at once: a text is repeated for each of its phrases."""
    for low in range(0, len(at), OUT_ROWS):
        left = batch.take(pa.array(at[low:low + OUT_ROWS], pa.int64())).columns[:-1]
        right = table.take(pa.array(hits[low:low + OUT_ROWS], pa.int64()))
        names = [*batch.schema.names[:-1], *right.schema.names]
        yield pa.RecordBatch.from_arrays([*left, *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in right.columns]], names=names)


def first_rules(df: DataFrame, lowered: Column, table: DataFrame, name: str, to: str = "category",
                part_phrases: int = PART_PHRASES, part_chars: int = PART_CHARS) -> DataFrame:
    """CLS-02 for rule sets of any size: ``df`` with the category of the first rule that hits its text, else null.

    ``table`` is ``(rule_set, rule_idx, category, keyword)``, as ``read_rules`` takes it.  Keywords are looked up with
    automata over bounded parts of the table; each part takes the best rule of the parts before it and passes the better
    one on, so that rows are neither shuffled nor repeated.  Null and empty keywords hit nothing; of two categories with
    one ``rule_idx`` the smaller name wins; rules without an index or a category are left out.
    """
    whole = (F.length("keyword") > 0) & F.col("rule_idx").isNotNull() & F.col("category").isNotNull()
    rules = table.where((F.col("rule_set") == name) & whole).select(
        F.lower("keyword").alias("keyword"), F.col("rule_idx").cast("bigint").alias("rule_idx"), "category"
    )
    least = rules.groupBy("keyword").agg(F.min(F.struct("rule_idx", "category")).alias("r")).select("keyword", "r.*")
    kept = [c for c in df.columns if c != to]
    out = df.select(*kept, lowered.alias("_searched"), F.lit(None).cast("bigint").alias("_rule"), F.lit(None).cast("string").alias("_category"))
    for part in phrase_parts(least, "keyword", part_phrases, part_chars):
        out = out.mapInArrow(_first_of(part), out.schema)
    return out.select(*kept, F.col("_category").alias(to))


def _first_of(part: Broadcast):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = pa.ipc.open_stream(part.value).read_all()
        automaton = _automaton(rules.column("keyword").to_pylist())
        order = list(zip(rules.column("rule_idx").to_pylist(), rules.column("category").to_pylist()))
        for batch in batches:
            texts, indexes, names = (c.to_pylist() for c in batch.columns[-3:])
            if len(automaton):
                for row, text in enumerate(texts):
                    hits = [order[places[0]] for _, places in automaton.iter(text)] if text else []
                    if indexes[row] is not None:
                        hits.append((indexes[row], names[row]))
                    if hits:
                        indexes[row], names[row] = min(hits)
            columns = [*batch.columns[:-2], pa.array(indexes, pa.int64()), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return find


def phrase_index(terms: DataFrame) -> DataFrame:
    """``(phrase, category)``; the category written last wins, as documents are read in order of category."""
    phrase = F.lower(X.strip(F.col("consumer_term")))
    return terms.select(phrase.alias("phrase"), "category").where(F.col("phrase") != "").groupBy("phrase").agg(F.max("category").alias("category"))


def token_index(terms: DataFrame) -> DataFrame:
    """``(token, category, weight)``: how often a token occurs in the phrases of a category."""
    return (
        terms.select("category", F.explode_outer(X.phrase_tokens(F.col("consumer_term"))).alias("token"))
        .where(F.col("token").isNotNull()).groupBy("token", "category").agg(F.count(F.lit(1)).alias("weight"))
    )


def unique_winner(hits: DataFrame) -> DataFrame:
    """WN-08: the category with the largest summed score of each query, when no other has the same.

    The scores of a query are one per category, so the map that is gathered stays small.
    """
    scores = hits.groupBy("query_id", "category").agg(F.sum("score").alias("score"))
    ranked = scores.groupBy("query_id").agg(
        F.max(F.struct("score", "category")).alias("hi"),
        F.map_from_entries(F.collect_list(F.struct("category", "score"))).alias("all"),
    )
    winners = F.size(F.filter(F.map_values("all"), lambda s: s == F.col("hi.score")))
    return ranked.where(winners == 1).select("query_id", "hi.category")


def keyword_category(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """CLS-09: ``(query_id, category)`` for queries with one clear winner by phrases, else by tokens.

    Categories are few, so the map of a query's scores is small.
    """
    phrases = contained(queries.select("query_id", "text"), X.normalized(F.col("text")), phrase_index(terms), "phrase")
    by_phrase = unique_winner(phrases.select("query_id", "category", F.lit(1).alias("score")))
    tokens = token_index(terms)
    words = queries.select("query_id", F.explode_outer(F.array_distinct(X.words(F.col("text")))).alias("token"))
    by_token = unique_winner(words.join(tokens, "token").select("query_id", "category", F.col("weight").alias("score")))
    return (
        by_phrase.withColumn("ord", F.lit(0)).unionByName(by_token.withColumn("ord", F.lit(1)))
        .groupBy("query_id").agg(F.min_by("category", "ord").alias("category"))
    )


def centroids(embeddings: DataFrame, category: str = "category", embedding: str = "embedding", min_rows: int = K.CENTROID_MIN_ROWS) -> DataFrame:
    """AG-08: mean vector of every category with enough rows, as ``(category, centroid, n)``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    metrics = Summarizer.metrics("mean", "count")
    grouped = embeddings.groupBy(category).agg(metrics.summary(array_to_vector(F.col(embedding).cast("array<double>"))).alias("s"))
    return grouped.where(F.col("s.count") >= min_rows).select(
        F.col(category).alias("category"), vector_to_array("s.mean").alias("centroid"), F.col("s.count").alias("n")
    )


def nearest_centroid(rows: DataFrame, means: DataFrame, key: str = "query_id", embedding: str = "embedding",
                     threshold: float | None = K.CENTROID_THRESHOLD) -> DataFrame:
    """CLS-10: ``(key, category, cosine)`` of the nearest centroid.

    There is one centroid per category; at most ``MAX_CENTROIDS`` are shipped to the tasks (more is an error).  Rows are
    streamed in Arrow batches, one matrix product per batch, without a shuffle.  Rows without a vector, null or empty,
    have no category and are left out.
    """
    table = bounded_rows(means.select("category", "centroid").orderBy("category"), MAX_CENTROIDS, "the centroid table")
    names = np.array([r.category for r in table], dtype=object)
    matrix = np.array([r.centroid for r in table], dtype=np.float64)
    key_type = rows.schema[key].dataType.simpleString()
    cat_type = means.schema["category"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norms = np.linalg.norm(matrix, axis=1)
        for batch in batches:
            if not len(batch) or not len(names):
                continue
            x = np.stack(batch[embedding].to_numpy()).astype(np.float64)
            cosine = x @ matrix.T / (np.linalg.norm(x, axis=1)[:, None] * norms[None, :] + 1e-9)
            cosine = np.round(cosine, 9)
            best = cosine.argmax(axis=1)
            yield pd.DataFrame({key: batch[key], "category": names[best], "cosine": cosine[np.arange(len(x)), best]})

    held = rows.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0)).select(key, embedding)
    out = held.mapInPandas(assign, f"`{key}` {key_type}, category {cat_type}, cosine double")
    return out if threshold is None else out.where(F.col("cosine") >= threshold)


def cascade(queries: DataFrame, by_keyword: DataFrame, by_centroid: DataFrame, by_model: DataFrame, known: list[str] = K.CATEGORIES,
            default: str = K.PUBLIC_HEALTH) -> DataFrame:
    """CLS-11: first answer of keyword, centroid, model; the default otherwise; with the method that answered.

    A model label counts only when it is a known category (``by_model`` has a row for every query that was asked).
    """
    k = by_keyword.select("query_id", F.col("category").alias("_k"))
    c = by_centroid.select("query_id", F.col("category").alias("_c"))
    m = by_model.select("query_id", F.lit(True).alias("_asked"), F.when(F.col("category").isin(known), F.col("category")).alias("_m"))
    joined = queries.join(k, "query_id", "left").join(c, "query_id", "left").join(m, "query_id", "left")
    return joined.withColumn("category", F.coalesce("_k", "_c", "_m", F.lit(default))).withColumn(
        "method",
        F.when(F.col("_k").isNotNull(), "keyword").when(F.col("_c").isNotNull(), "embedding")
        .when(F.col("_asked"), "llm").otherwise("fallback"),
    ).drop("_k", "_c", "_m", "_asked")


def match_conditions(names: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """CLS-12: exact registry entry, else the first entry (by name) where either contains the other.

    Only names without exact match go on to the substring search.
    """
    wanted = F.lower(X.strip(F.col(name)))
    asked = names.withColumn("_n", wanted)
    entries = registry.select(F.col("name").alias("entry"), "category", "subcategory")
    exact = asked.join(entries, asked["_n"] == entries["entry"]).select(*names.columns, "category", "subcategory")
    rest = asked.join(entries.select(F.col("entry").alias("_n")), "_n", "left_anti")
    # The least entry of each direction is found per distinct name before any requester is joined.
    wanted_names = rest.where(F.col("_n") != "").select("_n").distinct()
    first = F.min(F.struct("entry", "category", "subcategory")).alias("e")
    inside = contained(wanted_names, F.col("_n"), entries, "entry").groupBy("_n").agg(first)
    around = contained(entries, F.col("entry"), wanted_names, "_n").groupBy("_n").agg(first)
    least = inside.unionByName(around).groupBy("_n").agg(F.min("e").alias("e"))
    partial = rest.join(least, "_n").select(*names.columns, "e.category", "e.subcategory")
    return exact.unionByName(partial)


def resolve_checklist(picks: DataFrame, checklist: DataFrame) -> DataFrame:
    """CLS-13: checklist keys to conditions; unknown keys are dropped."""
    return picks.join(checklist, "key")


def medication_category(name: Column, keywords: list[tuple[str, str]]) -> Column:
    """CLS-13: category of the first drug name contained, else medications."""
    table = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(c).alias("c")) for k, c in keywords])
    lowered = F.lower(X.strip(name))
    first = bound(lowered, lambda t: F.get(F.filter(table, lambda r: F.contains(t, r["k"])), F.lit(0))["c"])
    return F.coalesce(first, F.lit(K.MEDICATIONS))


def resolve_medications(df: DataFrame, name: str, keywords: list[tuple[str, str]]) -> DataFrame:
    """CLS-13: ``df`` with trimmed medication names and their category; rows without a name, null or blank, are dropped."""
    trimmed = X.strip(F.col(name))
    return df.where(F.length(trimmed) > 0).withColumns({name: trimmed, "category": medication_category(F.col(name), keywords)})


def freetext_conditions(df: DataFrame, text: Column, rules: list[tuple[list[str], str, str]]) -> DataFrame:
    """CLS-13: one row per distinct (category, subcategory) named in free text, named after the first keyword."""
    table = F.array(*[
        F.struct(F.array(*[F.lit(k.lower()) for k in ks]).alias("ks"), F.lit(c).alias("category"), F.lit(s).alias("subcategory"))
        for ks, c, s in rules
    ])
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    hits = F.transform(
        F.filter(table, lambda r: F.exists(r["ks"], lambda k: F.contains(F.col("_t"), k))),
        lambda r: F.struct(r["category"].alias("category"), r["subcategory"].alias("subcategory"),
                           F.initcap(X.strip(F.get(F.filter(r["ks"], lambda k: F.contains(F.col("_t"), k)), F.lit(0)))).alias("name")),
    )
    first_of_each = F.filter(F.col("_h"), lambda h, i: F.array_position(
        F.transform(F.col("_h"), lambda g: F.struct(g["category"], g["subcategory"])), F.struct(h["category"], h["subcategory"])) == i + 1)
    return (
        df.withColumn("_t", padded).withColumn("_h", F.when(X.filled(text), hits))
        .withColumn("_h1", first_of_each)
        .select(*df.columns, F.explode_outer("_h1").alias("h")).where(F.col("h").isNotNull()).select(*df.columns, "h.*")
    )


def narrow_index_drug(text: Column, drugs: list[str] = K.NARROW_INDEX_DRUGS) -> Column:
    """CLS-15: the text names a drug with a narrow therapeutic index."""
    return any_keyword(F.lower(text), drugs)
