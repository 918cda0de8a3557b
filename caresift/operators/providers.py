"""Batch calls to external models (UDF-01 … UDF-04).

A provider is a picklable function from a list of texts to a list of results; it runs inside tasks on Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
TextModel = Callable[[list[str]], list[str]]


def hashed_words(dim: int = 64) -> Embedder:
    """A deterministic embedder for tests: signed hashed bag of words, unit length."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if (h >> 32) & 1 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def _in_batches(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i:i + size]


def embed_chunks(chunks: DataFrame, embedder: Embedder, model: str, batch: int = 100, attempts: int = 2) -> DataFrame:
    """UDF-01: ``chunks`` (source_table, source_id, chunk_text) with ``embedding`` and ``model``.

    Calls take at most ``batch`` texts.  A call that fails ``attempts`` times leaves its rows out; they are still
    missing from the target and come again with the next run.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows in _in_batches(list(frame.index), batch):
                part = frame.loc[rows]
                vectors = _tried(lambda: embedder(part["chunk_text"].tolist()), attempts)
                if vectors is not None:
                    yield part.assign(embedding=vectors, model=model)

    return chunks.select("source_table", "source_id", "chunk_text").mapInPandas(
        run, "source_table string, source_id string, chunk_text string, embedding array<float>, model string"
    )


def embedding_summary(chunks: DataFrame, target: DataFrame) -> DataFrame:
    """AG-45: per source table how many chunks there are, are embedded, and are missing (not reached yet or failed)."""
    done = target.select("source_table", "source_id").distinct().withColumn("_done", F.lit(True))
    joined = chunks.select("source_table", "source_id").distinct().join(done, ["source_table", "source_id"], "left")
    return joined.groupBy("source_table").agg(
        F.count(F.lit(1)).alias("chunks"), F.count("_done").alias("embedded"), F.count_if(F.col("_done").isNull()).alias("missing")
    )


def _tried(call: Callable, attempts: int):
    for _ in range(attempts):
        try:
            return call()
        except Exception:  # a provider may fail in any way; its batch is given up, not the job
            continue
    return None


def ask_model(requests: DataFrame, model: TextModel, prompt: str = "prompt", batch: int = 100, attempts: int = 3) -> DataFrame:
    """UDF-02: adds ``response``; every distinct prompt is asked once and prompts that fail have a null response.

    The distinct prompts are the cache: repeated prompts cost one call, however many rows ask them.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for texts in _in_batches(frame[prompt].tolist(), batch):
                answers = _tried(lambda: model(texts), attempts)
                yield pd.DataFrame({prompt: texts, "response": answers if answers is not None else [None] * len(texts)})

    distinct = requests.select(prompt).where(F.col(prompt).isNotNull()).distinct()
    answered = distinct.mapInPandas(run, f"`{prompt}` string, response string")
    return requests.join(answered, prompt, "left")


def inferred_comorbidity(pairs: DataFrame, categories: list[str], ceiling: float = 0.20) -> DataFrame:
    """UDF-02: boosts a model named for pairs of conditions; each unordered pair once, unknown categories dropped.

    ``pairs`` has ``condition_a, condition_b, response`` where the response is a JSON array, maybe fenced.
    """
    inner = F.when(F.col("response").contains("```"), F.regexp_extract("response", r"(?s)```(?:json)?\s*(.*?)```", 1)).otherwise(F.col("response"))
    items = F.from_json(inner, "array<struct<category:string,score:double,reasoning:string>>")
    return (
        pairs.withColumn("a", F.least("condition_a", "condition_b")).withColumn("b", F.greatest("condition_a", "condition_b"))
        .groupBy("a", "b").agg(F.min("response").alias("response"))
        .select("a", "b", F.explode(items).alias("i")).where(F.col("i.category").isin(categories))
        .select("a", "b", "i.category", F.least(F.coalesce("i.score", F.lit(0.10)), F.lit(ceiling)).alias("boost"), "i.reasoning")
    )


# --- fixed values: reading-level instructions ---------------------------------------------------------------
LITERACY = {
    "low": "Use very simple language. Aim for a 6th-grade reading level. Avoid medical jargon.",
    "medium": "Use plain language. Aim for a 10th-grade reading level. Define medical terms when used.",
    "high": "You may use clinical terminology. The reader has strong health literacy.",
}


def literacy_instruction(level: Column) -> Column:
    """UDF-03: the instruction for a reading level (medium when unknown)."""
    table = F.create_map(*[F.lit(x) for pair in LITERACY.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(level)), F.lit(LITERACY["medium"]))


def _head(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def evidence_block(hits: Column, chars: int | None = None) -> Column:
    """UDF-03: numbered evidence lines from an ordered array of hits, each with its text or the first ``chars`` of it."""
    lines = F.transform(hits, lambda h, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] ["), h["quality_tier"], F.lit("] ("), h["source_table"], F.lit("): "),
        _head(h["chunk_text"], chars)))
    return F.when(F.size(hits) > 0, F.array_join(lines, "\n\n")).otherwise(F.lit("No specific evidence retrieved."))


def profile_lines(age: Column, sex: Column, conditions: Column, medications: Column, most: int | None = None) -> Column:
    """UDF-03: the user-context lines; parts that are unknown are left out, and of names those behind the first ``most``."""
    def names(c: Column) -> Column:
        every = F.transform(c, lambda x: x["name"])
        return F.array_join(every if most is None else F.slice(every, 1, most), ", ")

    return F.concat_ws(
        "\n",
        F.when(age > 0, F.concat(F.lit("Age: "), age.cast("string"))),
        F.when(sex.isNotNull() & (sex != "prefer_not_to_say"), F.concat(F.lit("Sex: "), sex)),
        F.when(F.size(conditions) > 0, F.concat(F.lit("Active conditions: "), names(conditions))),
        F.when(F.size(medications) > 0, F.concat(F.lit("Current medications: "), names(medications))),
    )


def _listed(c: Column) -> Column:
    """An array of texts as ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def _texts(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


# --- fixed values: wording of the trace of an answered query ------------------------------------------------
TRACE = {
    "classified": "Agent A: classified query as '%s' using %s method",
    "terms": "Agent A: normalized terms -> ",
    "no_terms": "Agent A: no term normalization applied",
    "plan": "Agent B: retrieval plan built — must_load=%s, may_load=%s",
    "search": "Agent C: hybrid search (pgvector + FTS, RRF fusion) returned %d results",
    "verified": "Agent D: confidence=%.2f — disclaimer=%s",
    "flags": "Agent D: uncertainty flags -> ",
    "no_context": "(no brain context loaded)",
    "retrieved": "Retrieved %d results via RRF fusion",
}
ITEM = "array<struct<source:string,content:string,relevance_score:double>>"
CALL = "array<struct<tool_name:string,query:string,category:string,result:string>>"


def trace_of(query: Column, category: Column, method: Column, terms: Column, must_load: Column, may_load: Column, context: Column,
             hits: Column, confidence: Column, disclaimer: Column, flags: Column, citations: Column, answer: Column, context_chars: int | None = None) -> Column:
    """PRJ-18: the execution trace of an answered query as a struct, from the columns of its stages.

    The context stands in it whole, or with its first ``context_chars`` characters.
    ``hits`` and ``citations`` are arrays of hit structs; ``terms``, ``must_load``, ``may_load`` and ``flags`` of texts.
    """
    found = F.coalesce(F.size(hits), F.lit(0))
    named = F.coalesce(category, F.lit("unknown"))
    tables = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["source_table"])))
    reasoning = F.array(
        F.format_string(TRACE["classified"], named, F.coalesce(method, F.lit("unknown"))),
        F.when(F.size(_texts(terms)) > 0, F.concat(F.lit(TRACE["terms"]), F.array_join(terms, ", "))).otherwise(F.lit(TRACE["no_terms"])),
        F.format_string(TRACE["plan"], _listed(_texts(must_load)), _listed(_texts(may_load))),
        F.concat(F.format_string(TRACE["search"], found), F.when(found > 0, F.concat(F.lit(" from "), F.array_join(tables, ", "))).otherwise(F.lit(""))),
        F.format_string(TRACE["verified"], confidence, F.when(disclaimer.isNotNull(), "applied").otherwise("none")),
        F.when(F.size(_texts(flags)) > 0, F.concat(F.lit(TRACE["flags"]), F.array_join(flags, ", "))),
    )
    no_text = F.lit(None).cast("string")
    return F.struct(
        F.coalesce(answer, F.lit("")).alias("final_answer"),
        F.array(
            F.struct(F.lit("brain_graph").alias("tool_name"), no_text.alias("query"), named.alias("category"),
                     F.when(F.coalesce(context, F.lit("")) != "", _head(context, context_chars)).otherwise(F.lit(TRACE["no_context"])).alias("result")),
            F.struct(F.lit("hybrid_db_search").alias("tool_name"), query.alias("query"), named.alias("category"), F.format_string(TRACE["retrieved"], found).alias("result")),
        ).cast(CALL).alias("tool_calls"),
        F.array_compact(reasoning).alias("reasoning_trace"),
        F.array().cast("array<string>").alias("corrections"),
        F.coalesce(F.transform(citations, lambda c: F.struct(
            c["source_table"].alias("source"), c["chunk_text"].alias("content"), c["relevance_score"].alias("relevance_score"))).cast(ITEM),
            F.array().cast(ITEM)).alias("retrieval_results"),
    )


def trace_or_default(trace: Column, response: Column) -> Column:
    """PRJ-18: the recorded trace, or one that holds only the response."""
    return F.coalesce(trace, F.struct(
        response.alias("final_answer"), F.array().cast(CALL).alias("tool_calls"), F.array().cast("array<string>").alias("reasoning_trace"),
        F.array().cast("array<string>").alias("corrections"), F.array().cast(ITEM).alias("retrieval_results")))


def responses_joined(prompts: DataFrame, responses: DataFrame, key: str = "prompt_id") -> DataFrame:
    """UDF-04: the sampler interface as data: prompts with the responses that were produced for them."""
    return prompts.join(responses, key, "left")
