"""Corpus build: categorise, load, derive statistics, links and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caresift.functions import text as X
from caresift.functions.rules import Rule
from caresift.operators import categorize as C
from caresift.operators import corpus as O
from caresift.schemas import CATEGORIZED_COLUMNS
from caresift.sources.writers import insert_if_absent

RuleBook = dict[str, list[Rule]]  # rule sets by name: topic, question, pharmacology, mesh


def exam_rows(df: DataFrame, rules: RuleBook) -> DataFrame:
    done = C.categorize_mcq(df, rules["topic"], rules["question"], rules["pharmacology"])
    return done.withColumn("has_explanation", X.has_explanation(F.col("exp"))).withColumn("correct", X.option_letter(F.col("cop")))


def literature_rows(df: DataFrame, rules: RuleBook) -> DataFrame:
    done = C.categorize_literature(df, rules["mesh"], rules["question"])
    return done.withColumn("mesh_terms", F.coalesce("context.meshes", F.array().cast("array<string>"))).withColumn("has_explanation", F.lit(True))


def consumer_rows(df: DataFrame, rules: RuleBook) -> DataFrame:
    kept = df.where(X.filled(F.col("answer")))
    done = C.categorize_consumer(kept, rules["question"])
    return (
        done.withColumn("id", X.composite_key(F.col("source"), F.col("question_id")))
        .withColumn("quality_tier", C.explanation_tier(F.col("answer"))).withColumn("has_explanation", F.lit(True))
    )


def dialogue_rows(df: DataFrame, rules: RuleBook) -> DataFrame:
    kept = df.where(X.filled(F.col("input")) & X.filled(F.col("output")))
    return C.dialogue_tier(C.categorize_dialogue(kept, rules["question"]), "output").withColumn("has_explanation", F.lit(True))


def load(tables: dict[str, tuple[DataFrame, list[str]]], root: str) -> dict[str, int]:
    """Insert each table's new rows under ``root``; ``tables`` gives rows and key columns; returns rows added."""
    return {name: insert_if_absent(rows, f"{root}/{name}", keys) for name, (rows, keys) in tables.items()}


def united(exam: DataFrame, literature: DataFrame, consumer: DataFrame, dialogue: DataFrame) -> DataFrame:
    """The four record kinds in the common schema."""
    return O.union_tables([
        O.harmonised(exam, "medmcqa", F.col("id"), F.col("question"), F.col("subject_name"), F.col("topic_name"), F.col("has_explanation")),
        O.harmonised(literature, "pubmedqa", F.col("pubid"), F.col("question"), None,
                     F.array_join(F.coalesce("context.meshes", F.array().cast("array<string>")), ", ")),
        O.harmonised(consumer, "medquad", F.col("id"), F.col("question"), F.col("question_type"), F.col("source")),
        O.harmonised(dialogue, "healthcaremagic", F.col("row_idx"), F.col("input")),
    ]).select(*CATEGORIZED_COLUMNS)


def reports(categorized: DataFrame, datasets: list[str]) -> dict[str, DataFrame]:
    """SNK-04: the report tables of a corpus."""
    block = O.category_block(categorized, datasets)
    return {
        "stats": O.corpus_stats(categorized),
        "coverage": block,
        "top_subjects": O.top_subjects(categorized),
        "links": O.category_links(categorized),
        "pairs": O.category_pairs(categorized),
        "missing_explanations": O.missing_explanations(categorized),
        "samples": O.first_per_category(categorized, 5),
        "weakest_subjects": O.weakest_subjects(categorized),
    }
