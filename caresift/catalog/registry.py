"""The register, table access and the SQL counterparts of the rule expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caresift.functions.rules import Rule, rule_set
from caresift.sources.readers import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if there is one."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table with long texts, only the needed columns, spread over the cores."""
    return spread(table(spark, folder, name).select(*columns))


def r6(c):
    return F.round(c, 6)


# Rule sets for the given tables: their words are invented, so the keywords are frequent letter groups.
QUESTION_RULES = rule_set([
    (["eauoi", "leaux"], "heart_blood_vessels"),
    (["schung", "einlich"], "brain_nervous_system"),
    (["ntth", "whth"], "cancer"),
    (["tionou", "oreth"], "infections"),
    (["lyou", "inerth"], "eye_health"),
    (["mente", "ado"], "mental_health"),
    (["ndth"], "kidney_urinary"),
    (["hesh", "erou"], "skin_dermatology"),
    (["onen", "thth"], "dental_oral"),
    (["quech"], "medications_drug_safety"),
])
TOPIC_RULES = rule_set([
    (["src1"], "breathing_lungs"), (["src2", "src3"], "cancer"), (["src7"], "infections"), (["src9"], "kidney_urinary"),
])
PHARMA_RULES = rule_set([
    (["src4"], "heart_blood_vessels"), (["leaux", "src5"], "mental_health"), (["quech"], "infections"),
])
MESH_RULES = rule_set([
    (["onen"], "cancer"), (["ndth", "hesh", "thth"], "heart_blood_vessels"), (["eaux", "tion"], "mental_health"),
    (["chung", "heit"], "brain_nervous_system"), (["ado", "mente"], "dental_oral"),
])


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_any(column: str, keywords: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_text(k)})" for k in keywords) + ")"


def sql_count(column: str, keywords: Sequence[str]) -> str:
    return "(" + " + ".join(f"contains({column}, {sql_text(k)})::INT" for k in keywords) + ")"


def sql_first(column: str, rules: Sequence[Rule], other_than: str | None = None) -> str:
    guard = (lambda c: f"{other_than} <> {sql_text(c)} AND ") if other_than else (lambda c: "")
    return "CASE " + " ".join(f"WHEN {guard(r.category)}{sql_any(column, r.keywords)} THEN {sql_text(r.category)}" for r in rules) + " END"


def sql_map(column: str, mapping: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v) if isinstance(v, str) else v}" for k, v in mapping.items()) + " END"
