"""CLS-03 … CLS-08: categories and quality tiers of the four record kinds.  All narrow: no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift import constants as K
from caresift.functions import text as X
from caresift.functions.rules import (
    Rule, any_keyword, bound, count_array, first_match, first_match_other_than, hit_array, keyword_array, scored_categories,
)

PREVIEW = X.CUTS["preview"]


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def _preview(c: Column, chars: int | None) -> Column:
    return c if chars is None else F.substring(c, 1, chars)


def explanation_tier(explanation: Column) -> Column:
    """CLS-07."""
    # plain words go to the substring search; only real patterns need a regex
    words = [p for p in K.TEXTBOOK_PATTERNS if p.replace(" ", "").isalpha()]
    patterns = [p for p in K.TEXTBOOK_PATTERNS if p not in words]

    def tier(t: Column) -> Column:
        textbook = F.exists(keyword_array(words), lambda w: F.contains(t, w))
        for p in patterns:
            textbook = textbook | t.rlike(p)
        minimal = t.rlike("|".join(f"(?:{p})" for p in K.MINIMAL_PATTERNS))
        return (
            F.when(t.isin("", "null", "none"), "TIER_D")
            .when(textbook, "TIER_A")
            .when((F.length(t) < 50) & minimal, "TIER_C")
            .when(F.length(t) < 20, "TIER_C")
            .otherwise("TIER_B")
        )

    return bound(F.lower(X.strip(F.coalesce(explanation, F.lit("")))), tier)


def dialogue_tier(df: DataFrame, output: str, name: str = "quality_tier") -> DataFrame:
    """CLS-08: tier of a doctor's reply, from what it names, explains and recommends."""
    out = df.withColumn("_s", X.strip(F.coalesce(F.col(output), F.lit("")))).withColumn("_t", F.lower("_s"))
    s, t = F.col("_s"), F.col("_t")
    out = out.withColumn(
        "_f",
        F.struct(
            (any_keyword(t, K.CONDITION_ENDINGS) | s.rlike(r"\([A-Z]{2,6}\)")).alias("condition"),
            any_keyword(t, K.MECHANISM_PHRASES).alias("mechanism"),
            any_keyword(t, K.DRUG_SIGNALS).alias("drug"),
            any_keyword(t, K.RECOMMENDATION_PHRASES).alias("advice"),
            any_keyword(t, K.CONDITIONAL_PHRASES).alias("conditional"),
            any_keyword(t, K.DEFLECTION_PHRASES).alias("deflects"),
        ),
    )
    f = F.col("_f")
    unfinished = ~F.right(s, F.lit(1)).isin(".", "!", "?") & (F.length(s) < 300)
    tier = (
        F.when((F.length(s) < 50) | f["deflects"] | unfinished, "TIER_D")
        .when(f["condition"] & f["mechanism"] & (f["drug"] | f["conditional"]), "TIER_A")
        .when((f["condition"] | f["drug"]) & f["advice"], "TIER_B")
        .when(f["advice"], "TIER_C")
        .otherwise("TIER_D")
    )
    return out.withColumn(name, tier).drop("_s", "_t", "_f")


def categorize_mcq(
    df: DataFrame, topic_rules: Sequence[Rule], question_rules: Sequence[Rule], pharmacology_rules: Sequence[Rule]
) -> DataFrame:
    """CLS-03: adds ``primary_category``, ``secondary_category`` and ``quality_tier`` to exam records."""
    prepared = df.withColumns(
        {
            "_subject": X.strip(F.coalesce("subject_name", F.lit(""))),
            "_topic": F.lower(X.strip(F.coalesce("topic_name", F.lit("")))),
            "_q": F.lower(X.strip(F.coalesce("question", F.lit("")))),
        }
    )
    subject, topic, question = F.col("_subject"), F.col("_topic"), F.col("_q")
    prepared = prepared.withColumn("_direct", _lookup(K.SUBJECT_DIRECT, subject))
    direct = F.col("_direct")
    pharma = subject == "Pharmacology"
    prepared = prepared.withColumn(
        "_drug",
        F.when(
            direct.isNull() & pharma,
            F.coalesce(first_match(topic, pharmacology_rules), first_match(question, pharmacology_rules)),
        ),
    )
    prepared = prepared.withColumn(
        "primary_category",
        F.when(direct.isNotNull(), direct)
        .when(pharma, F.coalesce("_drug", F.lit(K.MEDICATIONS)))
        .otherwise(
            F.coalesce(
                first_match(topic, topic_rules),
                first_match(question, question_rules),
                _lookup(K.SUBJECT_BROAD, subject),
                F.lit(K.MEDICATIONS),
            )
        ),
    )
    secondary = (
        F.when(direct.isNotNull(), first_match_other_than(question, question_rules, direct))
        .when(pharma, F.when(F.col("_drug").isNotNull(), K.MEDICATIONS))
        .when((F.col("primary_category") != "cancer") & any_keyword(question, K.CANCER_SIGNALS), "cancer")
    )
    return (
        prepared.withColumn("secondary_category", secondary)
        .withColumn("quality_tier", explanation_tier(F.col("exp")))
        .drop("_subject", "_topic", "_q", "_direct", "_drug")
    )


def categorize_literature(df: DataFrame, mesh_rules: Sequence[Rule], question_rules: Sequence[Rule]) -> DataFrame:
    """CLS-04: scores by subject headings (one point a keyword) and question (two points a rule)."""
    mesh = count_array(F.lower(F.concat_ws(" ", "context.meshes")), mesh_rules)
    question = hit_array(F.lower(X.strip(F.coalesce("question", F.lit("")))), question_rules)
    scored = scored_categories([(mesh_rules, mesh, 1), (question_rules, question, 2)], K.MEDICATIONS)
    return (
        df.withColumn("_c", scored)
        .withColumns({"primary_category": F.col("_c.primary"), "secondary_category": F.col("_c.secondary"), "quality_tier": F.lit("TIER_A")})
        .drop("_c")
    )


def categorize_consumer(df: DataFrame, question_rules: Sequence[Rule], preview_chars: int | None = None) -> DataFrame:
    """CLS-05: consumer QA by site, then question, then the beginning of the answer (``None``: all of it)."""
    site = F.lower(F.coalesce("source", F.lit("")))
    question = F.lower(X.strip(F.coalesce("question", F.lit(""))))
    answer = F.lower(X.strip(F.coalesce("answer", F.lit(""))))
    route = None
    for key, category in K.SITE_ROUTES:
        if category is not None:
            route = F.when(site.contains(key), category) if route is None else route.when(site.contains(key), category)
    prepared = df.withColumns({"_q": question, "_a": answer, "_kind": F.lower(X.strip(F.coalesce("question_type", F.lit(""))))})
    prepared = prepared.withColumn(
        "_p",
        F.coalesce(
            route,
            first_match(F.col("_q"), question_rules),
            first_match(_preview(F.col("_a"), preview_chars), question_rules),
        ),
    )
    found = F.col("_p")
    looked_at = F.concat_ws(" ", "_q", _preview(F.col("_a"), None if preview_chars is None else 200))
    secondary = (
        F.when(found.isNotNull() & (found != "cancer") & any_keyword(looked_at, K.CANCER_SIGNALS), "cancer")
        .when(F.col("_kind").isin(K.TREATMENT_TYPES) & found.isNotNull() & (found != K.MEDICATIONS), K.MEDICATIONS)
    )
    return (
        prepared.withColumn("secondary_category", secondary)
        .withColumn("primary_category", F.coalesce(found, F.lit(K.PUBLIC_HEALTH)))
        .drop("_q", "_a", "_p", "_kind")
    )


def categorize_dialogue(df: DataFrame, question_rules: Sequence[Rule], preview_chars: int | None = None) -> DataFrame:
    """CLS-06: patient text counts double, the beginning of the reply (``None``: all of it) once."""
    prepared = df.withColumns(
        {
            "_in": F.lower(X.strip(F.coalesce("input", F.lit("")))),
            "_out": F.lower(_preview(X.strip(F.coalesce("output", F.lit(""))), preview_chars)),
        }
    )
    scored = scored_categories(
        [(question_rules, hit_array(F.col("_in"), question_rules), 2), (question_rules, hit_array(F.col("_out"), question_rules), 1)],
        K.PUBLIC_HEALTH,
    )
    cancer = any_keyword(F.concat_ws(" ", "_in", "_out"), K.CANCER_SIGNALS)
    secondary = F.when((F.col("_c.primary") != "cancer") & cancer, "cancer").otherwise(F.col("_c.secondary"))
    return (
        prepared.withColumn("_c", scored)
        .withColumns({"primary_category": F.col("_c.primary"), "secondary_category": secondary})
        .drop("_in", "_out", "_c")
    )
