"""Edge-weight arithmetic (PRJ-22 … PRJ-28) as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from caresift import constants as K


def count_weight(count: Column, ceiling: float | Column) -> Column:
    """PRJ-22: log-scaled weight between the floor and ``ceiling``, which 100 hits reach."""
    top = ceiling if isinstance(ceiling, Column) else F.lit(ceiling)
    share = F.least(F.lit(1.0), F.log10(count.cast("double") + 1) / math.log10(K.LINK_FULL_COUNT + 1))
    return F.when(count <= 0, F.lit(K.LINK_FLOOR)).otherwise(K.LINK_FLOOR + share * (top - K.LINK_FLOOR))


def soft_cap(raw: Column) -> Column:
    """PRJ-23."""
    return F.when(raw <= 0, F.lit(0.0)).otherwise(K.MAX_BOOST * (1 - F.exp(-raw / K.MAX_BOOST)))


def history_boost(count: Column, days: Column) -> Column:
    """PRJ-24."""
    decayed = count * K.HISTORY_STEP * F.pow(F.lit(0.5), days / K.HALF_LIFE_DAYS)
    return F.when((count <= 0) | (days < 0), F.lit(0.0)).otherwise(F.least(decayed, F.lit(K.MAX_HISTORY_BOOST)))


def effective_weight(base: Column, positive_boosts: Column, history: Column) -> Column:
    """PRJ-25: ``positive_boosts`` is the sum of the positive boosts, ``history`` comes from ``history_boost``."""
    return F.least(base + soft_cap(positive_boosts) + history, F.lit(1.0))


def guarded_adjustment(baseline: Column, proposed: Column) -> Column:
    """PRJ-26: a proposed weight, moved at most so far from the baseline and kept in range."""
    base = F.coalesce(baseline, F.lit(0.0))
    delta = F.greatest(F.lit(-K.ADJUST_DOWN), F.least(F.coalesce(proposed, F.lit(0.0)) - base, F.lit(K.ADJUST_UP)))
    return F.round(F.greatest(F.lit(K.ADJUST_FLOOR), F.least(base + delta, F.lit(K.ADJUST_CEILING))), 4)


def graph_rerank(rrf: Column, weight: Column, must_load: Column) -> Column:
    """PRJ-27."""
    flat = F.when(F.coalesce(must_load, F.lit(False)), F.lit(0.10)).otherwise(F.lit(0.0))
    return rrf * (1.0 + F.coalesce(weight, F.lit(0.0)) * 0.3) + flat


def load_bucket(weight: Column) -> Column:
    """SET-04: ``must``, ``may`` or null by weight."""
    return F.when(weight >= K.MUST_LOAD, "must").when(weight >= K.MAY_LOAD, "may")


def disclaimer(confidence: Column) -> Column:
    """PRJ-28: the notice that goes with a confidence (null from 0.80)."""
    return (
        F.when(confidence >= 0.80, F.lit(None).cast("string"))
        .when(confidence >= 0.60, K.DISCLAIMER_HIGH)
        .when(confidence >= 0.45, K.DISCLAIMER_MEDIUM)
        .otherwise(K.DISCLAIMER_LOW)
    )


def hedged(answer: Column, confidence: Column) -> Column:
    """PRJ-28: the answer, after a hedge when confidence is in [0.55, 0.80)."""
    return F.when(
        (confidence >= 0.55) & (confidence < 0.80), F.concat(F.lit(K.HEDGE), F.coalesce(answer, F.lit("")))
    ).otherwise(answer)


def edge_of_unsure(confidence: Column) -> Column:
    """CLS-15: low-evidence flag."""
    return confidence < 0.55
