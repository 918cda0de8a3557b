"""Conversations stored one row per turn (FLT-03, FLT-05, PRJ-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single_turn(turns: DataFrame, key: str = "conv_id", role: str = "role") -> DataFrame:
    """FLT-03: conversations without any assistant turn."""
    return turns.groupBy(key).agg(F.max((F.col(role) == "assistant").cast("int")).alias("_a")).where(F.col("_a") == 0).select(key)


def only_roles(turns: DataFrame, allowed: Sequence[str] = ("user", "assistant"), key: str = "conv_id", role: str = "role") -> DataFrame:
    """FLT-05: conversations with no other role."""
    return turns.groupBy(key).agg(F.count_if(~F.col(role).isin(*allowed)).alias("_o")).where(F.col("_o") == 0).select(key)


def last_user_text(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """PRJ-10: text of the last user turn; content given as a list of parts is its text parts, joined by blanks."""
    content = F.col(text)
    if turns.schema[text].dataType.typeName() == "array":
        parts = F.filter(content, lambda p: p["type"] == "text")
        content = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), " ")
    return turns.where(F.col(role) == "user").groupBy(key).agg(F.max_by(content, F.col(turn)).alias("query"))


def dialogue_pairs(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A user turn and the assistant turn that follows it, as ``(key, turn, input, output)``."""
    asked = turns.where(F.col(role) == "user").select(key, turn, F.col(text).alias("input"))
    replied = turns.where(F.col(role) == "assistant").select(key, (F.col(turn) - 1).alias(turn), F.col(text).alias("output"))
    return asked.join(replied, [key, turn])
