"""Registered queries: every operator applied to the given tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caresift.catalog.registry import ORACLE, QUERIES


def load_all() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    from caresift.catalog import analysis, corpus, graph, retrieval, scans, scoring, state, text  # noqa: F401

    return QUERIES, ORACLE
