"""Question answering: classify, plan, search, fuse, re-rank, score confidence — for a whole table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift.operators import classify as C
from caresift.operators import graph as G
from caresift.operators import retrieval as R
from caresift.operators.sizes import checked_broadcast
from caresift.session import cut_lineage


def search(corpus: DataFrame, records: DataFrame, queries: DataFrame, k: int = 8, plan: DataFrame | None = None) -> DataFrame:
    """Hybrid search.  ``corpus``: source_table, record_id, text, embedding; ``records``: source_table, record_id,
    primary_category, quality_tier, chunk_text; ``queries``: query_id, text, embedding; ``plan`` as ``retrieval_plan``.

    Both lists carry keys and scores only; record columns are joined to the few fused hits at the end.  What has no record
    takes no place in a list: such keys, normally few, are found by keys alone, so that no vector or text is shuffled.
    """
    keys = ["source_table", "record_id"]
    without_record = cut_lineage(corpus.select(*keys).distinct().join(records.select(*keys), keys, "left_anti"))
    corpus = corpus.join(checked_broadcast(without_record), keys, "left_anti")
    semantic = R.list_top(R.semantic_hits(corpus, queries))
    lexical = R.list_top(R.lexical_hits(corpus, queries))
    hits = R.fused(semantic, lexical, R.prefetch(k) if plan is not None else k)
    described = R.described(hits, records, "left").withColumns({
        "primary_category": F.coalesce("primary_category", F.lit("public_health_prevention")),
        "quality_tier": F.coalesce("quality_tier", F.lit("TIER_D")), "chunk_text": F.coalesce("chunk_text", F.lit("")),
    })
    if plan is None:
        return described.withColumnsRenamed({"fused_rank": "rank"})
    return R.reranked(described, plan, k).withColumnRenamed("final_rank", "rank")


def classify(queries: DataFrame, terms: DataFrame, means: DataFrame, model_labels: DataFrame) -> DataFrame:
    """OPT-8: the cheap classifier first; only queries it left open go to the centroids, then to the model's labels."""
    by_keyword = C.keyword_category(queries, terms)
    open_ = queries.join(by_keyword.select("query_id"), "query_id", "left_anti")
    by_centroid = C.nearest_centroid(open_, means)
    return C.cascade(queries, by_keyword, by_centroid, model_labels)


def answer(queries: DataFrame, corpus: DataFrame, records: DataFrame, terms: DataFrame, means: DataFrame, model_labels: DataFrame,
           graph: DataFrame, profiles: DataFrame, history: DataFrame, now: Column, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Hits and confidence for ``queries`` (query_id, user_id, text, embedding)."""
    classified = classify(queries, terms, means, model_labels)
    anchors = G.anchored(profiles, graph)
    plan = G.retrieval_plan(
        classified.select("query_id", "user_id", F.col("category").alias("primary_category")), graph,
        G.user_overlay(profiles, graph), history, anchors, now,
    )
    hits = search(corpus, records, queries, k, plan)
    return hits, R.confidence(classified.select("query_id", "category", "method"), hits)
