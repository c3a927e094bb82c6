"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_metrics(ranked: DataFrame, expected: DataFrame, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """Per query: rank of the first expected row, reciprocal rank, NDCG@10, Success@5, Recall@10; a query without a hit has zeros."""
    marked = ranked.join(expected.select(query, key).distinct().withColumn("hit", F.lit(1)), [query, key], "left")
    rank = marked.groupBy(query).agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("hit_rank"))
    r = F.col("hit_rank")
    return rank.select(
        query,
        "hit_rank",
        F.coalesce(F.round(1.0 / r, 9), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.when(r <= 10, F.round(F.log(F.lit(2.0)) / F.log(r + 1.0), 9)), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.when(r <= 5, 1).otherwise(0), F.lit(0)).alias("success"),
        F.coalesce(F.when(r <= 10, 1).otherwise(0), F.lit(0)).alias("recall"),
    )


def reorder_by_scores(rows: DataFrame, scores: DataFrame, key: str, keep_unscored: bool) -> DataFrame:
    """By rerank score; rows without one vanish, or follow in their order."""
    joined = rows.join(scores.select(key, "rerank_score"), key, "left" if keep_unscored else "inner")
    return joined.orderBy(F.desc_nulls_last("rerank_score"), "rank", key)


def abstain(rows: DataFrame, least: float = 0.35, high_stakes: bool = False) -> DataFrame:
    """Nothing if the best rerank score stays below ``least`` and the question is of high stakes."""
    if not high_stakes:
        return rows
    best = rows.agg(F.max("rerank_score").alias("best"))
    return rows.crossJoin(F.broadcast(best)).where(F.col("best") >= least).drop("best")  # one row
