"""Scans and lookups of stored nodes, turns and files, within a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.functions import vector as V
from kairoscope.operators import retrieval


def label_scan(nodes: DataFrame, labels: list[str], properties: dict[str, object] | None = None, repo_id: str | None = None) -> DataFrame:
    """Nodes (repo_id, labels, properties as a map of text) that have all labels and property values.

    Filters on columns reach the scan of a table that is partitioned by repo_id.
    """
    wanted = F.lit(True) if repo_id is None else F.col("repo_id") == repo_id
    for name in labels:
        wanted = wanted & F.array_contains("labels", name)
    for name, value in (properties or {}).items():
        wanted = wanted & (F.try_element_at("properties", F.lit(name)) == F.lit(str(value)))
    return nodes.where(wanted)


def turns_at(turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (session_id, turn_index and any other columns) with role, content and project_id of the turn; without one no row.

    A project_id in ``wanted`` that is not null has to be the turn's.
    """
    own = turns.select("session_id", "turn_index", "role", "content", F.col("project_id").alias("__project"))
    found = wanted.join(own, ["session_id", "turn_index"])
    if "project_id" in wanted.columns:
        found = found.where("project_id IS NULL OR project_id = __project").drop("project_id")
    return found.withColumnRenamed("__project", "project_id")


def scoped(rows: DataFrame, isolate: list[str] | None, column: str = "repo_id") -> DataFrame:
    """Rows of the isolated repositories; all rows without any. (A focus only informs and filters nothing.)"""
    return rows.where(F.col(column).isin(isolate)) if isolate else rows


def semantic_or_text(vectors: DataFrame, docs: DataFrame, queries: DataFrame, k: int, query_key: str, key: str, vector: str = "embedding", text: str = "text") -> DataFrame:
    """query_key, key, score, mode: dense results of questions with a valid vector, full-text ones of all others; nothing is fused."""
    valid = V.is_valid(F.col(vector))
    dense = retrieval.dense_topk_each(vectors, queries.where(valid), k, query_key, key, vector)
    lexical = retrieval.bm25(docs, queries.where(~valid), k, key, text, query_key, text)
    mode = lambda rows, name: rows.select(query_key, key, "score", "rank", F.lit(name).alias("mode"))
    return mode(dense, "dense").union(mode(lexical, "text"))


def file_parts(functions: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """repo_id, path and the sorted names of its functions, classes and imported files; each input: repo_id, path, name."""
    listed = lambda rows, name: rows.groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("name")).alias(name))
    out = listed(functions, "functions").join(listed(classes, "classes"), ["repo_id", "path"], "full_outer").join(listed(imports, "imports"), ["repo_id", "path"], "full_outer")
    none = F.array().cast("array<string>")
    return out.select("repo_id", "path", *[F.coalesce(c, none).alias(c) for c in ("functions", "classes", "imports")])


def token_reduction(baseline: Column, temporal: Column) -> Column:
    """Per cent of the baseline's tokens that the other result saves; zero without any."""
    return F.when(baseline > 0, (baseline - temporal) / baseline * 100).otherwise(0.0)


def temporal_consistency(ranked: DataFrame, expected: DataFrame, query_key: str, key: str, k: int = 10) -> DataFrame:
    """query_key, temporal_consistent: 1 where one of the first k results is expected, else 0; questions without results too."""
    hit = ranked.where(F.col("rank") <= k).join(expected.select(query_key, key).distinct(), [query_key, key], "left_semi").select(query_key).distinct().withColumn("__hit", F.lit(1))
    asked = ranked.select(query_key).union(expected.select(query_key)).distinct()
    return asked.join(hit, query_key, "left").select(query_key, F.coalesce("__hit", F.lit(0)).alias("temporal_consistent"))
