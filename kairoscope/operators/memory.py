"""Memory entities and relations: search, read, and merges without row-level updates.

A merge is a full outer join of the stored rows and the batch on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(stored: DataFrame, batch: DataFrame, keys: list[str], prefer_new: list[str]) -> DataFrame:
    """Stored rows with the batch's: columns in ``prefer_new`` take the batch's value, all others keep the stored one."""
    new = batch.select(*keys, *[F.col(c).alias(f"__{c}") for c in batch.columns if c not in keys])
    both = stored.join(new, keys, "full_outer")

    def pick(c: str):
        order = (f"__{c}", c) if c in prefer_new else (c, f"__{c}")
        return F.coalesce(*order).alias(c)

    return both.select(*keys, *[pick(c) for c in stored.columns if c not in keys])


def upsert_entities(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """name, type, observations; an empty list of observations keeps the old one."""
    batch = batch.withColumn("observations", F.when(F.size("observations") > 0, F.col("observations")))
    return merge(stored, batch, ["name", "type"], ["observations"])


def add_observations(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Appends the observations (name, new) that an entity does not have yet, in their order."""
    rows = stored.join(batch, "name", "left")
    fresh = F.filter(F.coalesce("new", F.array().cast("array<string>")), lambda x: ~F.array_contains(F.col("observations"), x))
    return rows.withColumn("observations", F.concat("observations", fresh)).drop("new")


def delete_observations(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Removes the observations (name, gone); repeats of others stay."""
    rows = stored.join(batch, "name", "left")
    kept = F.filter("observations", lambda x: ~F.array_contains(F.coalesce(F.col("gone"), F.array().cast("array<string>")), x))
    return rows.withColumn("observations", kept).drop("gone")


def delete_entities(entities: DataFrame, relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and relations without the named ones, and the names that were unknown."""
    left = entities.join(names, "name", "left_anti")
    kept = relations.join(names, relations["source"] == names["name"], "left_anti").join(names, relations["target"] == names["name"], "left_anti")
    return left, kept, names.join(entities, "name", "left_anti")


def upsert_relations(stored: DataFrame, batch: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (source, type, target) between known entities: support grows, the largest confidence stays, validity is the first's."""
    known = entities.select("name").distinct()
    new = batch.join(known.withColumnRenamed("name", "source"), "source", "left_semi").join(known.withColumnRenamed("name", "target"), "target", "left_semi").withColumn("support", F.lit(1).cast("long"))
    both = stored.unionByName(new, allowMissingColumns=True)
    return both.groupBy("source", "type", "target").agg(F.sum("support").alias("support"), F.max("confidence").alias("confidence"), F.min_by("valid_from", F.col("observed_at")).alias("valid_from"), F.min("observed_at").alias("observed_at"))


def search(dense: DataFrame, lexical: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """Distinct union of both scans, the k best of each query: query_key, key, score (the larger), sources."""
    one = lambda df, source: df.select(query_key, key, "score", F.lit(source).alias("source"))
    rows = one(dense, "dense").union(one(lexical, "lexical")).distinct()
    out = rows.groupBy(query_key, key).agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return out.withColumn("place", place).where(F.col("place") <= k).drop("place")


def read_graph(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """name, type, relations (sorted ``type>target``) and their number."""
    own = relations.groupBy(F.col("source").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(">", "type", "target"))), ",").alias("relations"), F.countDistinct("type", "target").alias("n_relations"))
    return entities.join(own, "name", "left").select("name", "type", F.coalesce("relations", F.lit("")).alias("relations"), F.coalesce("n_relations", F.lit(0)).alias("n_relations"))


def rejected_relations(batch: DataFrame) -> DataFrame:
    """``batch`` with a reason where an end or the type is missing."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    return batch.withColumn("reject_reason", F.when(empty("source"), "source is missing").when(empty("target"), "target is missing").when(empty("type"), "type is missing"))
