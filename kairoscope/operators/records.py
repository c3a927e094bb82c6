"""Records around a store: annotations, markers, schedules, tool calls; and rows made ready for a caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.operators import writes

#: Fixed value: hits that a context is assembled from.
CONTEXT_HITS = 6


def apply_annotations(calls: DataFrame, pending: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with their annotation, and the annotations that applied with the number of their calls.

    calls: id and annotation_id; pending: annotation_id and more; matches: annotation_id, id. Of several annotations of
    a call the largest id stays. A pending annotation that matches no call vanishes.
    """
    known = matches.join(pending.select("annotation_id"), "annotation_id", "left_semi").groupBy("id").agg(F.max("annotation_id").alias("__new"))
    out = calls.join(known, "id", "left").withColumn("annotation_id", F.coalesce("__new", "annotation_id")).drop("__new")
    applied = matches.join(calls.select("id"), "id", "left_semi").groupBy("annotation_id").agg(F.countDistinct("id").alias("matched_calls"))
    return out, pending.join(applied, "annotation_id").withColumn("status", F.lit("applied"))


def upsert_markers(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """repo_id, display_name, created_at, updated_at, created (by this batch): a name that is not given keeps the stored one."""
    new = batch.groupBy("repo_id").agg(F.max_by("display_name", F.when(F.col("display_name").isNotNull(), F.col("seq"))).alias("name"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    both = existing.join(new, "repo_id", "full_outer")
    return both.select("repo_id", F.coalesce("name", "display_name").alias("display_name"), F.coalesce("created_at", "first").alias("created_at"), F.greatest("updated_at", "last").alias("updated_at"), F.col("created_at").isNull().alias("created"))


def schedule_runs(schedules: DataFrame, runs: DataFrame) -> DataFrame:
    """Schedules (schedule_id, project_id, created_at, max_runs) with run_count, last_run_at and whether they go on, the oldest first in a project."""
    own = runs.groupBy("schedule_id").agg(F.count("*").alias("run_count"), F.max("ran_at").alias("last_run_at"))
    out = schedules.join(own, "schedule_id", "left").withColumn("run_count", F.coalesce("run_count", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "schedule_id"))
    return out.withColumns({"active": F.col("max_runs").isNull() | (F.col("run_count") < F.col("max_runs")), "place": place})


def recent_topics(researched: DataFrame, k: int = 10) -> DataFrame:
    """The k topics (project_id, topic, valid_from) of each project that were researched last."""
    order = Window.partitionBy("project_id").orderBy(F.desc("valid_from"), "topic")
    return researched.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def without_embedding(entities: DataFrame, limit: int, force: bool = False) -> DataFrame:
    """The first ``limit`` entities (by name) that have no embedding; with ``force`` of all."""
    return (entities if force else entities.where("embedding IS NULL")).orderBy("name").limit(limit)


def append_calls(calls: DataFrame, path: str) -> None:
    """Adds tool calls (epoch_ms and more) to the table of days at ``path``; a row is only ever added."""
    day = F.to_date(F.timestamp_millis("epoch_ms"))
    calls.withColumn("day", day).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def assembled_context(hits: DataFrame, query_key: str, budget: int, limit: int = CONTEXT_HITS) -> DataFrame:
    """query_key, context, tokens: the first hits (rank, title, source, content) of each question that fit a budget of tokens together."""
    tokens = F.ceil(F.length(F.coalesce("content", F.lit(""))) / 4.0).cast("long")
    order = Window.partitionBy(query_key).orderBy("rank")
    rows = hits.where(F.col("rank") <= limit).withColumns({"tokens": tokens, "spent": F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, 0))}).where(F.col("spent") <= budget)
    block = F.concat(F.lit("[#"), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.concat(F.lit("Memory block "), F.col("rank").cast("string"))), F.lit(" ("), F.coalesce("source", F.lit("memory")), F.lit(")\n"), F.coalesce("content", F.lit("")))
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return rows.groupBy(query_key).agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"), F.sum("tokens").alias("tokens"))


def plugin_hits(hits: DataFrame, least: float = 0.0) -> DataFrame:
    """Hits of enough score with the fallbacks of a plug-in: path or module and title, line 1, the first text that there is, and a citation where a path is known."""
    rows = hits.where(F.coalesce("score", F.lit(0.0)) >= least)
    named = F.concat(F.coalesce("module", F.lit("memory")), F.lit(":"), F.coalesce("title", F.lit("result")))
    line = F.coalesce("start_line", F.lit(1))
    columns = {
        "citation": F.concat("path", F.lit("#L"), line.cast("string")),
        "path": F.coalesce("path", named),
        "start_line": line,
        "score": F.coalesce("score", F.lit(0.0)),
        "snippet": F.coalesce("snippet", "content", "text", F.lit("")),
        "source": F.when(F.col("module") == "conversation", "sessions").otherwise("memory"),
    }
    return rows.withColumns(columns)


def routed(domain: Column, query: Column) -> Column:
    """The tool for a question: git for a commit's hash whatever the domain, else the domain (code, git, hybrid); null for another one."""
    name = F.lower(F.trim(domain))
    return F.when(F.trim(query).rlike("^[0-9a-fA-F]{7,40}$"), "git").when(name.isin("code", "git", "hybrid"), name)


def write_target(explicit: Column, active: Column, bound: Column) -> Column:
    """Where a write goes: what is named, else the active target, else the bound folder; null where there is none."""
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.nullif(active, F.lit("")), bound)


def citations(raw: Column) -> Column:
    """An array of (url, title, snippet) from JSON texts, each an object or a url; url is null where an entry cannot be one."""

    def one(x: Column) -> Column:
        text = F.trim(x)
        plain = F.when(text.rlike("^https?://"), text)
        url = F.when(text.startswith("{"), F.nullif(F.trim(F.get_json_object(text, "$.url")), F.lit(""))).otherwise(plain)
        field = lambda name: F.get_json_object(F.when(text.startswith("{"), text), f"$.{name}")
        return F.struct(url.alias("url"), field("title").alias("title"), field("snippet").alias("snippet"))

    return F.transform(raw, one)


def derived_seeds(candidates: DataFrame, query_key: str, most: int = 5) -> DataFrame:
    """query_key, name, kind: the first ``most`` distinct seeds of ranked candidates (rank, seed_name, seed_kind), names compared in lower case."""
    rows = candidates.where("seed_name IS NOT NULL")
    first = rows.groupBy(query_key, F.lower("seed_name").alias("key"), F.coalesce("seed_kind", F.lit("unknown")).alias("kind_key")).agg(F.min_by(F.struct("seed_name", "seed_kind"), F.col("rank")).alias("s"), F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy(query_key).orderBy("rank", "key", "kind_key"))
    return first.withColumn("place", place).where(F.col("place") <= most).select(query_key, "place", F.col("s.seed_name").alias("name"), F.col("s.seed_kind").alias("kind"))


def token_reduction(baseline: Column, other: Column) -> Column:
    """By how many per cent ``other`` needs fewer tokens; 0 without a baseline."""
    return F.when(baseline > 0, (baseline - other) / baseline * 100.0).otherwise(0.0)


def latest_records(deliveries: DataFrame, keys: list[str]) -> DataFrame:
    """Of records that are delivered again, all columns of the last delivery."""
    others = [c for c in deliveries.columns if c not in (*keys, "seq")]
    return writes.upsert(deliveries, keys, others).select(*keys, *others)
