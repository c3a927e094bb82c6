"""Writes as folds over deliveries: upserts, links, closings, evidence and claims.

Nothing is updated in place. A delivery is a row with ``seq``, the order in which it came; the state
of a key is a fold of its deliveries, so delivering a batch again, or in parts, or with the state so
far as ``existing``, gives the same final state. Every fold is one aggregation on the key with
partial aggregation before the shuffle, so a key that has many deliveries is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.functions import ids
from kairoscope.operators import temporal


def upsert(deliveries: DataFrame, keys: list[str], latest: list[str] | None = None, existing: DataFrame | None = None) -> DataFrame:
    """One row a key: columns in ``latest`` from the last delivery, all others from the first one that created it.

    Columns beside the keys and ``seq`` may be null. The result keeps ``seq`` of the creation and
    ``last_seq``, and can be given back as ``existing``. Deliveries without a key are left out.
    """
    latest = latest or []
    rows = deliveries.dropna(subset=keys).withColumn("last_seq", F.col("seq"))
    if existing is not None:
        rows = existing.unionByName(rows, allowMissingColumns=True)
    fixed = [c for c in rows.columns if c not in (*keys, *latest, "last_seq")]
    # Of deliveries with one seq, content decides, so that ties have one result.
    at = lambda seq, columns: F.when(F.col(seq).isNotNull(), F.struct(seq, F.xxhash64(*columns)))
    found = [F.min_by(F.struct(*fixed), at("seq", fixed)).alias("first"), F.max("last_seq").alias("last_seq")]
    if latest:
        found.append(F.max_by(F.struct(*latest), at("last_seq", latest)).alias("last"))
    out = rows.groupBy(*keys).agg(*found)
    return out.select(*keys, "first.*", *(["last.*"] if latest else []), "last_seq")


def with_ends(links: DataFrame, ends: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """The links whose ends exist: for each end, its rows and which column of a link holds which of its keys."""
    for rows, columns in ends:
        known = rows.select(*[F.col(k).alias(c) for c, k in columns.items()]).distinct()
        links = links.join(known, list(columns), "left_semi")
    return links


def plain_links(links: DataFrame, keys: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Each link once."""
    rows = links.select(*keys)
    return (rows if existing is None else existing.select(*keys).union(rows)).distinct()


def temporal_links(links: DataFrame, keys: list[str], latest: list[str] | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Links with valid_from and other columns of the first delivery, ``latest`` ones of the last, the largest confidence, and how often they were delivered.

    ``links`` have keys, seq, valid_from and confidence; valid_to starts open and contradictions at 0.
    """
    latest = latest or []
    rows = links.withColumns({"support": F.lit(1).cast("long"), "valid_to": F.lit(None).cast(links.schema["valid_from"].dataType), "contradictions": F.lit(0).cast("long"), "last_seq": F.col("seq")})
    if existing is not None:
        rows = existing.unionByName(rows, allowMissingColumns=True)
    summed = ("support", "confidence", "valid_to", "contradictions", "last_seq")
    fixed = [c for c in rows.columns if c not in (*keys, *latest, *summed)]
    out = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*fixed), F.col("seq")).alias("first"),
        F.max_by(F.struct(F.lit(0).alias("__"), *latest), F.col("last_seq")).alias("last"),
        F.sum("support").alias("support"),
        F.max("confidence").alias("confidence"),
        F.max("valid_to").alias("valid_to"),
        F.sum("contradictions").alias("contradictions"),
        F.max("last_seq").alias("last_seq"),
    )
    return out.select(*keys, "first.*", *[f"last.{c}" for c in latest], *summed)


def close_links(links: DataFrame, closings: DataFrame, keys: list[str]) -> DataFrame:
    """``valid_to`` of the links that a closing (keys, seq, valid_to) names, from the last one; closings of unknown links do nothing."""
    last = closings.groupBy(*keys).agg(F.max_by("valid_to", F.col("seq")).alias("__to"), F.lit(True).alias("__closed"))
    rows = links.join(last, keys, "left")
    return rows.withColumn("valid_to", F.when(F.col("__closed"), F.col("__to")).otherwise(F.col("valid_to"))).drop("__to", "__closed")


def contradict_links(links: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """One contradiction more for each report (keys) of a link."""
    more = reports.groupBy(*keys).agg(F.count("*").alias("__more"))
    rows = links.join(more, keys, "left")
    return rows.withColumn("contradictions", F.coalesce("contradictions", F.lit(0)) + F.coalesce("__more", F.lit(0))).drop("__more")


def evidence_id(project: Column, source_kind: Column, source_id: Column, hash_: Column, captured_at: Column) -> Column:
    """What makes two pieces of evidence the same one."""
    return F.sha2(F.concat_ws(ids.SEPARATOR, project.cast("string"), source_kind, source_id, hash_, captured_at.cast("string")).cast("binary"), 256)


def evidence_hash(project: Column, source_kind: Column, source_id: Column, source_uri: Column, excerpt: Column, captured_at: Column) -> Column:
    """A digest of all that a piece of evidence says, in a fixed order of fields; nulls count."""
    fields = F.struct(project.alias("projectId"), source_kind.alias("sourceKind"), source_id.alias("sourceId"), source_uri.alias("sourceUri"), excerpt.alias("rawExcerpt"), captured_at.cast("string").alias("capturedAtUs"))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}).cast("binary"), 256)


def insert_absent(rows: DataFrame, key: list[str], existing: DataFrame | None = None) -> DataFrame:
    """The existing rows, and the first new one of every key that is not there yet."""
    fixed = [c for c in rows.columns if c not in key]
    new = rows.groupBy(*key).agg(F.min_by(F.struct(*fixed), F.col("seq")).alias("first")).select(*key, "first.*")
    return new if existing is None else existing.unionByName(new.join(existing.select(*key), key, "left_anti"))


def ingest_claims(claims: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, evidence and links of claims (temporal.EDGE, confidence, observed_at, source_kind, source_id, hash, seq).

    Every delivery supports its edge; its evidence and link are kept once. ``seen``: the edges so far.
    """
    e = evidence_id(F.col("project_id"), F.col("source_kind"), F.col("source_id"), F.col("hash"), F.col("observed_at"))
    rows = claims.withColumn("evidence_id", e)
    evidence = insert_absent(rows.select("evidence_id", "project_id", "source_kind", "source_id", "hash", "observed_at", "seq"), ["evidence_id"])
    links = plain_links(rows, [*temporal.EDGE, "evidence_id"])
    return temporal.upsert_edges(claims, seen), evidence, links


def ingest_backfill(claims: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Edges of claims from an archive: no statistics and no contradictions follow, and an edge that is there keeps its support."""
    edges = temporal.upsert_edges(claims)
    if stored is None:
        return edges
    a, b = edges.alias("a"), stored.select(*temporal.EDGE).alias("b")
    absent = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in temporal.EDGE], "left_anti")
    return stored.select(*edges.columns).unionByName(absent)


def report_parts(reports: DataFrame, chunks: Column, citations: Column) -> dict[str, DataFrame]:
    """What a batch of reports (project_id, session_id, seq and more) brings: chunks and their links to the report, sources, and the links that cite them.

    ``chunks`` is an array of texts; ``citations`` an array of structs of url, title and snippet, null where there are none.
    """
    own = reports.select("project_id", "session_id", "seq", chunks.alias("chunks"), citations.alias("citations"))
    each = own.select("project_id", "session_id", "seq", F.size("chunks").alias("total"), F.posexplode("chunks").alias("chunk_index", "text"))
    parts = each.withColumn("content_hash", F.sha2(F.concat_ws(":", F.col("session_id").cast("string"), F.col("chunk_index").cast("string"), "text").cast("binary"), 256))
    cited = own.select("project_id", "session_id", "seq", F.explode("citations").alias("c")).select("project_id", "session_id", "seq", "c.*").where(F.trim("url") != "")
    return {
        "chunks": upsert(parts.select("project_id", "content_hash", "session_id", "chunk_index", "total", "text", "seq"), ["project_id", "content_hash"], ["total"]),
        "has_chunk": plain_links(parts, ["project_id", "session_id", "content_hash", "chunk_index"]),
        "sources": upsert(cited.select("url", "title", "seq"), ["url"], ["title"]),
        "cites": plain_links(cited, ["project_id", "session_id", "url"]),
    }
