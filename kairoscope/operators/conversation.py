"""Conversation turns: windows around hits, ingest, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.functions import ids
from kairoscope.functions import text as T
from kairoscope.operators import writes

EMBEDDED_ROLES = ("user", "assistant")


def context_window(hits: DataFrame, turns: DataFrame) -> DataFrame:
    """Each hit (session_id, turn_index) with the turn before and the one after, where there are any."""
    wanted = hits.select("session_id", F.col("turn_index").alias("hit"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("offset")).withColumn("turn_index", F.col("hit") + F.col("offset"))
    near = wanted.join(turns.select("session_id", "turn_index", "content"), ["session_id", "turn_index"])
    sides = near.groupBy("session_id", F.col("hit").alias("turn_index")).agg(F.max(F.when(F.col("offset") == -1, F.col("content"))).alias("before"), F.max(F.when(F.col("offset") == 1, F.col("content"))).alias("after"))
    return hits.join(sides, ["session_id", "turn_index"], "left")


def ingest_turns(deliveries: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The stored turns after a batch of deliveries with ``ingested_at``.

    A turn is known by source and the hash of session and index. The first delivery sets the content;
    later ones, also of changed content, only move ``ingested_at``.
    """
    rows = deliveries.withColumn("content_hash", ids.turn_hash(F.col("session_id"), F.col("turn_index")))
    rows = rows.withColumn("tokens", T.token_estimate(F.col("content"))).withColumn("embedded", F.col("role").isin(*EMBEDDED_ROLES))
    if existing is not None:
        rows = existing.unionByName(rows, allowMissingColumns=True)
    kept = [c for c in rows.columns if c not in ("source_key", "content_hash", "ingested_at")]
    first = F.min_by(F.struct(*kept), F.col("ingested_at"))
    out = rows.groupBy("source_key", "content_hash").agg(first.alias("first"), F.max("ingested_at").alias("ingested_at"))
    return out.select("source_key", "content_hash", "ingested_at", "first.*")


def sessions(deliveries: DataFrame) -> DataFrame:
    """session_id, turn_count (deliveries, repeated ones too), last_turn_index, first_role."""
    return deliveries.groupBy("session_id").agg(F.count("*").alias("turn_count"), F.max("turn_index").alias("last_turn_index"), F.min_by("role", F.struct("ingested_at", "turn_index")).alias("first_role"))


def rejected(turns: DataFrame) -> DataFrame:
    """``turns`` with the reason for which one cannot be ingested, null if it can."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    reason = (
        F.when(empty("session_id"), "session_id is missing")
        .when(empty("content"), "content is missing")
        .when(~F.coalesce(F.col("role").isin("user", "assistant", "system", "tool"), F.lit(False)), "role is unknown")
        .when(F.col("turn_index").isNull() | (F.col("turn_index") < 0), "turn_index is invalid")
    )
    return turns.withColumn("reject_reason", reason)


def turn_links(turns: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """type, source, target, place and what writes.temporal_links() keeps: each session has its turns in their order, and each turn is part of its session.

    ``turns``: session_id, turn_index, seq, valid_from, confidence. A turn is known by the hash of its session and index;
    place is null for the way back. ``existing`` is an earlier result.
    """
    turn = F.sha2(F.concat_ws(":", "session_id", F.col("turn_index").cast("string")).cast("binary"), 256)
    same = ["seq", "valid_from", "confidence"]
    there = turns.select(F.lit("HAS_TURN").alias("type"), F.col("session_id").alias("source"), turn.alias("target"), F.col("turn_index").alias("place"), *same)
    back = turns.select(F.lit("PART_OF").alias("type"), turn.alias("source"), F.col("session_id").alias("target"), F.lit(None).cast("int").alias("place"), *same)
    return writes.temporal_links(there.union(back), ["type", "source", "target", "place"], existing=existing)


def shadow_claims(turns: DataFrame, predicate: str = "MENTIONS", excerpt: int = 500) -> DataFrame:
    """The claims that a turn's entities (an array of structs of name and type) make of it: subject, object, interval, and the turn as evidence.

    ``turns``: project_id, session_id, turn_index, content, captured_us, entities. Entities without a name and turns
    without a time make none: a shadow never stops the write that it follows.
    """
    each = turns.select("project_id", F.concat_ws(":", "session_id", F.col("turn_index").cast("string")).alias("turn"), "content", "captured_us", F.explode("entities").alias("e"))
    each = each.where(F.col("captured_us").isNotNull() & (F.trim("e.name") != ""))
    kind = F.lit("conversation_turn")
    return each.select("project_id", kind.alias("subject_kind"), F.col("turn").alias("subject"), F.lit(predicate).alias("predicate"), F.coalesce("e.type", F.lit("unknown")).alias("object_kind"), F.col("e.name").alias("object"), F.col("captured_us").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.lit(1.0).alias("confidence"), kind.alias("source_kind"), F.col("turn").alias("source_id"), F.substring("content", 1, excerpt).alias("excerpt"))
