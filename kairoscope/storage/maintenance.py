"""Maintenance of stored temporal edges: decay, archive and prune as changes of a set of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.operators import temporal
from kairoscope.storage.snapshot import TableSet

#: The jobs, in the order in which they are due.
JOBS = ("nightly_decay", "archive_expired", "mdl_prune")
KEYS = {"edges": temporal.EDGE, "archive": temporal.EDGE}


def edge_tables(spark: SparkSession, path: str, buckets: int = 16) -> TableSet:
    """Edges (temporal.EDGE, ``seq`` and any other columns) and what was archived of them."""
    return TableSet(spark, path, KEYS, "seq", buckets)


def changes_of(kind: str, edges: DataFrame, now_us: int, seq: int, observations: DataFrame | None = None) -> dict[str, DataFrame]:
    """The changes that a job makes, by table."""
    mark = lambda rows, op: rows.withColumns({"seq": F.lit(seq).cast("long"), "op": F.lit(op)})
    old = edges.withColumn("__old", F.col("relevance"))
    if kind == "nightly_decay":
        new = temporal.decay(old, now_us).where(F.col("relevance") != F.col("__old")).drop("__old")
        return {"edges": mark(new, "update")}
    if kind == "archive_expired":
        _, gone = temporal.split_expired(edges, now_us)
        return {"edges": mark(gone.select(*edges.columns), "delete"), "archive": mark(gone.select(*temporal.EDGE, "relevance", "reason", "snapshot"), "insert")}
    if kind == "mdl_prune":
        if observations is None:
            raise ValueError("pruning needs the observations")
        out = temporal.mdl_prune(old, observations)
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in temporal.EDGE]
        both = old.alias("o").join(out.alias("n"), same).select("o.*", F.col("n.relevance").alias("__new"), F.col("n.archived").alias("__gone"))
        both = both.where((F.col("__new") != F.col("__old")) | F.col("__gone")).withColumn("relevance", F.col("__new"))
        gone, kept = both.where("__gone"), both.where("NOT __gone")
        rows = mark(gone.select(*edges.columns), "delete").unionByName(mark(kept.select(*edges.columns), "update"))
        archive = gone.withColumns({"reason": F.lit("mdl_prune"), "snapshot": F.to_json(F.struct(*edges.columns))}).select(*temporal.EDGE, "relevance", "reason", "snapshot")
        return {"edges": rows, "archive": mark(archive, "insert")}
    raise ValueError(f"unknown maintenance job: {kind}")


def jobs(tables: TableSet, now_us: int, observations: DataFrame | None = None, kinds: tuple[str, ...] = JOBS) -> dict[str, Callable[[int], None]]:
    """The jobs for ledger.JobLedger.run_due(): each merges its changes as the next batch of the set."""

    def run(kind: str) -> None:
        edges = tables.snapshot()["edges"]
        if edges is not None:
            batch = tables.batch() + 1
            tables.merge(changes_of(kind, edges, now_us, batch, observations), batch)

    return {kind: (lambda _slot, kind=kind: run(kind)) for kind in kinds}
