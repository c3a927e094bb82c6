"""Change feeds: replayed rows are dropped by signature and the latest row of a key is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.storage import keyed_table
from kairoscope.storage.keyed_table import KeyedTable


class ChangeSink:
    """A foreachBatch function that folds change rows (with ``op``) into a keyed table, of which each batch rewrites only what it touches.

    Table and progress are read from ``path``, not kept by the driver, so a batch that is delivered again changes
    nothing, also after a restart. Every ``vacuum_after`` batches old versions are removed.
    """

    def __init__(self, keys: list[str], order: str, path: str, buckets: int = keyed_table.BUCKETS, horizon: int | None = None, vacuum_after: int = 100):
        self.keys, self.order, self.path, self.buckets, self.horizon, self.vacuum_after = keys, order, path.rstrip("/"), buckets, horizon, vacuum_after

    def stored(self, spark: SparkSession) -> KeyedTable:
        return KeyedTable(spark, self.path, self.keys, self.order, self.buckets, self.horizon)

    def last(self, spark: SparkSession) -> int:
        """The number of the last batch that is in the table; -1 before the first."""
        return self.stored(spark).batch()

    def table(self, spark: SparkSession) -> DataFrame | None:
        """All rows, deleted ones marked; none before the first batch."""
        return self.stored(spark).rows()

    def __call__(self, batch: DataFrame, number: int) -> None:
        stored = self.stored(batch.sparkSession)
        if stored.merge(batch, number) and (number + 1) % self.vacuum_after == 0:
            stored.vacuum()


def distinct_changes(stream: DataFrame, scope: str, keys: list[str], payload: list[str], ts: str, keep: str) -> DataFrame:
    """A stream without changes whose scope, key and content came before within the time ``keep``."""
    signature = F.sha2(F.to_json(F.struct(*payload)).cast("binary"), 256)
    return stream.withColumn("signature", signature).withWatermark(ts, keep).dropDuplicatesWithinWatermark([scope, *keys, "signature"])


def sessions(stream: DataFrame, key: str, ts: str, idle: str, late: str) -> DataFrame:
    """Bursts of a stream: key, begin, end, n; a gap of exactly ``idle`` still joins."""
    window = F.session_window(ts, idle)
    return stream.withWatermark(ts, late).groupBy(key, window).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that the source has now, through ``sink``."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
