"""Several keyed tables that are read as of one moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kairoscope.storage.keyed_table import KeyedTable
from kairoscope.storage.manifest import Manifest


class TableSet:
    """Keyed tables below one path whose versions are named together.

    A change of several tables is merged into each of them and counts for all by one rename, so that a snapshot never
    has one table with a change and another without. A change that fails halfway is in no snapshot; delivered again,
    the tables that have it already leave it out, and the set names it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]], order: str, buckets: int = 16):
        self.manifest = Manifest(spark, path)
        self.tables = {name: KeyedTable(spark, f"{path.rstrip('/')}/{name}", own, order, buckets) for name, own in keys.items()}

    def batch(self) -> int:
        """The number of the last batch that the set has; -1 before the first."""
        return (self.manifest.state() or {"batch": -1})["batch"]

    def merge(self, changes: dict[str, DataFrame], batch: int) -> bool:
        """Folds changes (with ``op``) into the named tables; false where the batch is in the set already."""
        if batch <= self.batch():
            return False
        for name, rows in changes.items():
            self.tables[name].merge(rows, batch)
        versions = {name: table.manifest.last() for name, table in self.tables.items()}
        self.manifest.commit(self.manifest.last() + 1, {"batch": batch, "versions": versions})
        return True

    def snapshot(self, number: int | None = None) -> dict[str, DataFrame | None]:
        """Every table as of one version of the set, the last one without a number; none where it has no rows yet."""
        state = self.manifest.state(number) or {"versions": {}}
        return {name: table.table(v) if (v := state["versions"].get(name, -1)) >= 0 else None for name, table in self.tables.items()}
