"""A table by key that takes batches of changes and rewrites only the buckets that they touch.

Rows are dealt to buckets by a hash of their key. A batch of changes is folded with the rows of its
buckets, these are written as new files, and a version that names them is put in place by one rename.
So bytes written follow the batch (and the size of a bucket), rows of a large bucket are several tasks' and
files, a reader sees a whole version, and a
batch that is delivered again, also after a restart, changes nothing. A change that fails leaves files
that no version names, for vacuum() to remove.

The last change of a key counts, by ``order`` and then by content, so that ties have one result. A
deleted key stays as a row with ``deleted`` until its change lies more than ``horizon`` behind the newest
change of a batch that rewrites its bucket; a change older than that could bring it back. Rows whose
key has a null are of the bucket that its hash names, as any others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kairoscope.session import tasks
from kairoscope.storage.manifest import Manifest

BUCKETS = 64


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key, of equal order the first by a hash of its content."""
    content = F.xxhash64(*[c for c in changes.columns if c not in keys])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), content))
    return changes.withColumn("__r", place).where("__r = 1").drop("__r")


class KeyedTable:
    """``path``/data/<write>/__bucket=<n>; a version says for each bucket which write has it."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = BUCKETS, horizon: int | None = None):
        self.spark, self.path, self.keys, self.order, self.horizon = spark, path.rstrip("/"), keys, order, horizon
        self.manifest = Manifest(spark, path)
        self.buckets = (self.manifest.state() or {"n": buckets})["n"]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def batch(self) -> int:
        """The number of the last batch that is in the table; -1 before the first."""
        return (self.manifest.state() or {"batch": -1})["batch"]

    def rows(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, deleted ones too, of all or some buckets; none before the first."""
        state = self.manifest.state(number)
        if state is None or not state["files"]:
            return None
        paths = [f"{self.path}/data/{write}/__bucket={b}" for b, write in state["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(StructType.fromJson(state["schema"])).parquet(*paths) if paths else None

    def table(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version that are not deleted."""
        rows = self.rows(number)
        return None if rows is None else rows.where("NOT deleted").drop("deleted")

    def merge(self, changes: DataFrame, batch: int) -> bool:
        """Folds changes (the columns of the table and ``op``, where delete removes a key) in; false where the batch is in already."""
        state = self.manifest.state() or {"batch": -1, "files": {}, "n": self.buckets}
        if batch <= state["batch"]:
            return False
        new = latest(changes.withColumn("deleted", F.coalesce(F.col("op") == "delete", F.lit(False))).drop("op"), self.keys, self.order)
        new = new.withColumn("__bucket", self._bucket()).persist()
        try:
            found = new.groupBy("__bucket").agg(F.max(self.order).alias("newest"), F.count("*").alias("n")).collect()  # a row a bucket
            if not found:
                self.manifest.commit(self.manifest.last() + 1, state | {"batch": batch})
                return True
            touched = [r["__bucket"] for r in found]
            old = self.rows(buckets=touched) if state["files"] else None
            count = sum(r["n"] for r in found) + (old.count() if old is not None else 0)
            both = new if old is None else old.withColumn("__bucket", self._bucket()).unionByName(new, allowMissingColumns=True).repartition(tasks(count), *self.keys)
            rows = new if old is None else latest(both, self.keys, self.order)
            if self.horizon is not None:
                rows = rows.where(~(F.col("deleted") & (F.col(self.order) < max(r["newest"] for r in found) - self.horizon)))
            write = uuid.uuid4().hex
            # A bucket is one task's, and a large one that of several.
            each = tasks(-(-count // len(touched)))
            rows.repartition(len(touched) * each, "__bucket", F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(each))).write.partitionBy("__bucket").parquet(f"{self.path}/data/{write}")
        finally:
            new.unpersist()
        written = {n.removeprefix("__bucket=") for n in self.manifest.folders(f"data/{write}") if n.startswith("__bucket=")}
        files = {b: w for b, w in state["files"].items() if int(b) not in touched} | {b: write for b in written}
        schema = rows.drop("__bucket").schema.jsonValue()
        self.manifest.commit(self.manifest.last() + 1, {"batch": batch, "files": files, "n": self.buckets, "schema": schema})
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the last versions, and the files that none of these names; how many writes went."""
        self.manifest.forget(keep)
        named = {(w, b) for n in self.manifest.numbers() for b, w in self.manifest.state(n)["files"].items()}
        gone = 0
        for write in self.manifest.folders("data"):
            for folder in self.manifest.folders(f"data/{write}"):
                if folder.startswith("__bucket=") and (write, folder.removeprefix("__bucket=")) not in named:
                    self.manifest.delete(f"data/{write}/{folder}")
            if write not in {w for w, _ in named}:
                gone += self.manifest.delete(f"data/{write}")
        return gone
