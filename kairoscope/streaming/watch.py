"""A watched source tree: what its listing says has changed is parsed again and merged."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairoscope.operators.code_store import FILE
from kairoscope.session import materialise
from kairoscope.sources import code, files
from kairoscope.storage.snapshot import TableSet

#: What is indexed, and how long a file has to be left alone first.
SUFFIXES, WAIT_US = [".py", ".js", ".ts", ".tsx", ".jsx"], 1_000_000
KEYS = {"files": FILE, "items": [*FILE, "place"]}


def read_contents(paths: DataFrame) -> DataFrame:
    """``paths`` (uri and other columns) with the content of each file; null for one that is gone meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri in batch.column("uri").to_pylist():
                system, name = fs.FileSystem.from_uri(uri)
                try:
                    with system.open_input_stream(name) as f:
                        out.append(f.read().decode("utf-8", "replace"))
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "content"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema.fields)
    return paths.mapInArrow(run, f"{fields}, content string")


class Watcher:
    """Keeps ``path``'s tables files (repo_id, path, modified, size) and items (what code.parse_files() finds) in step with a tree.

    A poll lists the tree, which reads no contents, and compares it with the stored listing: new files, files of another
    size or time, and files that are gone. A file that was written less than ``wait_us`` ago is left for the next
    poll, so that a burst of writes is parsed once. Both tables change in one version. A poll that is cut off
    is repeated by the next one.
    """

    def __init__(self, spark: SparkSession, path: str, root: str, repo_id: str, suffixes: list[str] | None = None, wait_us: int = WAIT_US):
        self.spark, self.root, self.repo_id, self.suffixes, self.wait = spark, root, repo_id, suffixes or SUFFIXES, wait_us
        self.tables = TableSet(spark, path, KEYS, "seq")

    def listing(self) -> DataFrame:
        """repo_id, path, uri, modified (microseconds) and size of the files that are watched."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        base = F.regexp_replace("path", "^.*?" + re.escape(self.root.rstrip("/").split("://")[-1]) + "/", "")
        rows = found.select(F.lit(self.repo_id).alias("repo_id"), base.alias("path"), F.col("path").alias("uri"), F.unix_micros("modificationTime").alias("modified"), F.col("length").alias("size"))
        wanted = F.lit(False)
        for s in self.suffixes:
            wanted = wanted | F.col("path").endswith(s)
        return rows.where(wanted & ~files.ignored(F.col("path")))

    def poll(self, now_us: int) -> DataFrame:
        """repo_id, path, change (added, changed, deleted): what was merged."""
        stored = self.tables.snapshot()
        empty = self.spark.createDataFrame([], "repo_id string, path string, old_modified long, old_size long")
        old = empty if stored["files"] is None else stored["files"].select(*FILE, F.col("modified").alias("old_modified"), F.col("size").alias("old_size"))
        both = self.listing().join(old, FILE, "full_outer")
        other = ~(F.col("modified").eqNullSafe(F.col("old_modified")) & F.col("size").eqNullSafe(F.col("old_size")))
        change = F.when(F.col("uri").isNull(), "deleted").when(F.col("old_modified").isNull(), "added").when(other, "changed")
        changes = both.withColumn("change", change).where(F.col("change").isNotNull() & ((F.col("change") == "deleted") | (F.col("modified") <= now_us - self.wait)))
        changes = materialise(changes.select(*FILE, "uri", "modified", "size", "change"), "changes")
        if not changes.take(1):
            return changes.select(*FILE, "change")
        fresh = materialise(read_contents(changes.where("change <> 'deleted'")).where("content IS NOT NULL"), "contents")
        gone = changes.join(fresh.select(*FILE), FILE, "left_anti")  # deleted, or gone since the listing
        place = F.row_number().over(Window.partitionBy(*FILE).orderBy("line", "column", "kind", "qualified_name")) - 1
        items = materialise(code.parse_files(fresh).withColumn("place", place), "items")
        batch = self.tables.batch() + 1
        mark = lambda rows, op: rows.withColumns({"seq": F.lit(batch).cast("long"), "op": F.lit(op)})
        new_files = mark(fresh.select(*FILE, "modified", "size"), "update").unionByName(mark(gone.select(*FILE, F.lit(None).cast("long").alias("modified"), F.lit(None).cast("long").alias("size")), "delete"))
        new_items = mark(items, "update")
        if stored["items"] is not None:
            lost = stored["items"].drop("seq").join(changes.select(*FILE), FILE, "left_semi").join(items.select(*KEYS["items"]), KEYS["items"], "left_anti")
            new_items = new_items.unionByName(mark(lost, "delete"))
        self.tables.merge({"files": new_files, "items": new_items}, batch)
        return changes.select(*FILE, "change")

    def follow(self, clock: Callable[[], int], seconds: int = 1):
        """A running stream that polls every so many seconds."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda _rows, _n: self.poll(clock())).trigger(processingTime=f"{seconds} seconds").start()
