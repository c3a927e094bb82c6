"""A table of immutable shards with size-tiered compaction and a versioned manifest.

``append`` writes arrivals as small Parquet shards. ``compact`` looks at one tier at a time (a tier
holds the shards of one power of ``FACTOR`` in size): where at least ``MIN_RUN`` shards of a tier
are smaller than the target, they are merged into files of about the target size. Every change ends
with one atomic act, the renaming of ``manifest/v<N>``, which fails if another writer was first; the
change is then tried against the newer version. Readers see the version that they opened, whole.
Old shards stay until ``vacuum``, and files of failed attempts are in no manifest.

The manifest itself is a Parquet table (file, bytes, rows) of as many files as its size asks for. What
is merged and what is deleted is worked out by joins; the driver holds the shards of one merge (at
most ``MOST_MERGED``) and, for ``read``, the list of files that any scan holds there. Rows, nulls, repeats and column names are kept
as they are; appending an empty table commits a version without new shards. The columns of the first
append are kept beside the manifest, so that a table without shards is read as an empty one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kairoscope.session import materialise

TARGET_BYTES = 128 << 20
FACTOR, MIN_RUN = 4, 4
#: The most shards that one merge takes, the smallest first; what is left over is due for the next.
MOST_MERGED = 10_000
RETRIES = 20
_ENTRIES = "file string, bytes long, rows long"


class CommitConflict(RuntimeError):
    """Another writer committed the version first, more than ``RETRIES`` times."""


class ShardedTable:
    """``path`` holds data/ and manifest/; any Hadoop file system with an atomic rename will do."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target_bytes
        jvm = spark._jvm
        self._hadoop = spark._jsc.hadoopConfiguration()
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(self._hadoop)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self._hadoop)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        folder = self._at("manifest")
        if not self._files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return max([0, *(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())])

    def entries(self, version: int | None = None) -> DataFrame:
        """file, bytes and rows of the shards of a version."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], _ENTRIES)
        return self.spark.read.schema(_ENTRIES).parquet(f"{self.path}/manifest/v{version}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        files = [r.file for r in self.entries(version).select("file").collect()]
        if not self._files.exists(self._at("schema")):
            raise ValueError("the table has no shard yet")
        schema = self.schema()
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def schema(self) -> StructType:
        """The columns of the first append, which are those of all others."""
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))

    def _commit(self, entries: DataFrame, base: int) -> bool:
        """Makes ``entries`` version base + 1; False if that exists already."""
        draft = f"draft-{uuid.uuid4().hex}"
        entries.hint("rebalance").write.parquet(f"{self.path}/{draft}")  # as many files as its size asks for
        self._files.mkdirs(self._at("manifest"))
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            if self._files.exists(self._at(f"manifest/v{base + 1}")):
                return False
            self._context.rename(self._at(draft), self._at(f"manifest/v{base + 1}"), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or self._files.exists(self._at(f"manifest/v{base + 1}")):
                return False
            raise
        finally:
            self._files.delete(self._at(draft), True)
        return True

    def _written(self, folders: list[str]) -> DataFrame:
        """Size and rows of the files in new folders, as the executors find them."""
        meta = self.spark.read.option("recursiveFileLookup", "true").parquet(*folders).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return meta.groupBy("file").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"))

    def append(self, arrivals: DataFrame, batch: str | None = None) -> int:
        """Writes ``arrivals`` as they are partitioned, one small shard a task (with ``batch``: and value of that column), and commits them.

        Other columns, or other types, than those of the first append are an error; their order is free.
        """
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        self._keep_schema(arrivals)
        kept = {f.name: f.dataType for f in self.schema().fields}
        if {f.name: f.dataType for f in arrivals.schema.fields} != kept:
            raise ValueError(f"the table has the columns {sorted(kept)} in their types, not {sorted(arrivals.columns)}")
        if batch:
            free = "__batch"
            while free.lower() in (c.lower() for c in arrivals.columns):
                free += "_"
            arrivals.withColumn(free, F.col(batch)).write.option("compression", "zstd").partitionBy(free).parquet(folder)
        else:
            arrivals.write.option("compression", "zstd").parquet(folder)
        new = self._written([folder]) if self._has_files(folder) else self.spark.createDataFrame([], _ENTRIES)
        for _ in range(RETRIES):
            base = self.version()
            if self._commit(self.entries(base).union(new), base):
                return base + 1
        raise CommitConflict(self.path)

    def _keep_schema(self, arrivals: DataFrame) -> None:
        """Writes the columns of the first append; of two at once, one stays."""
        if self._files.exists(self._at("schema")):
            return
        draft = f"draft-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(arrivals.schema.json(),)], "value string").coalesce(1).write.text(f"{self.path}/{draft}")
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(self._at(draft), self._at("schema"), options)
        except Exception:
            if not self._files.exists(self._at("schema")):
                raise
        finally:
            self._files.delete(self._at(draft), True)

    def _has_files(self, folder: str) -> bool:
        """Without rows, a write by batch leaves no file that a schema could be read from."""
        found = self._files.listFiles(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
        while found.hasNext():
            if found.next().getPath().getName().startswith("part-"):
                return True
        return False

    def tiers(self, version: int | None = None) -> DataFrame:
        """The entries below the target with their tier: the power of FACTOR that their size reaches."""
        small = self.entries(version).where(F.col("bytes") < 0.75 * self.target)
        return small.withColumn("tier", F.floor(F.log(F.greatest("bytes", F.lit(1))) / F.log(F.lit(float(FACTOR)))).cast("int"))

    def compact(self) -> int:
        """Merges the runs of similar size, tier by tier from the smallest, until none is due; the number of merges."""
        merges, settled = 0, -1
        while True:
            base = self.version()
            tiers = self.tiers(base)
            due = tiers.groupBy("tier").agg(F.count("*").alias("n")).where(f"n >= {MIN_RUN} and tier > {settled}").agg(F.min("tier")).first()[0]
            if due is None:
                return merges
            chosen = tiers.where(F.col("tier") == due)
            chosen = materialise(chosen.orderBy("bytes", "file").limit(MOST_MERGED), "merged")
            files = [r.file for r in chosen.select("file").orderBy("file").collect()]
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            self._merge(files, chosen.agg(F.sum("bytes")).first()[0], folder)
            gone = chosen.select("file")
            if self._commit(self.entries(base).join(gone, "file", "left_anti").select("file", "bytes", "rows").union(self._written([folder])), base):
                merges += 1
                if len(files) <= self._count([folder]):
                    settled = due  # nothing became fewer: the tier is as merged as its sizes allow; the higher ones may be due
            # Another writer was first: the merged files stay unnamed, and the loop looks at the newer version.

    def _count(self, folders: list[str]) -> int:
        return self._written(folders).count()

    def _merge(self, files: list[str], total: int, folder: str) -> None:
        """Reads whole shards packed into tasks of about the target size, so that no row is shuffled."""
        session = self.spark.newSession()  # its settings are not the caller's
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        rows = session.read.parquet(*files)
        pieces = max(1, -(-total // self.target))
        rows.coalesce(pieces).write.option("compression", "zstd").parquet(folder)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the files that none of the last ``keep`` versions names; how many."""
        last = self.version()
        for v in range(1, last - keep + 1):
            self._files.delete(self._at(f"manifest/v{v}"), True)
        if not self._files.exists(self._at("data")):
            return 0
        used = self.spark.createDataFrame([], _ENTRIES)
        for v in range(max(1, last - keep + 1), last + 1):
            used = used.union(self.entries(v))
        name = lambda c: F.substring_index(c, "/data/", -1)
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/data").select("path")
        unused = there.join(used.select(name(F.col("file")).alias("name")), name(F.col("path")) == F.col("name"), "left_anti")
        found = 0
        for row in unused.toLocalIterator():  # no more than a part of the list is held at once
            self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(row.path), False)
            found += 1
        return found
