"""A stored vector index: an inverted file of cells with product-quantised residuals.

Directions are dealt to the cell of the nearest of a bounded number of centres. What is left of a
vector beside its centre is cut in parts, and each part is the number of the nearest of 256 code
words. A search looks up the cells nearest to a question, ranks their rows by tables of the question's
products with the code words, and scores the best of them exactly from the stored vectors.

The exact mode needs no code words: from the cells nearest to a question follows a score that the last
of its results has at least; of all other cells only those are read whose widest row could exceed it,
by the angle between question and centre less the cell's radius.

Centres and code words are fitted once on SAMPLE rows at most, drawn by a hash of the key, and on these it
is tried how many cells a search has to look up to find TARGET of the nearest rows. Every row is
indexed. Rows are stored by cell, an append is a new batch, and a batch counts with the version that
names it. A cell of many rows, as one of copies, is searched in blocks by several tasks.

Vectors that are null, empty, not finite, zero or of another length than those of the sample are never
found; questions of that kind have no results. Equal scores are ranked by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairoscope.functions import vector as V
from kairoscope.session import materialise
from kairoscope.storage.manifest import Manifest

#: Rows that centres and code words are fitted on, and the most centres.
SAMPLE, MOST_CELLS = 20_000, 4_096
#: Dimensions of a part, code words of a part, and steps of a fit.
PART, WORDS, STEPS = 4, 256, 12
#: Rows of a cell that one task searches.
BLOCK_ROWS = 20_000
#: Rows of the sample that try out how many cells a search needs, and the share of their nearest rows that it has to find.
TRIED, TARGET = 200, 0.97
#: For each result so many rows of a block are scored exactly.
REFINE = 10


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the centre nearest to each row."""
    out = np.empty(len(rows), np.int64)
    half = (centres**2).sum(axis=1) / 2
    for a in range(0, len(rows), 4_096):
        out[a : a + 4_096] = np.argmax(rows[a : a + 4_096] @ centres.T - half, axis=1)
    return out


def fit_centres(rows: np.ndarray, count: int, seed: int, on_sphere: bool = False) -> np.ndarray:
    """``count`` centres of rows by rounds of assigning and averaging; a centre without rows moves to the row farthest from its own."""
    chosen = np.random.default_rng(seed).choice(len(rows), min(count, len(rows)), replace=False)
    centres = rows[np.sort(chosen)].copy()
    for _ in range(STEPS):
        own = nearest(rows, centres)
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        far = np.argsort(-((rows - centres[own]) ** 2).sum(axis=1), kind="stable")
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        empty = np.flatnonzero(size == 0)
        centres[empty] = rows[far[: len(empty)]]
        if on_sphere:
            length = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(length > 0, centres / np.maximum(length, 1e-300), rows[: len(centres)])
    return centres


@dataclass
class Model:
    """Centres (unit length) and the code words of each part of a residual."""

    centres: np.ndarray
    words: np.ndarray
    #: Cells that a search looks up.
    probes: int

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, seed: int = 1) -> Model:
        rows = unit(sample)
        centres = fit_centres(rows, cells, seed, on_sphere=True)
        own = nearest(rows, centres)
        left = cls._parts(rows - centres[own])
        words = np.stack([fit_centres(left[:, p], WORDS, seed + 1 + p) for p in range(left.shape[1])])
        return cls(centres, words, cls._needed(rows, own, centres))

    @staticmethod
    def _needed(rows: np.ndarray, own: np.ndarray, centres: np.ndarray, k: int = 10) -> int:
        """The cells nearest to a row that hold TARGET of its k nearest rows of the sample."""
        asked = rows[:TRIED]
        near = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :k]
        place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1

    @staticmethod
    def _parts(rows: np.ndarray) -> np.ndarray:
        short = -rows.shape[1] % PART
        return np.pad(rows, ((0, 0), (0, short))).reshape(len(rows), -1, PART)

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code and angle to the centre of rows of unit length."""
        cell = nearest(rows, self.centres)
        left = self._parts(rows - self.centres[cell])
        code = np.stack([nearest(left[:, p], self.words[p]) for p in range(left.shape[1])], axis=1).astype(np.uint8)
        return cell, code, np.arccos(np.clip((rows * self.centres[cell]).sum(axis=1), -1, 1))

    def estimate(self, question: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """The score of each row of a cell, from its code."""
        table = np.einsum("pwd,pd->pw", self.words, self._parts(question[None])[0])
        return question @ self.centres[cell] + table[np.arange(code.shape[1]), code].sum(axis=1)

    def to_row(self) -> tuple:
        return (self.centres.shape[1], self.centres.astype("<f8").tobytes(), self.words.shape[1], self.words.astype("<f8").tobytes(), self.probes)

    @classmethod
    def from_row(cls, row: tuple) -> Model:
        dims, centres, words, flat, probes = row
        return cls(np.frombuffer(centres, "<f8").reshape(-1, dims), np.frombuffer(flat, "<f8").reshape(-1, words, PART), probes)


def _best(keys: list, score: np.ndarray, k: int) -> list[int]:
    """Places of the k best; equal scores by key."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        among = np.flatnonzero(score >= least).tolist()
    else:
        among = range(len(score))
    return sorted(among, key=lambda i: (-score[i], keys[i]))[:k]


class VectorIndex:
    """``path``/model, and ``path``/rows/<batch>/cell=<n> for the batches that the last version names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, path)
        self.model = Model.from_row(spark.read.parquet(f"{self.path}/model").first())
        self.dims = self.model.centres.shape[1]

    @classmethod
    def create(cls, vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Fits centres on a bounded sample of ``vectors`` and indexes all of them."""
        spark = vectors.sparkSession
        valid = vectors.where(V.is_valid(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"))
        total = valid.count()
        drawn = valid.orderBy(F.xxhash64("key"), "key").limit(sample).toArrow()
        lengths = np.array(pa.compute.list_value_length(drawn["vector"].combine_chunks()).to_pylist(), np.int64)
        if not len(lengths):
            raise ValueError("an index needs a valid vector")
        dims = int(np.bincount(lengths).argmax())
        rows = matrix(drawn["vector"].combine_chunks().filter(pa.array(lengths == dims)))
        count = cells or max(1, min(MOST_CELLS, int(total**0.5), len(rows) // 16))
        model = Model.fit(rows, count)
        spark.createDataFrame([model.to_row()], "dims int, centres binary, words int, codes binary, probes int").coalesce(1).write.parquet(f"{path.rstrip('/')}/model")
        index = cls(spark, path)
        index.append(vectors, key, vector)
        return index

    def append(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        """Indexes more rows as one batch."""
        found = self._valid(vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector")), "vector")
        model, kind = self.spark.sparkContext.broadcast(self.model), found.schema["key"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, code, angle = model.value.assign(unit(matrix(batch.column("vector"))))
                    yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vector"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(angle), pa.array(cell, pa.int32())], names=["key", "vector", "code", "angle", "cell"])

        rows = materialise(found.mapInArrow(run, f"key {kind}, vector array<float>, code binary, angle double, cell int"), "assigned")
        sizes = rows.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
        batch = uuid.uuid4().hex
        sizes.coalesce(1).write.parquet(f"{self.path}/sizes/{batch}")  # a row a cell
        # A cell's rows are written by a few tasks, as many as its share asks for.
        blocks = F.pmod(F.xxhash64("key"), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int")
        dealt = rows.join(F.broadcast(sizes.select("cell", "rows")), "cell").withColumn("__block", blocks)  # a row a cell
        dealt.repartition("cell", "__block").drop("__block", "rows", "angle").write.partitionBy("cell").parquet(f"{self.path}/rows/{batch}")
        state = self.manifest.state() or {"batches": []}
        self.manifest.commit(self.manifest.last() + 1, {"batches": [*state["batches"], batch]})

    def _valid(self, rows: DataFrame, vector: str) -> DataFrame:
        return rows.where(V.is_valid(F.col(vector)) & (F.size(vector) == self.dims))

    def _batches(self, name: str, schema: str) -> DataFrame:
        """The rows of all batches of the last version."""
        parts = [f"{self.path}/{name}/{b}" for b in self.manifest.state()["batches"]]
        found = self.spark.read.schema(schema)
        out = found.parquet(parts[0])
        for p in parts[1:]:
            out = out.unionByName(found.parquet(p))
        return out

    def rows(self) -> DataFrame:
        """key, vector, code and cell of all that is indexed."""
        first = self.spark.read.parquet(f"{self.path}/rows/{self.manifest.state()['batches'][0]}")
        return self._batches("rows", f"key {first.schema['key'].dataType.simpleString()}, vector array<float>, code binary, cell int")

    def cells(self) -> DataFrame:
        """cell, rows, radius, blocks; a row a cell."""
        found = self._batches("sizes", "cell int, rows long, radius double").groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"))
        return found.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int"))

    def _near(self, queries: DataFrame, query_key: str, vector: str) -> tuple[DataFrame, DataFrame]:
        """The valid questions (query, vector), and query, cell, place (by distance) and angle of each question and centre."""
        asked = self._valid(queries.select(F.col(query_key).alias("query"), F.col(vector).cast("array<float>").alias("vector")), "vector")
        model, kind = self.spark.sparkContext.broadcast(self.model), asked.schema["query"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    angle = np.arccos(np.clip(unit(matrix(part.column("vector"))) @ model.value.centres.T, -1, 1))
                    place = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1)
                    n, c = angle.shape
                    yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(np.repeat(np.arange(n), c))), pa.array(np.tile(np.arange(c), n), pa.int32()), pa.array(place.ravel(), pa.int32()), pa.array(angle.ravel())], names=["query", "cell", "place", "angle"])

        return asked, asked.mapInArrow(run, f"query {kind}, cell int, place int, angle double")

    def _scored(self, asked: DataFrame, wanted: DataFrame, k: int, refine: int | None) -> DataFrame:
        """query, key, score: of each wanted (query, cell) the k best of every block; scored exactly, all rows or those with the best estimates."""
        cells = F.broadcast(self.cells().select("cell", "blocks"))  # a row a cell
        wanted = materialise(wanted.join(cells, "cell").join(asked, "query"), "wanted")
        questions = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("query", "vector", "cell", "block")
        read = F.broadcast(wanted.select("cell", "blocks").distinct())  # a row a cell; prunes the folders that are read
        rows = self.rows().join(read, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
        model = self.spark.sparkContext.broadcast(self.model)
        query_kind, key_kind = (f.dataType.simpleString() for f in (asked.schema["query"], rows.schema["key"]))

        def score(own: pa.Table, asks: pa.Table) -> pa.Table:
            out: dict[str, list] = {"query": [], "key": [], "score": []}
            if own.num_rows and asks.num_rows:
                keys, vectors = own["key"].to_pylist(), unit(matrix(own["vector"]))
                code = np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8).reshape(len(keys), -1)
                cell = own["cell"][0].as_py()
                for query, q in zip(asks["query"].to_pylist(), unit(matrix(asks["vector"])), strict=True):
                    at = np.arange(len(keys))
                    if refine is not None and len(keys) > k * refine:
                        guess = model.value.estimate(q, cell, code)
                        at = np.flatnonzero(guess >= np.partition(guess, len(guess) - k * refine)[len(guess) - k * refine])
                    exact = np.round(vectors[at] @ q, 9)
                    for i in _best([keys[j] for j in at], exact, k):
                        out["query"].append(query)
                        out["key"].append(keys[at[i]])
                        out["score"].append(float(exact[i]))
            return pa.table({"query": pa.array(out["query"], asks.schema.field("query").type), "key": pa.array(out["key"], own.schema.field("key").type), "score": pa.array(out["score"], pa.float64())})

        return rows.groupBy("cell", "block").cogroup(questions.groupBy("cell", "block")).applyInArrow(score, f"query {query_kind}, key {key_kind}, score double")

    def search(self, queries: DataFrame, k: int, query_key: str = "query_id", vector: str = "embedding", probes: int | None = None, refine: int = REFINE, exact: bool = False) -> DataFrame:
        """``query_key``, key, score, rank: the k rows nearest to each question by cosine.

        ``exact``: certainly; otherwise those of the ``probes`` nearest cells (by default as many as the sample needed),
        by estimate for all but ``k * refine`` of a block.
        """
        probes = probes or self.model.probes
        asked, near = self._near(queries, query_key, vector)
        asked = materialise(asked, "asked")
        first = self._scored(asked, near.where(F.col("place") < probes).select("query", "cell"), k, None if exact else refine)
        if exact:
            first = materialise(first, "first")
            least = ranked(first, "query", k).groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
            sizes = F.broadcast(self.cells().select("cell", "radius"))  # a row a cell
            others = near.where(F.col("place") >= probes).join(sizes, "cell").join(least, "query", "left")
            bound = F.cos(F.greatest(F.col("angle") - F.col("radius"), F.lit(0.0)))
            first = first.union(self._scored(asked, others.where(F.col("least").isNull() | (bound >= F.col("least") - 1e-6)).select("query", "cell"), k, None))
        return ranked(first, "query", k).withColumnRenamed("query", query_key)


def ranked(scored: DataFrame, query_key: str, k: int, key: str = "key") -> DataFrame:
    """The k best of each question, equal scores by key."""
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, query_key: str, key: str = "key") -> DataFrame:
    """query_key, wanted, hits, recall: how many of the true results of each question are found."""
    hit = found.select(query_key, key).withColumn("__hit", F.lit(1))
    both = truth.select(query_key, key).join(hit, [query_key, key], "left")
    return both.groupBy(query_key).agg(F.count("*").alias("wanted"), F.count("__hit").alias("hits"), (F.count("__hit") / F.count("*")).alias("recall"))
