"""Substring joins of paths by an index of their pieces, and calls by short names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.operators.retrieval import small
from kairoscope.session import materialise

#: Characters of a piece.
PIECE = 3
#: Rows of callers or of functions that one cell has, and pairs that a task holds before it sends them.
CELL, AT_ONCE = 1 << 19, 1 << 18


def pieces(text: Column, size: int | Column) -> Column:
    """at, piece: all pieces of a text, with their places from 1."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.struct(i.alias("at"), F.substring(text, i, size).alias("piece"))))


def contains_join(paths: DataFrame, parts: DataFrame, scope: str = "repo_id", path: str = "path", part: str = "part") -> DataFrame:
    """scope, path, part: each part with the paths of its scope that contain it, once.

    A part is looked up by its rarest piece of three characters (a shorter part as a whole), and a path that has the
    piece is held against the part at that place. So a part costs the paths that have its rarest piece, and no
    path is compared with all parts. Null and empty parts are in nothing.
    """
    own = materialise(paths.select(scope, F.col(path).alias("path")).dropna().distinct(), "paths")
    wanted = materialise(parts.select(scope, F.col(part).alias("part")).dropna().where("part <> ''").distinct(), "parts")
    size = F.least(F.length("part"), F.lit(PIECE))
    sizes = [r.n for r in wanted.select(size.alias("n")).distinct().collect()]  # three at most
    every = own.select(scope, "path", F.explode(F.array_union(F.array().cast("array<int>"), F.array(*[F.lit(n) for n in sizes] or [F.lit(PIECE)]))).alias("n"))
    index = every.select(scope, "path", F.explode(pieces(F.col("path"), F.col("n"))).alias("p")).select(scope, "path", "p.*")
    asked = wanted.select(scope, "part", F.explode(pieces(F.col("part"), size)).alias("p")).select(scope, "part", "p.*")
    # Only pieces that some part has are kept of the index.
    index = materialise(index.join(small(asked.select(scope, "piece").distinct()), [scope, "piece"]), "pieces")
    often = index.groupBy(scope, "piece").agg(F.count("*").alias("n"))
    rarest = asked.join(often, [scope, "piece"], "left").groupBy(scope, "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "piece")).alias("r"))
    rarest = materialise(rarest.where("r.n > 0").select(scope, "part", F.col("r.at").alias("inside"), F.col("r.piece").alias("piece")), "rarest")
    begin = F.col("at") - F.col("inside") + 1
    found = index.join(small(rarest), [scope, "piece"]).where((begin >= 1) & (F.substring(F.col("path"), begin, F.length("part")) == F.col("part")))
    return found.select(scope, F.col("path").alias(path), F.col("part").alias(part)).distinct()


def _callees(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every caller of one cell with the functions of the cell that its names lead to, each once: a set a caller, in rows of many callers."""
    rows = pa.Table.from_batches(list(batches))
    ends = rows["end"].combine_chunks().dictionary_encode()
    end, texts = ends.indices.to_numpy(), ends.dictionary
    name = rows["name"].combine_chunks().dictionary_encode().indices.to_numpy()
    calls = rows["calls"].to_numpy()
    found = np.flatnonzero(~calls)
    found = found[np.argsort(name[found], kind="stable")]
    first = np.searchsorted(name[found], np.arange(name.max() + 2))  # where the functions of each name begin
    found = end[found]
    asked = np.flatnonzero(calls)
    asked = asked[np.argsort(end[asked], kind="stable")]
    callers, begin = np.unique(end[asked], return_index=True)
    begin = np.append(begin, len(asked))
    met = np.zeros(len(texts), bool)
    waiting, total = [], 0

    def batch() -> pa.RecordBatch:
        of, to = [texts.take(pa.array(x)) for x in ([c for c, _ in waiting], np.concatenate([t for _, t in waiting]))]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(t) for _, t in waiting)]), pa.int32()), to)
        return pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(of), key[0].type), of, lists], names=["repo_id", "caller", "callees"])

    for n, caller in enumerate(callers):
        for x in np.unique(name[asked[begin[n] : begin[n + 1]]]):
            met[found[first[x] : first[x + 1]]] = True
        met[caller] = False
        to = np.flatnonzero(met).astype(np.int32)
        met[:] = False
        if len(to):
            waiting.append((caller, to))
            total += len(to)
        if total >= AT_ONCE:
            yield batch()
            waiting, total = [], 0
    if waiting:
        yield batch()


def short_name_calls(calls: DataFrame, functions: DataFrame, cell: int = CELL) -> DataFrame:
    """repo_id, caller, callee: calls (repo_id, caller, name) to every other function (repo_id, name, signature) of that name.

    The pairs of one caller are a set within one task, so no pair is shuffled, whichever names lead to it. Callers
    and functions of a repository are dealt to stretches of about ``cell`` rows, and every stretch of the one meets every
    stretch of the other in a task of its own; what is sent is each row once for every stretch of the other side.
    """
    calls, functions = calls.select("repo_id", F.col("caller").alias("end"), "name").dropna(), functions.select("repo_id", F.col("signature").alias("end"), "name").dropna()
    share = lambda df, c: df.groupBy("repo_id").agg(F.ceil(F.count("*") / cell).cast("int").alias(c))
    sizes = small(materialise(share(calls, "__m").join(share(functions, "__n"), "repo_id"), "sizes"))

    def dealt(df: DataFrame, own: str, other: str, one: str, two: str) -> DataFrame:
        copies = df.join(sizes, "repo_id").withColumns({one: F.pmod(F.xxhash64("end"), F.col(own)).cast("int"), two: F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        return copies.select("repo_id", "__c", "__f", F.lit(own == "__m").alias("calls"), "end", "name")

    rows = dealt(calls, "__m", "__n", "__c", "__f").unionByName(dealt(functions, "__n", "__m", "__f", "__c"))
    # The work of a cell is not told by its bytes, so adaptive execution is not to merge them.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "repo_id", "__c", "__f")
    lists = rows.groupBy("repo_id", "__c", "__f").applyInArrow(_callees, f"repo_id {calls.schema['repo_id'].dataType.simpleString()}, caller string, callees array<string>")
    return lists.select("repo_id", "caller", F.explode("callees").alias("callee"))
