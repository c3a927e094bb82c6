"""Near duplicates by fast similarity sketching, banding and exact verification.

A sketch has COORDINATES bins. In each of the first COORDINATES rounds every token of a set is hashed
anew to a bin and a value; a bin keeps the least value of the first round that reached it. What is
still open then is filled bin by bin: a further round for each bin throws all tokens into that one.
So every coordinate is filled whatever the size of the set, a large set needs few rounds, and the
share of coordinates in which two sketches agree is concentrated about the Jaccard similarity as if
the bins were independent samples.

Bands of ROWS coordinates are index entries: two sets that share 0.8 of their union miss all BANDS of
them with a probability of (1 - 0.8 ** 6) ** 64, below 4e-9. Of each coordinate one more bit is kept; a pair
whose bits differ in more than MOST_BITS places (six standard deviations off a similarity of 0.8)
is not compared. All others are compared by their whole sets, so that every link is exact, by
set_links.entry_links(): a bucket of near copies costs a star, not its pairs.

Equal sets become one node before banding. Null, empty and wordless texts have no tokens and no
links, nor have rows without an id, whose component is null and which are kept. Rows that repeat an
id link each by its own text and are kept if the component is named after their id. Texts of any
length are sketched whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.components import connected_components
from kairoscope.llm.jaccard_join import set_digest
from kairoscope.llm.joins import salted_join, small
from kairoscope.llm.postings import id_rows, release, runs
from kairoscope.llm.set_links import entry_links
from kairoscope.llm.shingles import mix, shingle_set
from kairoscope.session import materialise

#: Words of a shingle, and per cent of the union that the intersection has to reach.
SHINGLE, PERCENT = 2, 80
BANDS, ROWS = 64, 6
COORDINATES = BANDS * ROWS
#: Texts are sketched in parts of about so many bytes, and rows.
PART_BYTES, PART_ROWS = 2 << 20, 1_000
_OPEN = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROUND = np.uint64(0x9E3779B97F4A7C15)


def most_bits(percent: int, coordinates: int = COORDINATES) -> int:
    """In how many coordinates the bits of two linked sets may differ: the mean for ``percent`` and six standard deviations."""
    p = (1 - percent / 100) / 2
    return int(coordinates * p + 6 * sqrt(coordinates * p * (1 - p)))


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row of ``coordinates`` values for each non-empty set of distinct 64-bit tokens."""
    n = len(sets)
    out = np.full(n * coordinates, _OPEN, np.uint64)
    tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    left = np.full(n, coordinates)
    for number in range(2 * coordinates):
        with np.errstate(over="ignore"):
            h = mix(tokens + _ROUND * np.uint64(number + 1))
        bins = ((h >> np.uint64(32)) * np.uint64(coordinates) >> np.uint64(32)).astype(np.int64) if number < coordinates else number - coordinates
        at = owner * coordinates + bins
        new = out[at] == _OPEN
        at = at[new]
        np.minimum.at(out, at, np.minimum((h << np.uint64(32) | h >> np.uint64(32))[new], _OPEN - np.uint64(1)))
        if len(at) > len(out) // 8:
            left = (out.reshape(n, coordinates) == _OPEN).sum(axis=1)
        else:
            left -= np.bincount(np.unique(at) // coordinates, minlength=n)
        more = left[owner] > 0
        if not more.any():
            break
        if not more.all():
            tokens, owner = tokens[more], owner[more]
    return out.reshape(n, coordinates)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One 64-bit entry a band for each sketch."""
    bands = rows.reshape(len(rows), BANDS, -1)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), BANDS)).copy()
    for i in range(bands.shape[2]):
        h = mix(h * np.uint64(0x100000001B3) + bands[:, :, i])
    return h.view(np.int64)


def sketch_bits(rows: np.ndarray) -> np.ndarray:
    """A bit of each coordinate, 64 of them to a number."""
    bit = mix(rows + _ROUND * np.arange(rows.shape[1], dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bit.astype(np.uint8), axis=1).view(np.int64)


def sketched_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (its number), doc, n, sig (digest of the set, null for an empty one), keys and bits of every row.

    Of several equal texts of a part only the first has keys and bits; rows without an id have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            part = (np.cumsum(sizes) - sizes) // PART_BYTES
            for a, b in runs(part * (len(sizes) // PART_ROWS + 1) + np.arange(len(sizes)) // PART_ROWS):
                docs_ = batch.column(0).slice(a, b - a).to_pylist()
                own, sets, n, sigs, at = {}, [], [], [], []
                for doc, text in zip(docs_, batch.column(1).slice(a, b - a), strict=True):
                    data = text.as_py()
                    tokens = shingle_set(data, SHINGLE)
                    sig = set_digest(tokens)
                    n.append(len(tokens))
                    sigs.append(sig)
                    first = doc is not None and sig is not None and sig not in own
                    at.append(len(sets) if first else None)
                    if first:
                        own[sig] = True
                        sets.append(tokens)
                rows = sketches(sets)
                keys, bits = band_keys(rows), sketch_bits(rows)
                lists = lambda x: pa.array([None if i is None else x[i] for i in at], pa.list_(pa.int64()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), lists(keys), lists(bits)], names=["doc", "n", "sig", "keys", "bits"])
        release()

    found = id_rows(docs, id_col, text_col).mapInArrow(run, "doc long, n long, sig binary, keys array<long>, bits array<long>")
    return found.withColumn("row", F.monotonically_increasing_id())


def token_rows(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, n and tokens of the sets of ``wanted`` (row, sig, head); doc is the row's number. Only their texts are read again."""
    rows = salted_join(id_rows(docs, id_col, text_col), wanted.select(F.col("head").alias("doc")).distinct(), "doc", F.xxhash64("text"), how="left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in runs((np.cumsum(sizes) - sizes) // PART_BYTES):
                own: dict[tuple[int, bytes], np.ndarray] = {}
                for doc, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a), strict=True):
                    tokens = shingle_set(text.as_py(), SHINGLE)
                    if len(tokens):
                        own[doc, set_digest(tokens)] = tokens.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary()), pa.array(list(own.values()), pa.list_(pa.int64()))], names=["head", "sig", "tokens"])
        release()

    found = rows.mapInArrow(run, "head long, sig binary, tokens array<long>").join(small(wanted), ["sig", "head"])
    found = materialise(found.select(F.col("row").alias("doc"), F.size("tokens").cast("long").alias("n"), "tokens"), "tokens")
    # Only rows that repeat both id and text give a set twice.
    return found if found.count() == wanted.count() else materialise(found.dropDuplicates(["doc"]), "tokens")


def similar(percent: int = PERCENT) -> Callable[[str, str], Column]:
    """The condition that every link meets: sizes, and bits of the sketches that differ in few places."""

    def condition(x: str, y: str) -> Column:
        different = sum((F.bit_count(F.col(f"{x}bits")[i].bitwiseXOR(F.col(f"{y}bits")[i])) for i in range(COORDINATES // 64)), F.lit(0))
        sizes = 100 * F.least(f"{x}n", f"{y}n") >= percent * F.greatest(f"{x}n", f"{y}n")
        return sizes & (different <= most_bits(percent))

    return condition


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id_col``, n_shingles, component_id (the smallest id reachable by links) and kept for every row of ``docs``."""
    sets = materialise(sketched_sets(docs, id_col, text_col), "sketches")
    own = sets.where("sig IS NOT NULL AND doc IS NOT NULL")
    nodes = own.groupBy("sig").agg(F.min("doc").alias("head"), F.min(F.when(F.col("keys").isNotNull(), F.col("row"))).alias("node"), F.count("keys").alias("sketches"), F.count("*").alias("copies"))
    nodes = materialise(nodes, "nodes")
    # A set that several parts have sketched is indexed once.
    again = nodes.where("sketches > 1").select("sig", "node")
    first = salted_join(own.where("keys IS NOT NULL").select("row", "n", "sig", "keys", "bits"), again, "sig", F.col("row")).where("node IS NULL OR node = row")
    entries = first.select("row", F.explode("keys").alias("entry"))
    often = materialise(entries.groupBy("entry").agg(F.count("*").alias("members")).where("members > 1"), "often")
    shared = materialise(salted_join(entries, often, "entry", F.col("row"), how="inner"), "shared")
    # The set that meets most others in its buckets is the centre of each of them.
    central = materialise(shared.groupBy("row").agg(F.sum("members").cast("double").alias("central")), "central")
    members = materialise(first.select("row", "n", "sig", "bits").join(central, "row").join(nodes.select("sig", "head"), "sig"), "members")
    tokens = token_rows(docs, members.select("sig", "head", "row"), id_col, text_col)
    indexed = salted_join(shared.select("row", "entry"), members.drop("sig", "head"), "row", F.col("entry"), how="inner")
    indexed = materialise(indexed.select("entry", F.col("row").alias("doc"), "n", F.col("n").alias("s"), "central", "bits"), "indexed")
    parts = connected_components(entry_links(indexed, tokens, percent, similar(percent)))
    parts = parts.join(nodes.select("node", "head", "sig"), "node")
    least = parts.groupBy("component").agg(F.min("head").alias("least"))
    parts = parts.join(least, "component").select("sig", "least")
    # Any set without copies or links is its own component.
    known = nodes.where("copies > 1").select("sig", F.col("head").alias("least")).join(parts.select("sig"), "sig", "left_anti").union(parts)
    out = salted_join(sets.select("doc", "n", "sig", "row"), materialise(known, "parts"), "sig", F.col("row"))
    component = F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))
