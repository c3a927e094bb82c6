"""Removal of byte strings that occur in an earlier document, by external suffix sorting of shards.

A string of ``LENGTH`` bytes is removed where it also starts in a document with a smaller id. Every
such string has an anchor: the position of its smallest hash of ``ANCHOR`` bytes, so equal strings
have equal anchors. Anchors that only one text has settle their strings at once; different texts with
the same anchors count each, as what lies between anchors may differ. What is
around the others is cut into segments and sent, each distinct one once for a group of documents,
to the shard of its anchor. A shard is one partition: its bytes go to a file as they arrive, one
external induced sort puts all of its suffixes in order, and those with ``LENGTH`` bytes in common
with the suffix before them form the groups of equal strings. Decisions rest on these bytes, not on
hashes. The shards send back ranges, which each document joins and cuts out.

Null texts are empty; texts shorter than LENGTH keep everything. Rows without an id are kept whole
and remove nothing elsewhere. Rows that repeat an id are judged each by its own text; as none of
their ids is smaller, nothing is removed among them. An empty table gives an empty result. A text
of any length is handled whole, by the tasks of its group; columns of other names may have any name.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm import shingles
from kairoscope.llm.induced_sort import large_array, sorted_suffixes
from kairoscope.llm.joins import salted_join
from kairoscope.llm.postings import answers_in_order, count_tokens, group_column, group_tokens, id_rows, narrow, release, runs, sizes, wide
from kairoscope.session import materialise

LENGTH, ANCHOR = 50, 20
#: Starts that are looked at together when ranges are made, and ranges that are sent together.
STARTS_AT_ONCE, RANGES_AT_ONCE = 500_000, 200_000
_SEGMENTS = "shard long, bytes binary, lengths binary, counts binary, docs binary, starts binary"
_RANGES = "group long, docs binary, starts binary, lengths binary"
#: The bits of a start that hold the place in the text; above them is the number of a text among those of one id.
TAG_BITS = 40
_CLEANED = "doc long, kept binary, n_bytes long, n_removed long, n_spans long"


def _anchor_keys(raw: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """For the string at each position: its smallest anchor hash (upper 58 bits) and that one's position modulo 64."""
    n = len(raw) - anchor + 1
    hashes = np.empty(n, np.uint64)
    values = shingles._VALUES[raw]
    for a in range(0, n, shingles.STRETCH):
        b = min(n, a + shingles.STRETCH)
        m = b - a + anchor - 1
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(values[a : a + m] * shingles._powers("base", m), dtype=np.uint64, out=sums[1:])
        hashes[a:b] = (sums[anchor:] - sums[: b - a]) * shingles._powers("inverse", m)[: b - a]
    key = shingles.mix(hashes) & ~np.uint64(63) | (np.arange(n, dtype=np.uint64) & np.uint64(63))
    span, have = length - anchor + 1, 1
    while have < span:
        step = min(have, span - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    return key


def anchors(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit anchor hashes and the first and last start of the strings that each one stands for."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = _anchor_keys(raw, length, anchor)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts] >> np.uint64(16), starts, np.append(starts[1:], len(key)) - 1


def _tokens(text: bytes) -> np.ndarray:
    """The anchors of a text as tokens: as least hashes they are small numbers, so they are spread again."""
    return np.unique(shingles.mix(anchors(text)[0]))


def _copies(rows: DataFrame, groups: int, length: int) -> DataFrame:
    """group, copies: id and digest of whole texts that a smaller id has too. A group is bounded, as postings.sizes() makes it."""
    slim = rows.where(F.octet_length("text") >= length).select("doc", F.sha2("text", 256).alias("sha"))
    heads = slim.groupBy("sha").agg(F.min("doc").alias("head"), F.max("doc").alias("top")).where("head < top").select("sha", "head")
    heads = materialise(heads, "heads")
    later = salted_join(slim, heads, "sha", F.col("doc"), how="inner").where("doc > head")
    return later.groupBy(group_column(F.col("doc"), groups).alias("group")).agg(F.collect_set(F.struct("doc", "sha")).alias("copies"))


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys the sorted ``known`` has."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _copies_in(table: pa.Table) -> dict[int, set[str]]:
    """Of each id the digests of its texts that are copies."""
    found: dict[int, set[str]] = {}
    for row in table.column("copies"):
        if row.is_valid:
            for x in row.as_py():
                found.setdefault(x["doc"], set()).add(x["sha"])
    return found


def _is_copy(copies: dict[int, set[str]], doc: int, text: bytes) -> bool:
    return doc in copies and hashlib.sha256(text).hexdigest() in copies[doc]


def _tags(texts: pa.Table) -> list[int]:
    """For each row the number of its text among the different texts of its id; with single ids 0. It stands above TAG_BITS in a start."""
    ids = texts.column("doc").to_pylist()
    if len(set(ids)) == len(ids):
        return [0] * len(ids)
    known: dict[int, list[bytes]] = {}
    for doc, text in zip(ids, texts.column("text"), strict=True):
        known.setdefault(doc, []).append(text.as_py())
    order = {doc: {t: i for i, t in enumerate(sorted(set(own)))} for doc, own in known.items() if len(own) > 1}
    return [order[doc][text.as_py()] if doc in order else 0 for doc, text in zip(ids, texts.column("text"), strict=True)]


def _segments(texts: pa.Table, shared: pa.Table, shards: int, length: int) -> pa.Table:
    """Each distinct segment of one group of documents once, with all its documents and starts."""
    release()
    known: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def tokens_of(data: bytes) -> np.ndarray:
        known[data] = anchors(data, length)
        return np.unique(shingles.mix(known[data][0]))

    tokens = group_tokens(texts, tokens_of, by_text=True)[1]
    tokens = tokens[answers_in_order(shared) > 1]  # those that several texts have
    found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    copies = _copies_in(shared)
    for doc, text, tag in zip(texts.column("doc").to_pylist(), texts.column("text"), _tags(texts), strict=True):
        data = text.as_py()
        if _is_copy(copies, doc, data):
            continue
        own, first, last = known[data]
        keep = among(shingles.mix(own), tokens)
        own, first, last = own[keep], first[keep], last[keep]
        for a, f, e in zip(own.tolist(), first.tolist(), last.tolist(), strict=True):
            found.setdefault((a, data[f : e + length]), []).append((doc, tag << TAG_BITS | f))
    keys = sorted(found)
    at = np.array([a for a, _ in keys], np.uint64) % np.uint64(shards)
    order = np.argsort(at, kind="stable")
    out: dict[str, list] = {name: [] for name in ("shard", "bytes", "lengths", "counts", "docs", "starts")}
    for a, b in runs(at[order]):
        own = [keys[i] for i in order[a:b]]
        places = [found[k] for k in own]
        out["shard"].append(int(at[order[a]]))
        out["bytes"].append(b"".join(k[1] for k in own))
        out["lengths"].append(narrow(np.array([len(k[1]) for k in own])))
        out["counts"].append(narrow(np.array([len(p) for p in places])))
        out["docs"].append(np.array([d for p in places for d, _ in p], "<i8").tobytes())
        out["starts"].append(narrow(np.array([s for p in places for _, s in p])))
    return pa.table({name: pa.array(x, pa.int64() if name == "shard" else pa.binary()) for name, x in out.items()})


def smallest_owners(text: np.ndarray, begin: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """For each start of a string in a segment: the first of all segments with an equal string. Segments begin at ``begin``, in any order."""
    index, least = large_array(len(text), np.int32), large_array(len(text), np.int32)
    order = np.argsort(begin)
    for a in range(0, len(begin), STARTS_AT_ONCE):
        own = order[a : a + STARTS_AT_ONCE]
        index[begin[own[0]] : begin[own[-1]] + lengths[own[-1]]] = np.repeat(own, lengths[own])
    for positions, common in sorted_suffixes(text, length):
        own = index[positions]
        held = np.flatnonzero(positions - begin[own] <= lengths[own] - length)  # others run over the end of their segment
        if len(held):
            shared = np.minimum.reduceat(common[: held[-1] + 1], np.append(0, held[:-1] + 1))
            heads = np.flatnonzero(np.append(True, shared[1:] < length))
            low = np.minimum.reduceat(own[held], heads)
            least[positions[held]] = np.repeat(low, np.diff(np.append(heads, len(held))))
    return least


def _packed(docs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: int) -> pa.RecordBatch:
    """Ranges as rows of _RANGES."""
    group = docs % groups
    order = np.argsort(group, kind="stable")
    docs, starts, lengths, group = docs[order], starts[order], lengths[order], group[order]
    spans = runs(group)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([group[a] for a, _ in spans], pa.int64()),
            pa.array([docs[a:b].astype("<i8").tobytes() for a, b in spans], pa.binary()),
            pa.array([narrow(starts[a:b]) for a, b in spans], pa.binary()),
            pa.array([narrow(lengths[a:b]) for a, b in spans], pa.binary()),
        ],
        names=["group", "docs", "starts", "lengths"],
    )


def _decide(batches: Iterator[pa.RecordBatch], groups: int, length: int) -> Iterator[pa.RecordBatch]:
    """The ranges of starts that a smaller document has too, of all segments of one shard."""
    release()
    found: dict[str, list[np.ndarray]] = {"lengths": [], "segments": [], "docs": [], "starts": []}
    known: dict[bytes, int] = {}  # a segment that several groups have is sorted once
    with tempfile.TemporaryFile() as file:
        size = 0
        for batch in batches:
            columns = (batch.column(name) for name in ("bytes", "lengths", "counts", "docs", "starts"))
            for raw, lengths, counts, docs, starts in zip(*columns, strict=True):
                data, lengths = raw.as_buffer().to_pybytes(), wide(lengths.as_py())
                numbers, new = np.empty(len(lengths), np.int64), []
                for i, (a, b) in enumerate(zip((np.cumsum(lengths) - lengths).tolist(), np.cumsum(lengths).tolist(), strict=True)):
                    key = hashlib.blake2b(data[a:b], digest_size=16).digest()
                    if key not in known:
                        known[key] = len(known)
                        new.append(i)
                        size += file.write(data[a:b])
                    numbers[i] = known[key]
                found["lengths"].append(lengths[new])
                found["segments"].append(np.repeat(numbers, wide(counts.as_py())))
                found["docs"].append(np.frombuffer(docs.as_buffer(), "<i8"))
                found["starts"].append(wide(starts.as_py()))
        if not size:
            return
        known.clear()
        file.flush()
        text = np.memmap(file, np.uint8, "r", shape=(size,))
        lengths, segments, docs, starts = (np.concatenate(parts) for parts in found.values())
        found.clear()
        begin = np.cumsum(lengths) - lengths
        # Segments are numbered by their smallest owners, so the first one with a string has its smallest owner.
        owners = np.full(len(lengths), np.iinfo(np.int64).max)
        np.minimum.at(owners, segments, docs)
        rank = np.argsort(owners, kind="stable")
        number = np.empty(len(rank), np.int64)
        number[rank] = np.arange(len(rank))
        place_of = number[segments]
        begin, lengths, owners = begin[rank], lengths[rank], owners[rank]
        least = smallest_owners(text, begin, lengths, length)
        # Each place of a segment has its starts; those with a smaller owner form ranges.
        strings = lengths - length + 1
        ahead = np.cumsum(strings[place_of])
        waiting: list[tuple[np.ndarray, ...]] = []
        a = held = 0
        while a < len(docs):
            b = max(a + 1, int(np.searchsorted(ahead, (ahead[a - 1] if a else 0) + STARTS_AT_ONCE, side="right")))
            s, p = place_of[a:b], np.arange(a, b)
            a = b
            k = strings[s]
            offset = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            drop = owners[least[np.repeat(begin[s], k) + offset]] < np.repeat(docs[p], k)
            edge = np.diff(drop.astype(np.int8), prepend=0)
            edge[offset == 0] = drop[offset == 0]
            begins = np.flatnonzero(edge == 1)
            last = np.append(offset[1:] == 0, True)
            ends = np.flatnonzero(drop & (last | ~np.append(drop[1:], False)))
            row = np.repeat(p, k)[begins]
            waiting.append((docs[row], starts[row] + offset[begins], ends - begins + length))
            held += len(row)
            if held >= RANGES_AT_ONCE or a == len(docs) and held:
                yield _packed(*(np.concatenate(x) for x in zip(*waiting, strict=True)), groups)
                waiting, held = [], 0
    release()


def _cut(texts: pa.Table, ranges: pa.Table, length: int, whole_characters: bool) -> pa.Table:
    """Every document without its ranges; with ``whole_characters`` also without what is left of a cut character."""
    release()
    docs, starts, ends, tags = (np.zeros(0, np.int64),) * 4
    copies = _copies_in(ranges)
    ranges = ranges.filter(ranges.column("docs").is_valid())
    if ranges.num_rows:
        docs = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in ranges.column("docs")])
        starts = np.concatenate([wide(x.as_py()) for x in ranges.column("starts")])
        tags, starts = starts >> TAG_BITS, starts & ((1 << TAG_BITS) - 1)
        ends = starts + np.concatenate([wide(x.as_py()) for x in ranges.column("lengths")])
        order = np.argsort(docs, kind="stable")
        docs, starts, ends, tags = docs[order], starts[order], ends[order], tags[order]
    ids = np.array(texts.column("doc").to_pylist(), np.int64)
    low, high = np.searchsorted(docs, ids), np.searchsorted(docs, ids, side="right")
    out: dict[str, list] = {"kept": [], "n_bytes": [], "n_removed": [], "n_spans": []}
    for doc, text, tag, a, b in zip(ids.tolist(), texts.column("text"), _tags(texts), low, high, strict=True):
        data = text.as_py()
        n = len(data)
        removed = spans = 0
        kept = data
        if _is_copy(copies, doc, data):  # each of its strings is in the earlier copy
            removed, spans, kept = n, 1, b""
        elif a < b:
            m = tags[a:b] == tag
            depth = np.bincount(starts[a:b][m], minlength=n + 1)[: n + 1] - np.bincount(ends[a:b][m], minlength=n + 1)[: n + 1]
            gone = np.cumsum(depth)[:n] > 0
            removed = int(gone.sum())
            spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            if whole_characters:
                kept = kept.decode("utf-8", "ignore").encode()
        for name, x in zip(out, (kept, n, removed, spans), strict=True):
            out[name].append(x)
    carried = {"carried": texts.column("carried")} if "carried" in texts.column_names else {}
    return pa.table({"doc": texts.column("doc")} | {k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()} | carried)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """``id_col``, kept (the remaining bytes), n_bytes, n_removed and n_spans for every row.

    ``carry`` names other columns that come along in a struct ``carried``.
    """
    every = id_rows(docs, id_col, text_col)
    rows = every.where("doc IS NOT NULL")
    buckets, groups = sizes(rows)
    shards = 2 * buckets  # twice as large ones spill too much beside each other
    copies = materialise(_copies(rows, groups, length), "copies")
    schema = _CLEANED
    if carry:
        every = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), F.struct(*carry).alias("carried"))
        rows = every.where("doc IS NOT NULL")
        schema += f", carried {rows.schema['carried'].dataType.simpleString()}"
    dealt = rows.withColumn("group", group_column(F.col("doc"), groups))
    shared = count_tokens(dealt, _tokens, buckets, by_text=True).unionByName(copies, allowMissingColumns=True)
    texts = dealt.groupBy("group")
    segments = texts.cogroup(shared.groupBy("group")).applyInArrow(lambda t, s: _segments(t, s, shards, length), _SEGMENTS)
    ranges = segments.repartition(shards, "shard").mapInArrow(lambda batches: _decide(batches, groups, length), _RANGES)
    ranges = ranges.unionByName(copies, allowMissingColumns=True)
    cleaned = texts.cogroup(ranges.groupBy("group")).applyInArrow(lambda t, r: _cut(t, r, length, whole_characters), schema)
    without_id = every.where("doc IS NULL").select("doc", F.col("text").alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), *[F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans")], *(["carried"] if carry else []))
    return cleaned.unionByName(without_id).withColumnRenamed("doc", id_col)


def digest(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return cleaned.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
