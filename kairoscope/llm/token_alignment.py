"""Alignment of the tokens of two tokenizers, and how often their ids are linked in the corpus.

A is a byte-level BPE of a space and the text, B a sentencepiece model, which adds that space itself.
Both cover the same bytes, so a token is a byte range. The ranges of B are a static interval index
(their sorted begins and ends); a bisection of each A token's two ends finds the B tokens that it
overlaps. A gap between two B tokens that no A token spans is where tokens of both end: it closes a
group. All A and B tokens of a group are linked.

Texts are taken in chunks of a task. A chunk sends each distinct id pair of its texts once, with the
number of its rows that hold it, to the bucket of the pair's A id; chunks of one shard are added up
first, then the shards of a bucket, which so holds all pairs of an A id and tells its most frequent.
The sums go back the same way. A pair that every text has reaches its bucket once a shard; the cells
of a bucket are bounded by its pairs (of the two vocabularies), not by texts. A text's links are kept
as places in the list of its chunk.

Null and empty texts, and those whose tokens do not spell them (B knows no byte that its normaliser
changes), have no tokens: zeros and an empty digest. Rows that repeat an id or have none are documents
of their own. A text of any length is aligned whole, with memory in proportion to its tokens; of a
group of more than ``WIDE`` pairs only distinct ids are paired. An empty table gives an empty result;
other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.bpe import PrefixEncoder, byte_alphabet, spread
from kairoscope.llm.postings import from_bytes, from_steps, id_rows, release, runs, steps, to_bytes
from kairoscope.llm.shingles import mix
from kairoscope.session import materialise

#: Bytes of text, and rows, of a chunk; bytes of text that are aligned together.
CHUNK_BYTES, CHUNK_ROWS, PART_BYTES = 12 << 20, 50_000, 1 << 20
#: Bytes of text for each bucket of pairs, and chunks for each shard.
BUCKET_BYTES, SHARD_CHUNKS = 16 << 20, 64
#: Pairs of tokens of one group from which its ids are made distinct first, and bytes from which a text has the encoder whose patterns need no stack.
WIDE, LONG = 4096, 1 << 20
_SPACE = "▁"
_ALIGNED = "chunk long, doc long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, bucket long, shard long, pairs binary, n binary"
_MERGED = "bucket long, shard long, pairs binary, n binary"
_SUMS = "bucket long, shard long, n binary, best binary"
_ANSWERS = "chunk long, bucket long, n binary, best binary"
_RESULT = "doc long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class TwoTokenizers:
    """Ids and bytes of the tokens of both."""

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_alphabet().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.path_a, self.slow = path_a, None
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = token
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" ")).translate({ord(c): chr(b) for c, b in to_byte.items()}).encode("latin-1")] for m in spec["model"]["merges"]]
        # Where ids are in the order of merges, they are the ranks of an encoder that joins by rank.
        ranked = all(a < b for a, b in zip(merged, merged[1:], strict=False))
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={}) if ranked else None
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        model = self.model_b
        self.bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]
        self.length_a, self.length_b = (np.array([len(t) for t in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.shift = (len(self.bytes_b) - 1).bit_length()
        # The digits of an id and what follows it: a comma, or at the end of its side of a group the mark of that.
        self.shown = [b"%d%s" % (i, mark) for own, end in ((self.bytes_a, b"|"), (self.bytes_b, b";")) for i in range(len(own)) for mark in (b",", end)]

    def encode_a(self, text: str) -> list[int]:
        if self.fast and len(text) < LONG:
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            self.slow = PrefixEncoder(self.path_a)
            self.slow.special_pattern = None  # special tokens are plain text
        ids = self.slow.encode_batch([text])[0].tolist()
        self.slow.forget()
        return ids

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none where either does not spell the space and the text."""
        if text:
            a, b = self.encode_a(" " + text), self.model_b.encode(text, num_threads=1)
            whole = (" " + text).encode()
            if b"".join(map(self.bytes_b.__getitem__, b)) == whole and b"".join(map(self.bytes_a.__getitem__, a)) == whole:
                return np.array(a, np.int32), np.array(b, np.int32)
        return (np.zeros(0, np.int32),) * 2


_LOADED: dict[tuple[str, str], TwoTokenizers] = {}


def tokenizers_of(path_a: str, path_b: str) -> TwoTokenizers:
    """Built once in each worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = TwoTokenizers(path_a, path_b)
    return _LOADED[path_a, path_b]


def align(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token, from their bytes; both cover the same bytes from the same begin."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    # The index: begins and ends of B, both sorted. Each A token stabs it with its two ends.
    first = np.searchsorted(end_b, end_a - length_a, side="right")
    last = np.searchsorted(end_b - length_b, end_a, side="left") - 1
    over = first < last
    spanned = np.cumsum(np.bincount(first[over], minlength=len(end_b)) - np.bincount(last[over], minlength=len(end_b)))
    group_b = np.cumsum(np.append(0, spanned[:-1] == 0)) if len(end_b) else np.zeros(0, np.int64)
    return group_b[first], group_b


@dataclass
class Aligned:
    """What texts give: counts and digests, and of all their links the distinct pairs of each text (text, pair, times)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def align_texts(model: TwoTokenizers, texts: list[str]) -> Aligned:
    ids = [model.encode(t) for t in texts]
    n_a, n_b = (np.array([len(x[side]) for x in ids], np.int64) for side in (0, 1))
    a, b = (np.concatenate([np.zeros(0, np.int32), *[x[side] for x in ids]]).astype(np.int64) for side in (0, 1))
    group_a, group_b = align(model.length_a[a], model.length_b[b])
    groups = int(group_b[-1]) + 1 if len(b) else 0
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    before = np.append(group_b, groups)[end_b - n_b]  # groups before each text
    n_groups = np.append(before[1:], groups) - before
    links = np.append(0, np.cumsum(in_a * in_b))
    n_links = links[before + n_groups] - links[before]
    # Text of all groups: behind the A tokens of a group come its B tokens.
    shown = np.empty(len(a) + len(b), np.int64)
    shown[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = 2 * a + np.append(np.diff(group_a) != 0, True)[: len(a)]
    shown[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * (len(model.bytes_a) + b) + np.append(np.diff(group_b) != 0, True)[: len(b)]
    digests = []
    for i, j in zip((end_a - n_a + end_b - n_b).tolist(), (end_a + end_b).tolist(), strict=True):
        digests.append(hashlib.sha256(b"".join(map(model.shown.__getitem__, shown[i:j].tolist()))[:-1]).hexdigest() if i < j else "")
    text_of = np.repeat(np.arange(len(texts)), n_groups)
    wide = in_a * in_b > WIDE
    plain = ~wide[group_a]
    count = in_b[group_a[plain]]
    left, right = np.repeat(a[plain], count), b[spread((np.cumsum(in_b) - in_b)[group_a[plain]], count)]
    found = [(np.repeat(text_of[group_a[plain]], count), left << model.shift | right, np.ones(len(left), np.int64))]
    for g in np.flatnonzero(wide).tolist():
        x, y = (np.unique(own[np.searchsorted(group, g) : np.searchsorted(group, g, side="right")], return_counts=True) for own, group in ((a, group_a), (b, group_b)))
        for i in range(0, len(x[0]), max(1, (1 << 20) // len(y[0]))):
            part = slice(i, i + max(1, (1 << 20) // len(y[0])))
            pair = (x[0][part, None] << model.shift | y[0]).ravel()
            found.append((np.full(len(pair), text_of[g]), pair, (x[1][part, None] * y[1]).ravel()))
    text, pair, times = (np.concatenate(x) for x in zip(*found, strict=True))
    key = text << 40 | pair
    if len(found) == 1:
        key, times = np.unique(key, return_counts=True)
    else:
        key, at = np.unique(key, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, times)
        times = total
    return Aligned(n_a, n_b, n_groups, n_links, digests, key >> 40, key & ((1 << 40) - 1), times)


@dataclass
class _Chunk:
    """Rows of a task that share a list of pairs; equal texts are aligned once."""

    known: dict[str, int] = field(default_factory=dict)
    rows: list[tuple[int | None, int]] = field(default_factory=list)
    size: int = 0

    def add(self, doc: int | None, data: bytes) -> bool:
        """Whether the chunk is full."""
        text = data.decode("utf-8", "replace")
        if text not in self.known:
            self.known[text] = len(self.known)
            self.size += len(data)
        self.rows.append((doc, self.known[text]))
        return self.size >= CHUNK_BYTES or len(self.rows) >= CHUNK_ROWS

    def flush(self, model: TwoTokenizers, number: int, buckets: int, shards: int) -> Iterator[pa.RecordBatch]:
        texts = list(self.known)
        sizes = np.array([len(t) for t in texts])
        parts = [align_texts(model, texts[i:j]) for i, j in runs((np.cumsum(sizes) - sizes) // PART_BYTES)]
        joined = {name: np.concatenate([getattr(p, name) for p in parts]) for name in ("n_a", "n_b", "n_groups", "n_links", "pair", "times")}
        digests = [d for p in parts for d in p.digests]
        held = np.concatenate([np.bincount(p.text, minlength=len(p.n_a)) for p in parts])  # distinct pairs of each text
        own = np.array([t for _, t in self.rows])
        copies = np.bincount(own, minlength=len(texts))
        # All pairs of an A id are of one bucket, and a bucket's are side by side.
        pairs, at = np.unique(joined["pair"], return_inverse=True)
        rows_with = np.bincount(at, np.repeat(copies, held), minlength=len(pairs)).astype(np.int64)
        bucket = bucket_of(pairs, model.shift, buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, ends = place[at], np.cumsum(held)
        shard = number % shards
        packed = [(to_places(at[e - h : e], joined["times"][e - h : e])) for e, h in zip(ends.tolist(), held.tolist(), strict=True)]
        for i in range(0, len(own), 2_000):
            t = own[i : i + 2_000]
            mine = [packed[k] for k in t.tolist()]
            yield _batch(_ALIGNED, len(t), chunk=[number] * len(t), doc=[d for d, _ in self.rows[i : i + 2_000]], groups_sha256=[digests[k] for k in t.tolist()], places=[p for p, _ in mine], times=[n for _, n in mine], **{name: joined[name][t] for name in ("n_a", "n_b", "n_groups", "n_links")})
        spans = runs(bucket[order])
        pairs, rows_with, bucket = pairs[order], rows_with[order], bucket[order]
        yield _batch(_ALIGNED, len(spans), chunk=[number] * len(spans), bucket=[int(bucket[i]) for i, _ in spans], shard=[shard] * len(spans), pairs=[steps(pairs[i:j].astype(np.uint64)) for i, j in spans], n=[to_bytes(rows_with[i:j]) for i, j in spans])


def _batch(schema: str, rows: int, **columns: object) -> pa.RecordBatch:
    """Columns of a schema; those that are not given are null."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(rows, kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def bucket_of(pairs: np.ndarray, shift: int, buckets: int) -> np.ndarray:
    """The bucket of each pair, by its A id."""
    return (mix((pairs >> shift).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def to_places(places: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    order = np.argsort(places)
    return steps(places[order].astype(np.uint64)), to_bytes(times[order])


def _merge(sent: pa.Table) -> pa.Table:
    """The sums of the chunks of one shard, for one bucket."""
    release()
    pairs, at = np.unique(np.concatenate([from_steps(x.as_py()) for x in sent.column("pairs")]), return_inverse=True)
    n = np.bincount(at, np.concatenate([from_bytes(x.as_py()) for x in sent.column("n")])).astype(np.int64)
    return pa.Table.from_batches([_batch(_MERGED, 1, bucket=[sent.column("bucket")[0].as_py()], shard=[sent.column("shard")[0].as_py()], pairs=[steps(pairs)], n=[to_bytes(n)])])


def _total(merged: pa.Table, shift: int) -> pa.Table:
    """For the pairs of each shard of one bucket: in how many rows of the corpus they are, and whether no pair of their A id is in more."""
    release()
    blocks = [from_steps(x.as_py()) for x in merged.column("pairs")]
    pairs, at = np.unique(np.concatenate(blocks), return_inverse=True)
    n = np.bincount(at, np.concatenate([from_bytes(x.as_py()) for x in merged.column("n")])).astype(np.int64)
    starts = np.flatnonzero(np.append(True, np.diff((pairs >> np.uint64(shift)).astype(np.int64)) != 0))
    best = n == np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(n))))
    cuts = np.cumsum([0, *(len(b) for b in blocks)])
    spans = [at[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
    return pa.Table.from_batches([_batch(_SUMS, len(spans), bucket=merged.column("bucket").to_pylist(), shard=merged.column("shard").to_pylist(), n=[to_bytes(n[s]) for s in spans], best=[np.packbits(best[s]).tobytes() for s in spans])])


def _answer(sent: pa.Table, sums: pa.Table) -> pa.Table:
    """What _total() says to each chunk of a shard, in the order of its own pairs."""
    release()
    blocks = [from_steps(x.as_py()) for x in sent.column("pairs")]
    if not blocks:
        return pa.Table.from_batches([_batch(_ANSWERS, 0)])
    pairs, at = np.unique(np.concatenate(blocks), return_inverse=True)
    n = from_bytes(sums.column("n")[0].as_py())
    best = np.unpackbits(np.frombuffer(sums.column("best")[0].as_py(), np.uint8), count=len(pairs))
    cuts = np.cumsum([0, *(len(b) for b in blocks)])
    spans = [at[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
    return pa.Table.from_batches([_batch(_ANSWERS, len(spans), chunk=sent.column("chunk").to_pylist(), bucket=sent.column("bucket").to_pylist(), n=[to_bytes(n[s]) for s in spans], best=[np.packbits(best[s]).tobytes() for s in spans])])


def _finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The rows of a chunk with the sums over their links."""
    release()
    answers = answers.sort_by("bucket")
    counts = [from_bytes(x.as_py()).astype(np.int64) for x in answers.column("n")]
    best = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(c)).astype(np.int64) for x, c in zip(answers.column("best"), counts, strict=True)]
    count, is_best = np.concatenate([np.zeros(0, np.int64), *counts]), np.concatenate([np.zeros(0, np.int64), *best])
    total, n_best = [], []
    for places, times in zip(docs.column("places"), docs.column("times"), strict=True):
        at, n = from_steps(places.as_py()).astype(np.int64), from_bytes(times.as_py()).astype(np.int64)
        total.append(int(count[at] @ n))
        n_best.append(int(is_best[at] @ n))
    same = {name: docs.column(name).combine_chunks() for name in ("doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    return pa.table(same | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}).select([f.split()[0] for f in _RESULT.split(", ")])


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row."""
    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    rows = id_rows(docs, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, shards = max(4, -(-size // BUCKET_BYTES)), max(1, -(-size // (CHUNK_BYTES * SHARD_CHUNKS)))
    shift = (sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size() - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, chunk, number = tokenizers_of(path_a, path_b), _Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk.add(doc, text.as_py()):
                    yield from chunk.flush(model, number, buckets, shards)
                    chunk, number = _Chunk(), number + 1
        if chunk.rows:
            yield from chunk.flush(model, number, buckets, shards)
        release()

    aligned = materialise(rows.mapInArrow(run, _ALIGNED), "aligned")
    sent = aligned.where("bucket IS NOT NULL").select("chunk", "bucket", "shard", "pairs", "n")
    merged = sent.groupBy("bucket", "shard").applyInArrow(_merge, _MERGED)
    sums = merged.groupBy("bucket").applyInArrow(lambda t: _total(t, shift), _SUMS)
    answers = sent.groupBy("bucket", "shard").cogroup(sums.groupBy("bucket", "shard")).applyInArrow(_answer, _ANSWERS)
    own = aligned.where("bucket IS NULL").select("chunk", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_finish, _RESULT).withColumnRenamed("doc", id_col)
