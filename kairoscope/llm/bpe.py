"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a pre-token has one last token in its BPE encoding. A suffix automaton over the
vocabulary gives, at each position, the tokens that end there, the longest first; the first whose
predecessor (the last token of the shorter prefix) would not have merged across the joint is the
last token. Following these back-pointers from the end gives exactly the ids that merging in rank
order gives, in time linear in the text.

The distinct segments of a batch of texts are encoded together: one step of the automaton, the
pair tests and the back-pointers moves all of them on by one byte. A pre-token of more than
``LONG`` bytes takes the same steps alone.

Null texts count as empty and give no ids. Rows with a null id, repeated ids and repeated texts
each keep their row. An empty table gives an empty result. A text of any length is encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.postings import release, runs

#: Distinct segments that a worker remembers, and slots for pairs of tokens whose test is known.
MEMO_ENTRIES, PAIR_SLOTS = 60_000, 1 << 19
#: Texts are encoded in batches of about so many bytes, and rows.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1_000
#: Bytes beyond which a pre-token is not encoded beside others, and pre-tokens that are encoded side by side.
LONG, ABREAST = 512, 1 << 15
_NEVER = np.int64(1 << 60)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count of them, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class SuffixAutomaton:
    """After any bytes: the longest token that they end with (``longest`` of a state), and of a token the next shorter one (``shorter``).

    States are the prefixes of tokens. The longer prefixes that a symbol leads to are in one open hash table; where a
    state has none, that of its longest proper suffix counts (``fail``).
    """

    def __init__(self, tokens: list[bytes], ids: list[int], size: int):
        order = sorted(range(len(tokens)), key=lambda i: tokens[i])
        tokens, own = [tokens[i] for i in order], np.array(ids, np.int64)[order]
        flat, n = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
        start = np.cumsum(n) - n
        state, levels, count = np.zeros(len(tokens), np.int64), [], 1
        for depth in range(int(n.max())):  # one level of the trie at a time
            live = np.flatnonzero(n > depth)
            edges, at = np.unique(state[live] << 8 | flat[start[live] + depth], return_inverse=True)
            state[live] = count + at
            levels.append(edges)
            count += len(edges)
        every = np.concatenate(levels)
        self.slots = 1 << int(4 * len(every)).bit_length()
        self.keys, self.to = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32)
        slot, waiting = self._slot(every), np.arange(len(every))
        while len(waiting):
            free = self.keys[slot[waiting]] < 0
            self.keys[slot[waiting[free]]] = every[waiting[free]]
            placed = self.keys[slot[waiting]] == every[waiting]
            self.to[slot[waiting[placed]]] = waiting[placed] + 1
            waiting = waiting[~placed]
            slot[waiting] = (slot[waiting] + 1) % self.slots
        longest, self.fail = np.full(count, -1, np.int64), np.zeros(count, np.int32)
        longest[state] = own
        self.shorter = np.full(size, -1, np.int32)
        begin = 1
        for depth, edges in enumerate(levels):
            here = np.arange(begin, begin + len(edges))
            if depth:
                self.fail[here] = self.step(self.fail[edges >> 8], edges & 255)
            whole = longest[here] >= 0
            below = longest[self.fail[here]]
            self.shorter[longest[here[whole]]] = below[whole]
            longest[here] = np.where(whole, longest[here], below)
            begin += len(edges)
        self.longest = longest.astype(np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.int64(0x9E3779B1) >> 7) % self.slots

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states that symbols lead to."""
        out, live = np.zeros(len(state), np.int32), np.arange(len(state))
        key = state.astype(np.int64) << 8 | symbol
        slot = self._slot(key)
        while len(live):
            have = self.keys[slot]
            hit = have == key
            out[live[hit]] = self.to[slot[hit]]
            rest = ~hit & ((have >= 0) | (key > 255))  # at the root, a symbol that leads nowhere stays there
            live, key, slot, empty = live[rest], key[rest], slot[rest], have[rest] < 0
            key = np.where(empty, self.fail[key >> 8].astype(np.int64) << 8 | key & 255, key)
            slot = np.where(empty, self._slot(key), (slot + 1) % self.slots)
        return out


class PairTest:
    """Whether two tokens, one after the other, stay apart."""

    def __init__(self, merges: list[tuple[int, int, int]], size: int):
        """merges: left, right and merged token, in order of rank."""
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        left, right, whole = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        for n in range(len(merges) - 1, -1, -1):  # of several merges to one token, the first counts
            self.rank[whole[n]], self.left[whole[n]], self.right[whole[n]] = n, left[n], right[n]
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.known, self.verdict = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Undoes the merges of both sides, the newest first; no merge across the joint may come before ``limit``."""
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            key = a << 20 | b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            joined = (self.keys[at] == key) & (self.ranks[at] < limit)
            rank_a, rank_b = self.rank[a], self.rank[b]
            from_a = rank_a > rank_b
            done = ~from_a & (rank_b < 0)
            out[live[done & ~joined]] = True
            go = ~(joined | done)
            live, a, b, from_a, rank_a, rank_b = live[go], a[go], b[go], from_a[go], rank_a[go], rank_b[go]
            limit = np.where(from_a, rank_a, rank_b + 1)  # of equal merges, the left one comes first
            a, b = np.where(from_a, self.right[a], a), np.where(from_a, b, self.left[b])
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """apart() without a limit, remembered."""
        key = a.astype(np.int64) << 20 | b
        slot = (key * np.int64(0x9E3779B1) >> 13) & (PAIR_SLOTS - 1)
        out = self.verdict[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            keys, at = np.unique(key[new], return_inverse=True)
            found = self.apart(keys >> 20, keys & 0xFFFFF, np.full(len(keys), _NEVER))
            out[new] = found[at]
            slots = (keys * np.int64(0x9E3779B1) >> 13) & (PAIR_SLOTS - 1)
            self.known[slots] = keys
            self.verdict[slots] = found  # of two keys for one slot, the last one wins in both
        return out


class _Places(dict):
    """The number of each segment; a new one is noted in ``fresh``."""

    def __init__(self, model: PrefixEncoder, before: str):
        super().__init__()
        self.model, self.before = model, before

    def __missing__(self, word: str) -> int:
        model = self.model
        place = self[word] = len(model.begin) + len(model.fresh)
        model.fresh.append(self.before + word)
        return place


class PrefixEncoder:
    """Encodes and decodes with the vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        to_byte = {c: b for b, c in byte_alphabet().items()}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.gap = regex.compile(r" (?=\S)")
        self.blank = re.compile(r" (?:\s|$)|^\s")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        text = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                text[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            text[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.pairs = PairTest([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], size)
        # A token that merging never produces from its own bytes can be no part of an encoding.
        ids = np.array(sorted(i for t, i in vocab.items() if t not in self.special), np.int64)
        rank = self.pairs.rank[ids]
        merged = rank >= 0
        whole = ~merged & np.array([len(text[i]) == 1 for i in ids])
        whole[merged] = self.pairs.apart(self.pairs.left[ids[merged]], self.pairs.right[ids[merged]], rank[merged])
        ids = ids[whole].tolist()
        if len({text[i] for i in ids if len(text[i]) == 1}) < 256:
            raise ValueError("the vocabulary lacks a byte")
        self.automaton = SuffixAutomaton([text[i] for i in ids], ids, size)
        self.length = np.array([len(t) for t in text], np.int64)
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.byte_start = np.cumsum(self.length) - self.length
        self.forget()

    def forget(self) -> None:
        """Empties the memo; the worker may have other work next."""
        self.fresh: list[str] = []
        self.edges: dict[int, int] = {}
        self.words, self.heads = _Places(self, " "), _Places(self, "")
        self.ids, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _last_tokens(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The last token of every prefix of every piece, the longest piece first; a piece of n bytes has n + 1 places, its first holds -1."""
        auto, length, pairs = self.automaton, self.length, self.pairs
        last = np.full(int(size.sum()) + len(size), -1, np.int32)
        first = np.cumsum(size + 1) - (size + 1)
        state = np.zeros(len(size), np.int32)
        more = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for i, k in enumerate(more):
            state[:k] = auto.step(state[:k], data[begin[:k] + i])
            token, end = auto.longest[state[:k]], first[:k] + i + 1
            while len(token):
                before = last[end - length[token]]
                fits = before < 0
                inside = np.flatnonzero(~fits)
                fits[inside] = pairs(before[inside], token[inside])
                last[end[fits]] = token[fits]
                rest = ~fits
                token, end = auto.shorter[token[rest]], end[rest]
        return last

    def _last_tokens_alone(self, data: np.ndarray) -> np.ndarray:
        """The same for one long piece."""
        auto, length, pairs = self.automaton, self.length.tolist(), {}
        if not self.edges:
            used = auto.keys >= 0
            self.edges = dict(zip(auto.keys[used].tolist(), auto.to[used].tolist(), strict=True))
        edges, last, state = self.edges, [-1] * (len(data) + 1), 0
        for end, symbol in enumerate(data.tolist(), 1):
            while (to := edges.get(state << 8 | symbol)) is None and state:
                state = int(auto.fail[state])
            state = to or 0
            token = int(auto.longest[state])
            while (before := last[end - length[token]]) >= 0:
                fits = pairs.get((before, token))
                if fits is None:
                    fits = pairs[before, token] = bool(self.pairs(np.array([before]), np.array([token]))[0])
                if fits:
                    break
                token = int(auto.shorter[token])
            last[end] = token
        return np.array(last, np.int32)

    def _followed(self, last: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back-pointers from the end of every piece: all ids in order, and how many each piece has."""
        first = np.cumsum(size + 1) - (size + 1)
        left, live = size.copy(), np.flatnonzero(size)
        count, found = np.zeros(len(size), np.int64), []
        while len(live):
            token = last[first[live] + left[live]]
            found.append((live, token))
            left[live] -= self.length[token]
            count[live] += 1
            live = live[left[live] > 0]
        ids, end = np.empty(int(count.sum()), np.int32), np.cumsum(count)
        for back, (live, token) in enumerate(found, 1):
            ids[end[live] - back] = token
        return ids, count

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens one after the other, and how many each has."""
        data, size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64)
        begin = np.cumsum(size) - size
        count, parts = np.zeros(len(size), np.int64), []
        order = np.argsort(-size, kind="stable")
        long = int(np.searchsorted(-size[order], -LONG, side="left"))
        groups = [order[i : i + 1] for i in range(long)] + [order[i : i + ABREAST] for i in range(long, len(order), ABREAST)]
        for at in groups:
            alone = len(at) == 1 and size[at[0]] > LONG
            last = self._last_tokens_alone(data[begin[at[0]] : begin[at[0]] + size[at[0]]]) if alone else self._last_tokens(data, begin[at], size[at])
            ids, count[at] = self._followed(last, size[at])
            parts.append(ids)
        end = np.cumsum(count)
        out = np.empty(int(count.sum()), np.int32)
        for at, ids in zip(groups, parts, strict=True):
            out[spread(end[at] - count[at], count[at])] = ids
        return out, count

    def _learn(self) -> None:
        """Encodes the new segments and adds them to the memo."""
        pieces, per = [], []
        for segment in self.fresh:
            own = [segment] if segment[:1] == " " and segment[1:].isalpha() else self.pattern.findall(segment)
            pieces += own
            per.append(len(own))
        ids, count = self.encode_pieces([p.encode() for p in pieces])
        total = np.append(0, np.cumsum(count))
        ends = np.cumsum(np.array(per, np.int64))
        count = total[ends] - total[ends - per] if per else count
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.ids = np.append(self.ids, ids)
        self.fresh = []

    def _plain(self, text: str) -> list[int]:
        """A space before a visible character always starts a pre-token, so what lies between is a segment of its own."""
        parts = self.gap.split(text) if self.blank.search(text) else text.split(" ")
        return [self.heads[parts[0]], *map(self.words.__getitem__, parts[1:])] if text else []

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of each text's."""
        if len(self.begin) > MEMO_ENTRIES:
            self.forget()
        places, sizes = [], []
        for text in texts:
            if self.special_pattern is None or not any(t in text for t in self.special):
                own = self._plain(text)
            else:
                own = []
                for part in self.special_pattern.split(text):
                    own += [-1 - self.special[part]] if part in self.special else self._plain(part)
            places.append(np.array(own, np.int64))
            sizes.append(len(own))
        self._learn()
        at = np.concatenate([np.zeros(0, np.int64), *places])
        special = at < 0
        own = np.maximum(at, 0)
        count = np.where(special, 1, np.append(self.count, 1)[own])
        pool = np.append(self.ids, np.arange(len(self.length), dtype=np.int32))  # special tokens stand for themselves
        ids = pool[spread(np.where(special, len(self.ids) - 1 - at, np.append(self.begin, 0)[own]), count)]
        total = np.append(0, np.cumsum(count))
        ends = np.cumsum(sizes)
        return ids, total[ends] - total[ends - sizes]

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        length = self.length[ids]
        raw = self.bytes[spread(self.byte_start[ids], length)].tobytes()
        ends = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(counts))].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The encoder of a file, built once in each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of texts that begin in the same stretch of BATCH_BYTES, and of at most BATCH_ROWS."""
    begin = np.cumsum(sizes) - sizes
    for a, b in runs(begin // BATCH_BYTES):
        yield from ((i, min(b, i + BATCH_ROWS)) for i in range(a, b, BATCH_ROWS))


def encode_decode(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """``id_col``, ids array<int> and decoded string for every row of ``df``."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            for a, b in _parts(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)):
                ids, counts = model.encode_batch(batch.column(1).slice(a, b - a).to_pylist())
                ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(model.decode_batch(ids, counts), pa.string())], names=["id", "ids", "decoded"])
        model.forget()
        release()

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"id {id_type}, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), "ids", "decoded")


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of encode_decode()'s rows."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
