"""Exact Jaccard join on word shingles by token-combination prefixes.

Tokens are the shingles. All tokens are counted, and every document orders its own by document
frequency, rare ones first. For each class of partner sizes, a document of n tokens may lack at most
t of them in a partner (from the least overlap that 0.75 asks of the two sizes), so of a prefix that
survives the loss of any t tokens something is shared: tokens of the rare class count singly,
tokens of a frequent class of order k in groups, of which any k make a combination, so m of them
survive m - k losses. The prefix is extended until that exceeds t, and indexed, under both size
classes, by its rare tokens and its combinations. Documents that share an index entry are compared
by their whole sets.

A token that no other document has can only be lost. Documents with more than t of these have no
partner, which settles most documents with neither their text nor their prefix leaving the task.

Equal sets become one representative before tokens are exchanged. Documents that share an entry are
compared by set_links.entry_links(), which loses no link between different texts and for which a large
group costs a star.

Tokens keep 48 bits of their hash: two unequal ones of one pair of documents agree with a
probability below 1e-8.

Null, empty and wordless texts have no tokens and no links. Rows without an id link with nothing and
have a null component. Rows that repeat an id link each by its own text. Texts of any length are
compared whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.llm.components import connected_components
from kairoscope.llm.joins import release_shuffles, salted_join
from kairoscope.llm.postings import answers_in_order, count_tokens, group_column, group_tokens, id_rows, release, sizes
from kairoscope.llm.set_links import entry_links
from kairoscope.llm.shingles import mix, shingle_set
from kairoscope.session import materialise

#: Per cent of the union that the intersection has to reach.
PERCENT = 75
#: Document frequencies from which two and three tokens make an index entry, where both documents have at least so many tokens.
PAIRS_FROM, TRIPLES_FROM, COMBINED_FROM = 16, 1024, 32


def set_digest(tokens: np.ndarray) -> bytes | None:
    """Of sorted distinct tokens; None where there are none."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def token_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, n, sig (digest of the set, null for an empty one) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary())], names=["doc", "n", "sig"])

    return id_rows(docs, id_col, text_col).mapInArrow(run, "doc long, n long, sig binary")


#: First sizes of the size classes, each about a tenth larger than the one before.
_STARTS = [1]


def class_start(number: int) -> int:
    while len(_STARTS) <= number:
        _STARTS.append(max(_STARTS[-1] + 1, _STARTS[-1] * 11 // 10))
    return _STARTS[number]


def size_class(n: int) -> int:
    while _STARTS[-1] <= n:
        class_start(len(_STARTS))
    return bisect_right(_STARTS, n) - 1


def signatures(n: int, tokens: np.ndarray, often: np.ndarray, percent: int = PERCENT) -> np.ndarray | None:
    """Index entries of a set of n tokens, of which ``tokens`` are shared; None where no partner can exist.

    ``tokens`` are in no order; ``often`` are their document frequencies.
    """
    alone = n - len(tokens)
    order = np.lexsort((tokens, often))
    tokens, often = tokens[order], often[order]
    smallest, largest = -(-percent * n // 100), 100 * n // percent
    own_class = size_class(n)
    found = []
    for other in range(size_class(smallest), size_class(largest) + 1):
        least = max(smallest, class_start(other))
        lost = n - -(-percent * (n + least) // (100 + percent))  # what n may lack in the smallest partner of this class
        if alone > lost:
            continue
        need = lost + 1 - alone
        pair = min(own_class, other) << 16 | max(own_class, other)
        base = class_start(min(own_class, other))
        groups = max(1, base // 16)
        order_of = np.ones(len(tokens), np.int64)
        if base >= COMBINED_FROM:
            order_of += (often >= PAIRS_FROM).astype(np.int64) + (often >= TRIPLES_FROM)
        kind = np.where(order_of > 1, order_of * groups + tokens % groups, 0)
        by_kind = np.argsort(kind, kind="stable")
        first = np.flatnonzero(np.diff(kind[by_kind], prepend=-1))
        rank = np.empty(len(tokens), np.int64)
        rank[by_kind] = np.arange(len(tokens)) - np.repeat(first, np.diff(np.append(first, len(tokens))))
        survives = (order_of == 1) | (rank >= order_of - 1)
        total = np.cumsum(survives)
        if total[-1] < need:
            raise ValueError("a prefix cannot be extended far enough")
        end = int(np.searchsorted(total, need)) + 1
        mark = np.uint64((pair + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        own = tokens[:end].astype(np.uint64)
        found.append(mix(own[order_of[:end] == 1] ^ mark))
        members: dict[int, list[int]] = {}
        for k, t, o in zip(kind[:end].tolist(), own.tolist(), order_of[:end].tolist(), strict=True):
            if o > 1:
                members.setdefault(k, [o]).append(t)
        sets = [(k, c) for k, m in members.items() for c in combinations(sorted(m[1:]), m[0])]
        for size in (2, 3):
            if some := [(k, *c) for k, c in sets if len(c) == size]:
                block = np.array(some, np.uint64)
                h = np.full(len(block), mark + np.uint64(size))
                for i in range(size + 1):
                    h = mix(h * np.uint64(0x100000001B3) + block[:, i])
                found.append(h)
    return np.unique(np.concatenate(found)) if found else None


def _candidates(dealt: DataFrame, counted: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """doc, n, tokens, entries of every representative (group, sig, node) that may have a partner; doc is its node."""

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        release()
        out: dict[str, list] = {"doc": [], "n": [], "tokens": [], "entries": []}
        nodes = {s: n for s, n in zip(known.column("sig").to_pylist(), known.column("node").to_pylist(), strict=True) if s is not None}
        sets, every, _ = group_tokens(texts, shingle_set)
        often = answers_in_order(known)
        for own in sets.values():
            node = nodes.pop(set_digest(own), None)
            if node is not None:
                df = often[np.searchsorted(every, own)]
                tokens, df = (own[df > 1] >> np.uint64(16)).astype(np.int64), df[df > 1]
                entries = signatures(len(own), tokens, df, percent)
                if entries is not None:
                    for name, x in zip(out, (node, len(own), tokens, entries.astype(np.int64)), strict=True):
                        out[name].append(x)
        return pa.table({"doc": pa.array(out["doc"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "tokens": pa.array(out["tokens"], pa.list_(pa.int64())), "entries": pa.array(out["entries"], pa.list_(pa.int64()))})

    known = counted.unionByName(heads.select("group", "sig", "node"), allowMissingColumns=True)
    return dealt.groupBy("group").cogroup(known.groupBy("group")).applyInArrow(run, "doc long, n long, tokens array<long>, entries array<long>")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership (doc, n, node), nodes (node, head: the smallest id with its set) and links (a, b) between nodes that connect all that is linked.

    A node is a distinct set; its number is its head's id or, where an id heads several sets, a hash of the set.
    """
    rows = id_rows(docs, id_col, text_col).where("doc IS NOT NULL")
    buckets, groups = sizes(rows)
    sets = materialise(token_sets(docs, id_col, text_col), "sets")  # 40 bytes a row
    heads = sets.where("sig IS NOT NULL AND doc IS NOT NULL").groupBy("sig").agg(F.min("doc").alias("head"), F.count("*").alias("copies"))
    several = F.count("*").over(Window.partitionBy("head")) > 1
    heads = materialise(heads.withColumn("node", F.when(several, F.xxhash64("sig")).otherwise(F.col("head"))), "heads")
    own = F.when(F.col("doc").isNotNull(), F.coalesce("node", "doc"))  # without an id, no component
    known = heads.where("copies > 1 OR node <> head").select("sig", "node", "head")  # any other row is its own head
    members = materialise(salted_join(sets, known, "sig", F.col("doc")).select("doc", "n", own.alias("node"), F.coalesce("head", "doc").alias("head")), "members")
    group = group_column(F.col("head"), groups)
    dealt = rows.withColumn("group", group_column(F.col("doc"), groups))
    counted = count_tokens(dealt, shingle_set, buckets)
    found = materialise(_candidates(dealt, counted, heads.withColumn("group", group), percent), "candidates")
    release_shuffles(docs.sparkSession)
    sets = found.select("doc", "n", "tokens")
    entries = found.select("doc", "n", F.size("tokens").alias("s"), F.explode("entries").alias("entry"))
    often = entries.groupBy("entry").agg(F.count("*").alias("members")).where("members > 1").select("entry")
    indexed = materialise(entries.join(often, "entry"), "entries")
    release_shuffles(docs.sparkSession)
    indexed = indexed.withColumn("central", F.col("s") / F.col("n"))  # the least of it is unshared
    return members, heads.select("node", "head"), entry_links(indexed, sets, percent)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id_col``, n_shingles, component_id for every row of ``docs``."""
    members, heads, links = jaccard_links(docs, id_col, text_col, percent)
    parts = connected_components(links).join(heads, "node")
    # The smallest node names a component, the smallest id is its result.
    least = parts.groupBy("component").agg(F.min("head").alias("least"))
    parts = materialise(parts.join(least, "component").select("node", "least"), "parts")
    out = salted_join(members, parts, "node", F.monotonically_increasing_id())
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("least", "head")).alias("component_id"))
