"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shape statistics of the line itself and of the lines
before and after it; the chain adds weights for neighbouring labels. The model is fitted on a
bounded sample of labelled documents (``max_docs``), whose lines take their document's label.
Forward-backward gives each line's probability of being good; the mean of these, weighted by line
length, is carried to a probability by a logistic curve fitted on the same sample.

Null and empty texts have no lines and score as the sample's share of good documents. Repeated
rows keep their rows, an empty table gives an empty result, and without any labelled document
every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DOCS = 3_000
#: A document with more lines is not taken into the sample; scoring takes documents of any length.
MAX_SAMPLE_LINES = 200
#: Lines scored at once.
BATCH_LINES = 20_000

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_DIGIT = b"0123456789"
_MARKS = b".,;:'\"()-"
_SYMBOLS = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGIT + _MARKS)
_N = 12


def line_features(line: str, seen: bool) -> list[float]:
    """Shape statistics of one line; ``seen``: the same line came before in its document."""
    raw = line.encode()
    n = max(1, len(raw))
    words = line.split()
    k = max(1, len(words))
    odd = len(raw) - len(raw.translate(None, _SYMBOLS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = len(raw) - len(raw.translate(None, _LOWER)) + upper
    high = len(raw) - len(raw.decode("utf-8", "ignore").encode("ascii", "ignore"))
    return [
        np.log1p(n) / 5,
        np.log1p(k) / 4,
        10 * odd / n,
        upper / n * 3,
        (len(raw) - len(raw.translate(None, _DIGIT))) / n * 5,
        (letters + high) / n,
        (len(raw) - len(raw.translate(None, _MARKS))) / n * 5,
        len(line) / k / 10,
        len(set(words)) / k,
        float(raw[-1:] in (b".", b"!", b"?", b":")),
        float(seen),
        sum(1 for w in words if not w[:1].isalpha() and not w[-1:].isalpha()) / k * 3,
    ]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Lines x (1 + 3 * statistics), and the lines' lengths in code points; blank lines do not count."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if not lines:
        return np.zeros((0, 1 + 3 * _N + 2), np.float32), np.zeros(0)
    seen: set[str] = set()
    own = np.empty((len(lines), _N), np.float32)
    for i, line in enumerate(lines):
        own[i] = line_features(line, line in seen)
        seen.add(line)
    blank = np.zeros((1, _N), np.float32)
    edge = np.zeros((len(lines), 2), np.float32)
    edge[0, 0] = edge[-1, 1] = 1
    every = np.hstack([np.ones((len(lines), 1), np.float32), own, np.vstack([blank, own[:-1]]), np.vstack([own[1:], blank]), edge])
    return every, np.array([len(x) for x in lines], float)


@dataclass
class ChainModel:
    """Weights of bad (0) against good (1): per feature, and for each pair of neighbouring labels."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def node_scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def marginals(self, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line and P of each pair of labels at every line but a first; ``sizes``: lines of each document."""
        return forward_backward(scores, sizes, self.pairs)

    def document_score(self, share: np.ndarray) -> np.ndarray:
        a = np.clip(share, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(a / (1 - a)) + self.shift)))


def forward_backward(scores: np.ndarray, sizes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All documents go forward by one line at a time, the longest ones last."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    node = np.stack([np.zeros_like(scores), scores], axis=1).astype(float)
    total, longest = len(scores), int(left[0]) if len(left) else 0
    live = np.searchsorted(-left, -np.arange(longest), side="left") if longest else []
    ahead, back = np.zeros((total, 2)), np.zeros((total, 2))

    def join(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for t in range(longest):
        at = starts[: live[t]] + t
        ahead[at] = node[at] if t == 0 else node[at] + join(ahead[at - 1][:, :, None] + pairs[None], 1)
    for t in range(longest - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        back[at] = join(pairs[None] + (node[at + 1] + back[at + 1])[:, None, :], 2)
    both = ahead + back
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.ones(total, bool)
    inner[starts[left > 0]] = False
    at = np.flatnonzero(inner)
    joint = ahead[at - 1][:, :, None] + pairs[None] + (node[at] + back[at])[:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    return good, joint / joint.sum(axis=(1, 2), keepdims=True)


def fit(documents: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 150, rate: float = 0.05, penalty: float = 1e-4) -> ChainModel:
    """Maximises the conditional likelihood of the labels by Adam steps over (features, lengths, label)."""
    width = 1 + 3 * _N + 2
    documents = [d for d in documents if len(d[1])]
    model = ChainModel(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)))
    if not documents:
        return model
    x = np.vstack([d[0] for d in documents]).astype(float)
    sizes = np.array([len(d[1]) for d in documents])
    label = np.array([d[2] for d in documents], float)
    y = np.repeat(label, sizes)
    model.prior = float(label.mean())
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-3
    model.mean[0], model.spread[0] = 0, 1
    x = (x - model.mean) / model.spread
    weight = 1.0 / np.repeat(np.maximum(sizes, 1), sizes) / len(sizes)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(sizes) - sizes] = False
    truth = np.zeros((int(inner.sum()), 2, 2))
    truth[np.arange(len(truth)), y[inner].astype(int), y[inner].astype(int)] = 1
    params = np.zeros(width + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        model.weights, model.pairs = params[:width], params[width:].reshape(2, 2)
        good, joint = model.marginals(x @ model.weights, sizes)
        slope = np.concatenate([x.T @ ((good - y) * weight), ((joint - truth) * weight[inner][:, None, None]).sum(0).ravel()]) + penalty * params
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    model.weights, model.pairs = params[:width], params[width:].reshape(2, 2)
    good, _ = model.marginals(x @ model.weights, sizes)
    length = np.concatenate([d[1] for d in documents])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    share = np.bincount(owner, good * length) / np.bincount(owner, length)
    a = np.clip(share, 1e-6, 1 - 1e-6)
    z, slope, shift = np.log(a / (1 - a)), 1.0, 0.0
    for _ in range(200):  # the curve from weighted share to probability
        p = 1 / (1 + np.exp(-(slope * z + shift)))
        h = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - label) * z).mean() + 1e-3 * (slope - 1), (p - label).mean()])
        m = np.array([[(h * z * z).mean() + 1e-3, (h * z).mean()], [(h * z).mean(), h.mean() + 1e-6]])
        move = np.linalg.solve(m, g)
        slope, shift = slope - 0.5 * move[0], shift - 0.5 * move[1]
    model.slope, model.shift = float(slope), float(shift)
    return model


def score_texts(model: ChainModel, texts: list[str | None]) -> list[float]:
    """The quality of every text."""
    scores: list[float] = []
    at = 0
    while at < len(texts):
        parts, lines = [], 0
        while at < len(texts) and (not parts or lines < BATCH_LINES):
            parts.append(document_features(texts[at]))
            lines += len(parts[-1][1])
            at += 1
        sizes = np.array([len(n) for _, n in parts])
        good, _ = model.marginals(model.node_scores(np.vstack([x for x, _ in parts])), sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        length = np.concatenate([n for _, n in parts])
        top, all_ = np.bincount(owner, good * length, len(sizes)), np.bincount(owner, length, len(sizes))
        own = model.document_score(top / np.maximum(all_, 1))
        scores += np.where(sizes > 0, own, model.prior).tolist()
    return scores


def held_out(id_col: Column) -> Column:
    """The fifth of the ids whose labels are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS) -> ChainModel:
    """Fits on at most ``max_docs`` labelled documents outside the held-out fifth, chosen by a hash of the id."""
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(max_docs)
    )
    chosen = F.broadcast(chosen)  # max_docs rows of 12 bytes at most
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(label, *document_features(text)) for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [r for r in rows if len(r[2]) <= MAX_SAMPLE_LINES]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["label", "x", "n"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("label", "text").mapInArrow(features, "label int, x binary, n binary").collect()
    rows = sorted((r.label, bytes(r.n), bytes(r.x)) for r in rows)
    return fit([(np.frombuffer(x, np.float32).reshape(-1, 1 + 3 * _N + 2), np.frombuffer(n, float), label) for label, n, x in rows])


def score(docs: DataFrame, model: ChainModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` added; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some forty numbers

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(score_texts(shared.value, p.tolist()), dtype=float)

    return docs.withColumn(score_col, scored(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score and predicted (1 where the score reaches ``threshold``) for every row of ``docs``."""
    model = train(docs, labels, id_col, text_col)
    rows = score(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")), model)
    return rows.select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
