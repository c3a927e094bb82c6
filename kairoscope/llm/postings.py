"""How many texts of the corpus have each token, found without sending texts or holders of tokens.

Documents are dealt to groups. A group sends each of its distinct tokens once, with the number of its
texts that have it, to the bucket of the token; the bucket adds up what all groups sent and answers
each with the sums, in the order in which it had sent. So a token that every text has reaches its
bucket once for each group, and an answer is a byte or two a token.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text for each bucket of tokens; bytes and rows for each group of documents.
BUCKET_BYTES, GROUP_BYTES, GROUP_ROWS = 6 << 20, 4 << 20, 50_000
_SENT = "bucket long, group long, tokens binary, n binary"
_ANSWERED = "group long, bucket long, n binary"


def release() -> None:
    """Gives free memory back to the system: workers outlive their tasks, and several share an executor's allowance."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def narrow(x: np.ndarray) -> bytes:
    """Non-negative integers in the least width that holds them."""
    top = int(x.max()) if len(x) else 0
    code = "H" if top < 1 << 16 else "I" if top < 1 << 32 else "Q"
    return code.encode() + x.astype(f"<u{struct.calcsize(code)}").tobytes()


def wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{struct.calcsize(chr(blob[0]))}", offset=1).astype(np.int64)


def runs(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(sorted_):
        return []
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])).tolist()
    return list(zip(starts, [*starts[1:], len(sorted_)], strict=True))


def id_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc long, text binary; null texts are empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def sizes(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, int]:
    """Buckets for tokens and groups of documents, both in proportion to the input. Groups are a prime number, so that ids with a stride spread too."""
    total, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(4, -(-total // bucket_bytes))
    groups = max(5, -(-total // GROUP_BYTES), -(-count // GROUP_ROWS))
    while any(groups % p == 0 for p in range(2, int(groups**0.5) + 1)):
        groups += 1
    return buckets, groups


def group_column(doc: Column, groups: int) -> Column:
    return F.pmod(doc, F.lit(groups)).cast("long")


def to_bytes(x: np.ndarray) -> bytes:
    """Non-negative integers, each in as few bytes as the largest needs, lowest bytes first: planes of like bytes compress well."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def from_bytes(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of tokens, so sorted tokens have sorted buckets."""
    return ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def steps(tokens: np.ndarray) -> bytes:
    """Sorted tokens as the first one and the distances between neighbours."""
    own = tokens.copy()
    own[1:] -= tokens[:-1]
    return to_bytes(own)


def from_steps(blob: bytes) -> np.ndarray:
    return np.cumsum(from_bytes(blob), dtype=np.uint64)


def group_tokens(texts: pa.Table, tokens_of: Callable[[bytes], np.ndarray], by_text: bool = False) -> tuple[dict[bytes, np.ndarray], np.ndarray, np.ndarray]:
    """Of the distinct texts of a group: the sorted distinct tokens of each, all distinct ones, and how many texts have each.

    Texts with equal sets count once unless ``by_text``, for tokens that do not tell all of a text.
    """
    own: dict[bytes, np.ndarray] = {}
    for text in texts.column("text"):
        data = text.as_py()
        if data not in own:
            own[data] = tokens_of(data)
    sets = own.values() if by_text else {t.tobytes(): t for t in own.values()}.values()
    tokens, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
    return own, tokens, n


def count_tokens(dealt: DataFrame, tokens_of: Callable[[bytes], np.ndarray], buckets: int, by_text: bool = False) -> DataFrame:
    """group, bucket, n: for the distinct tokens of each group of rows (group, text), in their order, how many texts of all groups have them.

    ``tokens_of`` gives the sorted distinct 64-bit tokens of a text. Equal texts count once in a group, and so do
    texts with equal sets unless ``by_text``.
    """

    def send(texts: pa.Table) -> pa.Table:
        release()
        group = texts.column("group")[0].as_py()
        _, tokens, n = group_tokens(texts, tokens_of, by_text)
        spans = runs(at := bucket_of(tokens, buckets))
        return pa.table({"bucket": pa.array([int(at[a]) for a, _ in spans], pa.int64()), "group": pa.array([group] * len(spans), pa.int64()), "tokens": pa.array([steps(tokens[a:b]) for a, b in spans], pa.binary()), "n": pa.array([to_bytes(n[a:b]) for a, b in spans], pa.binary())})

    def answer(sent: pa.Table) -> pa.Table:
        release()
        blocks = [from_steps(x.as_py()) for x in sent.column("tokens")]
        _, at = np.unique(np.concatenate(blocks), return_inverse=True)
        total = np.bincount(at, np.concatenate([from_bytes(x.as_py()) for x in sent.column("n")])).astype(np.int64)
        cuts = np.cumsum([0, *(len(b) for b in blocks)])
        return pa.table({"group": sent.column("group"), "bucket": sent.column("bucket"), "n": pa.array([to_bytes(total[at[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    sent = dealt.groupBy("group").applyInArrow(send, _SENT)  # with all columns, so that the exchange is that of later steps
    return sent.groupBy("bucket").applyInArrow(answer, _ANSWERED)


def answers_in_order(answers: pa.Table) -> np.ndarray:
    """The counts for all tokens of a group, from its rows of count_tokens()."""
    rows = answers.filter(answers.column("bucket").is_valid()).sort_by("bucket")
    return np.concatenate([np.zeros(0, np.int64), *[from_bytes(x.as_py()).astype(np.int64) for x in rows.column("n")]])
