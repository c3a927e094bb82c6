"""Fill-in-the-middle transformation over run-length class encodings of texts.

A text's code points fall into classes by the bytes that one takes in UTF-8 (1 to 4). Of every text
its maximal runs of one class are kept, each with the code points and the bytes before it. A cut
after so many code points is found by binary search for its run; from there its byte is arithmetic,
as all code points of a run are equally wide. No text is decoded, and a text of any length costs an
entry a run.

The cuts and the form of a document follow from hashes of its id. A text that is empty or holds a
sentinel, and a share of all others, stays plain. The rest is written with the suffix before the
middle, and of these a share with the suffix first of all. As no cut text holds a sentinel, the text
is rebuilt from the output and the form alone.

Null texts are empty and stay plain. Rows without an id are cut by the hashes of an empty id. Rows
that repeat an id, and repeated texts, keep each their row; rows of one id have the same hashes. An
empty table gives an empty result; columns of other names may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.postings import release, runs

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares of 100: texts that are cut, and among them those with the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes that are classed at once, and bytes of texts that are cut together.
STRETCH, BATCH_BYTES = 1 << 20, 4 << 20
_WIDTH = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.uint8)  # of a code point by its first byte


@dataclass
class ClassRuns:
    """Maximal runs of code points of one width, of one text or of several one after the other."""

    #: Of each run: the code points before it, the bytes before it, and the bytes of each of its code points.
    units: np.ndarray
    begin: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, text_begins: np.ndarray | None = None) -> ClassRuns:
        """The runs of UTF-8 bytes; a run also ends where a text begins."""
        parts, seen, last = [], 0, 0
        for a in range(0, len(raw), STRETCH):
            width = _WIDTH[raw[a : a + STRETCH]]
            first = np.flatnonzero(width)
            if len(first):
                own = width[first]
                starts = np.diff(own.astype(np.int8), prepend=np.int8(last)) != 0
                if text_begins is not None:
                    begun = text_begins[np.searchsorted(text_begins, a) : np.searchsorted(text_begins, a + len(width))]
                    starts[np.searchsorted(first, begun - a)] = True
                at = np.flatnonzero(starts)
                parts.append((seen + at, a + first[at], own[at]))
                seen, last = seen + len(first), int(own[-1])
        if not parts:
            return cls(*(np.zeros(0, np.int64),) * 3)
        return cls(*(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)))

    def bytes_before(self, units: np.ndarray) -> np.ndarray:
        """The byte at which each number of code points ends: the run by binary search, the offset in it by its width."""
        run = np.searchsorted(self.units, units, side="right") - 1
        return self.begin[run] + (units - self.units[run]) * self.width[run]

    def units_before(self, at: np.ndarray) -> np.ndarray:
        """How many code points are before each byte at which one begins or the last one ends."""
        run = np.searchsorted(self.begin, at, side="right") - 1
        return self.units[run] + (at - self.begin[run]) // self.width[run]


def hash_numbers(key: Column, salt: str = "1", count: int = 4) -> list[Column]:
    """The first groups of eight digits of the SHA-256 of ``salt:key`` as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def _cut_texts(data: list[bytes], hashes: np.ndarray, cut: int, suffix_first: int) -> list[tuple]:
    """n, form, prefix and middle in code points, and the output of each text."""
    n_bytes = np.array([len(x) for x in data], np.int64)
    ends = np.cumsum(n_bytes)
    begin = ends - n_bytes
    index = ClassRuns.of(np.frombuffer(b"".join(data), np.uint8), np.unique(begin[n_bytes > 0]))
    n, before = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    full = np.flatnonzero(n_bytes)
    before[full] = index.units_before(begin[full])
    n[full] = index.units_before(ends[full]) - before[full]
    one, two = hashes[0] % (n + 1), hashes[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    first, second = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    first[full] = index.bytes_before(before[full] + low[full]) - begin[full]
    second[full] = index.bytes_before(before[full] + high[full]) - begin[full]
    stays, turned = hashes[2] % 100 >= cut, hashes[3] % 100 < suffix_first
    marks = p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for x, units, a, b, prefix, middle, plain, spm in zip(data, n.tolist(), first.tolist(), second.tolist(), low.tolist(), (high - low).tolist(), stays.tolist(), turned.tolist(), strict=True):
        if plain or not x or any(mark in x for mark in marks):
            out.append((units, "plain", None, None, x))
        elif spm:
            out.append((units, "spm", prefix, middle, b"".join((s, x[b:], p, x[:a], m, x[a:b]))))
        else:
            out.append((units, "psm", prefix, middle, b"".join((p, x[:a], s, x[b:], m, x[a:b]))))
    return out


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1", cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``id_col``, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in runs((np.cumsum(sizes) - sizes) // BATCH_BYTES):
                part = batch.slice(a, b - a)
                data = [x.as_py() for x in part.column(1)]
                hashes = np.array([part.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)])
                n, form, prefix, middle, output = zip(*_cut_texts(data, hashes, cut, suffix_first), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
        release()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(hash_numbers(F.col(id_col), salt), 1)])
    return rows.mapInArrow(run, f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and the form alone: no cut text holds a sentinel, so they split it into its parts."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    prefix_first = F.concat(parts[1], parts[3], parts[2])
    suffix_first = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).otherwise(output)


def digest(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lengths and digests of transform()'s rows, and the digest of what is rebuilt from each."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle_sql() -> str:
    """The query's rows in SQL."""
    number = lambda i: f"CAST('0x' || substr(h, {8 * i - 7}, 8) AS BIGINT)"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (
  SELECT *, least({number(1)} % (n + 1), {number(2)} % (n + 1)) AS a, greatest({number(1)} % (n + 1), {number(2)} % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {number(3)} % 100 >= {CUT} THEN 'plain'
              WHEN {number(4)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, CASE WHEN form <> 'plain' THEN substr(t, 1, a) END AS prefix, CASE WHEN form <> 'plain' THEN substr(t, a + 1, b - a) END AS middle, CASE WHEN form <> 'plain' THEN substr(t, b + 1) END AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
