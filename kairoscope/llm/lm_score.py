"""Cross-entropy difference: how much nearer a document is to a target than to the whole corpus.

Two bigram models, one of the target and one of the background, share one vocabulary: every word of
the background, and one unknown word. Both models mix, with the same weight, a bigram estimate with
an add-one unigram estimate; the background's counts are scaled to the target's number of words, so
that both are matched in size and smoothing. Counts cover every text whole. A document's score is
its mean loss per word under the target less that under the background; low scores are near the
target.

The models are never gathered in one place. Documents are dealt to groups; each group adds up its
own words and bigrams and sends every distinct one, once, to the bucket of its hash. The buckets add
up what all groups sent and answer each group with the counts of the whole corpus, in the order in
which it had sent; the groups read their texts again and score them. So a word that every document
has reaches its bucket once for each group, and what travels is in proportion to the distinct
bigrams of the groups. Words and bigrams travel as 64-bit hashes.

Words are lower-cased runs without white space. Null and empty texts have no words and null losses.
A text of any length is scored whole, by the task of its group. Repeated rows keep their rows and
count as often; rows with a null id are background. Without any target word the target model is
uniform. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.joins import salted_join
from kairoscope.llm.postings import bucket_of, from_bytes, from_steps, release, runs, steps, to_bytes
from kairoscope.llm.shingles import mix, word_hashes
from kairoscope.session import materialise

#: The weight of the unigram estimate, in words, against a bigram's count.
BACKOFF = 20.0
#: Bytes of text of a group of documents, and for each bucket of counts.
GROUP_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20
_START = np.uint64(0x5851F42D4C957F2D)
#: The counts of a gram: in all texts and in the target; of words also at the end of a text, in all and in the target.
_COUNTS = ("n", "t", "n_last", "t_last")
_SENT = "bucket long, group long, kind int, hashes binary, n binary, t binary, n_last binary, t_last binary"


class Grams:
    """The words of some texts, one after the other, with the distinct words and bigrams and where they stand."""

    def __init__(self, texts: list[bytes], targets: list[bool]):
        own = [word_hashes(t) for t in texts]
        self.sizes = np.array([len(w) for w in own], np.int64)
        x = np.concatenate([np.zeros(0, np.uint64), *own])
        ends = np.cumsum(self.sizes)[self.sizes > 0]
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[ends - self.sizes[self.sizes > 0]] = _START
        self.start = np.zeros(len(x), bool)
        self.start[ends - self.sizes[self.sizes > 0]] = True
        last = np.zeros(len(x), bool)
        last[ends - 1] = True
        target = np.repeat(np.array(targets, bool), self.sizes)
        self.words, self.at_word = np.unique(x, return_inverse=True)
        self.pairs, self.at_pair = np.unique(mix(x ^ mix(before * np.uint64(0x9E3779B97F4A7C15))), return_inverse=True)
        count = lambda at, n, which: np.bincount(at[which], minlength=n)
        w, p = len(self.words), len(self.pairs)
        every = np.ones(len(x), bool)
        self.word_counts = [count(self.at_word, w, k) for k in (every, target, last, last & target)]
        self.pair_counts = [count(self.at_pair, p, k) for k in (every, target)]


def _grams_of(table: pa.Table) -> Grams:
    return Grams(table.column("text").to_pylist(), table.column("target").to_pylist())


def _sent(table: pa.Table, buckets: int) -> pa.Table:
    """The distinct words (kind 0) and bigrams (kind 1) of a group with their counts there, a row for each bucket."""
    release()
    group, found = table.column("group")[0].as_py(), _grams_of(table)
    out: dict[str, list] = {k: [] for k in ("bucket", "group", "kind", "hashes", *_COUNTS)}
    for kind, hashes, counts in ((0, found.words, found.word_counts), (1, found.pairs, found.pair_counts)):
        at = bucket_of(hashes, buckets)
        for a, b in runs(at):
            row = (int(at[a]), group, kind, steps(hashes[a:b]), *[to_bytes(c[a:b]) for c in counts], *([None] * (4 - len(counts))))
            for name, x in zip(out, row, strict=True):
                out[name].append(x)
    kinds = {"bucket": pa.int64(), "group": pa.int64(), "kind": pa.int32()}
    return pa.table({name: pa.array(x, kinds.get(name, pa.binary())) for name, x in out.items()})


def _answered(table: pa.Table) -> pa.Table:
    """The rows of a bucket with the counts of the whole corpus for those of the group; and one row with sums (group null)."""
    release()
    out: dict[str, list] = {k: [] for k in ("bucket", "group", "kind", *_COUNTS, "words", "n_all", "t_all", "n_ends", "t_ends")}
    sums = [0] * 5
    for kind in (0, 1):
        rows = [r for r in table.select(["bucket", "group", "kind", "hashes", *_COUNTS[: 4 - 2 * kind]]).to_pylist() if r["kind"] == kind]
        if not rows:
            continue
        blocks = [from_steps(r["hashes"]) for r in rows]
        sizes = [len(b) for b in blocks]
        every, at = np.unique(np.concatenate(blocks), return_inverse=True)
        cuts = np.cumsum([0, *sizes])
        totals = {c: np.bincount(at, np.concatenate([from_bytes(r[c]) for r in rows]), len(every)).astype(np.int64) for c in _COUNTS[: 4 - 2 * kind]}
        if kind == 0:
            sums = [len(every), *(int(totals[c].sum()) for c in _COUNTS)]
        for r, a, b in zip(rows, cuts, cuts[1:], strict=False):
            own = at[a:b]
            row = (r["bucket"], r["group"], kind, *[to_bytes(totals[c][own]) if c in totals else None for c in _COUNTS], *[None] * 5)
            for name, x in zip(out, row, strict=True):
                out[name].append(x)
    for name, x in zip(out, (table.column("bucket")[0].as_py(), None, None, *[None] * 4, *sums), strict=True):
        out[name].append(x)
    kinds = {"kind": pa.int32()} | {c: pa.binary() for c in _COUNTS}
    return pa.table({name: pa.array(x, kinds.get(name, pa.int64())) for name, x in out.items()})


def _scored(texts: pa.Table, answers: pa.Table, totals: tuple[int, ...], backoff: float) -> pa.Table:
    """The losses of the texts of a group from the counts that its buckets answered."""
    release()
    found = _grams_of(texts)
    n_words, all_n, all_t, texts_n, texts_t = totals
    counts: dict[tuple[int, str], np.ndarray] = {}
    answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    for kind in (0, 1):
        rows = answers.filter(pa.compute.equal(answers.column("kind"), kind))
        for c in _COUNTS[: 4 - 2 * kind]:
            counts[kind, c] = np.concatenate([np.zeros(0), *[from_bytes(x.as_py()).astype(float) for x in rows.column(c)]])
    scale, n = (all_t / all_n if all_n else 0.0), n_words + 1
    unigram_t, unigram_b = (counts[0, "t"] + 1) / (all_t + n), (counts[0, "n"] * scale + 1) / (all_n * scale + n)
    first_t, first_b = counts[0, "t"] - counts[0, "t_last"] + backoff, (counts[0, "n"] - counts[0, "n_last"]) * scale + backoff
    x, pair, start = found.at_word, found.at_pair, found.start
    before = np.append(0, x[:-1]) if len(x) else x
    loss_t = -np.log2((counts[1, "t"][pair] + backoff * unigram_t[x]) / np.where(start, texts_t + backoff, first_t[before]))
    loss_b = -np.log2((counts[1, "n"][pair] * scale + backoff * unigram_b[x]) / np.where(start, texts_n * scale + backoff, first_b[before]))
    owner = np.repeat(np.arange(len(found.sizes)), found.sizes)
    none = found.sizes == 0
    mean = lambda loss: pa.array(np.bincount(owner, loss, len(none)) / np.maximum(found.sizes, 1), pa.float64(), mask=none)
    return pa.table({"id": texts.column("id"), "n_words": pa.array(found.sizes, pa.int64()), "target_loss": mean(loss_t), "background_loss": mean(loss_b)})


def text_losses(rows: DataFrame, backoff: float = BACKOFF) -> DataFrame:
    """id, n_words, target_loss and background_loss for rows (id, text binary, target boolean); all rows are the background."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, buckets = max(4, -(-total // GROUP_BYTES)), max(4, -(-total // BUCKET_BYTES))
    # Of what tells rows apart, all of it deals them out: only rows that are equal in id and text keep together.
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("id", "text"), F.lit(groups)))
    texts = dealt.groupBy("group")
    sent = texts.applyInArrow(lambda t: _sent(t, buckets), _SENT)
    schema = "bucket long, group long, kind int, n binary, t binary, n_last binary, t_last binary, words long, n_all long, t_all long, n_ends long, t_ends long"
    answers = materialise(sent.groupBy("bucket").applyInArrow(_answered, schema), "gram-counts")
    sums = answers.where("group IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "n_all", "t_all", "n_ends", "t_ends")]).first()
    own = answers.where("group IS NOT NULL").select("bucket", "group", "kind", *_COUNTS).groupBy("group")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, target_loss double, background_loss double"
    return texts.cogroup(own).applyInArrow(lambda t, a: _scored(t, a, tuple(sums), backoff), schema)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", backoff: float = BACKOFF) -> DataFrame:
    """Scores every row of ``docs``; the rows whose id is in ``target_ids`` are the target."""
    chosen = materialise(target_ids.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().withColumn("chosen", F.lit(True)), "target-ids")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = salted_join(texts, chosen, "id", F.col("text")).select("id", "text", F.coalesce("chosen", F.lit(False)).alias("target"))
    return text_losses(rows, backoff).select(F.col("id").alias(id_col), "n_words", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))


def oracle_sql(backoff: float = BACKOFF) -> str:
    """cross_entropy_difference() of documents against those of quality 1, in DuckDB's SQL."""
    return f"""
WITH d AS (
  SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]'), lambda x: x <> '') AS w
  FROM documents
), p AS (SELECT doc_id, target, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
v AS (SELECT DISTINCT word FROM p),
k AS (SELECT doc_id, target, pos, word AS w FROM p),
g AS (SELECT doc_id, target, w, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY pos), ' ^') AS before FROM k),
c AS (SELECT before, w, count(*) AS b, count(*) FILTER (target) AS t FROM g GROUP BY ALL),
s AS (SELECT sum(b) AS b, sum(t) AS t, sum(t) / sum(b) AS scale, (SELECT count(*) FROM v) + 1 AS n FROM c),
u AS (SELECT w, (sum(c.b) * scale + 1) / (s.b * scale + n) AS b, (sum(c.t) + 1) / (s.t + n) AS t FROM c, s GROUP BY w, scale, n, s.b, s.t),
h AS (SELECT before, sum(c.b) * scale AS b, sum(c.t) AS t FROM c, s GROUP BY before, scale),
l AS (
  SELECT c.before, c.w, -log2((c.t + {backoff} * u.t) / (h.t + {backoff})) AS t, -log2((c.b * scale + {backoff} * u.b) / (h.b + {backoff})) AS b
  FROM c JOIN u USING (w) JOIN h ON h.before = c.before, s
)
SELECT d.doc_id, coalesce(x.n, 0)::BIGINT AS n_words, round(x.t, 6) AS target_loss, round(x.b, 6) AS background_loss, round(x.t - x.b, 6) AS score
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n, avg(l.t) AS t, avg(l.b) AS b FROM g JOIN l USING (before, w) GROUP BY doc_id) x USING (doc_id)
"""
