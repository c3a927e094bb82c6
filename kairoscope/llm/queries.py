"""One query for each operation of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.llm import bpe, compaction, decontaminate, fill_middle, jaccard_join, lm_score, minhash_dedup, quality_crf, suffix_dedup, token_alignment, url_filter, warc, winnow
from kairoscope.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; counts and digests."""
    return bpe.digest(bpe.encode_decode(_table(spark, sf_dir, "documents")))


#: Of 16 arrivals, each but the first is about half as large as the one before; the file size that merging aims at.
ARRIVALS, OP1_TARGET = 16, 64 << 20


def op1_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends all documents as arrivals of many sizes, compacts, and reads the last version."""
    docs = _table(spark, sf_dir, "documents")
    # The number of leading zeros of a hash of the id halves from one arrival to the next.
    arrival = F.least(F.lit(ARRIVALS - 1), F.lit(31) - F.floor(F.log2(F.greatest(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).bitwiseAND((1 << 31) - 1), F.lit(1)).cast("double")))).cast("int")
    table = compaction.ShardedTable(spark, scratch_path(spark, "sharded"), OP1_TARGET)
    table.append(docs.withColumn("arrival", arrival), "arrival")
    table.compact()
    table.vacuum()
    rows = table.read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document against those that are labelled good."""
    good = _table(spark, sf_dir, "labels").where("quality = 1")
    rows = lm_score.cross_entropy_difference(_table(spark, sf_dir, "documents"), good)
    return rows.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap."""
    return decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    return winnow.digest(winnow.edited_against_next(_table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a WARC record for every page and reads all of them back through the index."""
    return warc.archive_roundtrip(_table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 50-byte strings of earlier documents."""
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges the url of every page."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document, having learned from the labels outside the held-out fifth."""
    return quality_crf.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 5-word shingles."""
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligns the tokens of two tokenizers over every text and counts their links in the corpus."""
    return token_alignment.align_tokens(_table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts every text in three, writes the middle last, and rebuilds the text."""
    return fill_middle.digest(fill_middle.transform(_table(spark, sf_dir, "documents")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 2-word shingles, found by sketches."""
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_compaction": op1_compaction,
    "op2_lm_score": op2_lm_score,
    "op3_decontaminate": op3_decontaminate,
    "op4_winnow": op4_winnow,
    "op5_warc": op5_warc,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_token_alignment": op11_token_alignment,
    "op12_fill_middle": op12_fill_middle,
    "op13_minhash": op13_minhash,
}


def components_sql(words: int, percent: int) -> str:
    """doc_id, n_shingles and component_id of every document: all pairs that share a shingle, and what their links reach."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i : i + {words} - 1], ' '))) END AS s FROM d
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.t = y.t AND x.doc_id <> y.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= {percent} * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least.component_id, s.doc_id) AS component_id FROM s LEFT JOIN least USING (doc_id)
"""


_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest
  FROM pages
), q AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS top FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top > page_id THEN top END AS refers_to, url
FROM q
"""

ORACLES: dict[str, str] = {
    "op1_compaction": "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "op2_lm_score": lm_score.oracle_sql(),
    "op3_decontaminate": decontaminate.oracle_sql(),
    "op5_warc": _WARC_SQL,
    "op10_jaccard_join": components_sql(5, jaccard_join.PERCENT),
    "op12_fill_middle": fill_middle.oracle_sql(),
    "op13_minhash": f"SELECT *, doc_id = component_id AS kept FROM ({components_sql(minhash_dedup.SHINGLE, minhash_dedup.PERCENT)})",
}
