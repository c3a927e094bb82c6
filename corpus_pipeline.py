"""The corpus pipeline: documents in, token counts and digests of what is left out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet in the shared folder and gives the rows read back to the next. Rows without an id are
judged by the classifier alone and pass the stages that compare documents as they are. Null and
empty texts have the score of the sample's share of good documents, no duplicates and no passages.
Rows that repeat an id go or stay together in the Jaccard join and the decontamination, which name
ids, and are judged each by its own text elsewhere. Columns beside those of documents are kept up
to the last stage, whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.llm import bpe, decontaminate, jaccard_join, quality_crf, suffix_dedup
from kairoscope.llm.joins import without
from kairoscope.session import materialise

#: Documents whose quality score stays below this are rejected.
QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the line classifier does not reject."""
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "score"
    while score in docs.columns:
        score += "_"
    return quality_crf.score(docs, model, score_col=score).where(F.col(score) >= QUALITY_THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every component of linked documents."""
    found = jaccard_join.near_duplicates(docs)
    dropped = materialise(found.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    return without(docs, dropped, "doc_id", F.col("text"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out the byte strings that an earlier document has too; every document stays."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = suffix_dedup.remove_repeats(docs, carry=others or None, whole_characters=True)
    rows = rows.withColumn("text", F.col("kept").cast("string"))
    found = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")} | {c: F.col("carried").getField(c) for c in others}
    return rows.select(*[found[c].alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests."""
    return bpe.digest(bpe.encode_decode(docs))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs


#: No SQL expresses the line classifier; tests hold the stages against brute force.
ORACLE_SQL = None
