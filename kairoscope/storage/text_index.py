"""A stored full-text index: postings by term and block of documents, with the maxima of each block.

Documents are dealt to blocks of about BLOCK of similar length. A row has the postings of one term in one block, and what
bounds their scores: the highest term frequency and the shortest text among them. So without a posting
the most that a document of a block can score for a question is known, for the document counts and
lengths of the corpus as they are now. A search reads the blocks that promise most, takes from them
the score that its last result has at least, and then reads only the blocks that could exceed it.
The results are those of a scan.

Rows lie in folders by a hash of the term, sorted by term. An append is a new batch with blocks of its
own; it counts with the version that names it, whose document count and lengths are the corpus's. Keys
are new with each append. Null texts are documents without terms. Equal scores are ranked by key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairoscope.functions import text as T
from kairoscope.operators.retrieval import K1, B, small
from kairoscope.session import materialise, tasks
from kairoscope.storage.manifest import Manifest

#: Documents of a block, folders of terms, and blocks that a search reads first.
BLOCK, FOLDERS, FIRST = 64, 64, 8


def terms_of(text: Column) -> Column:
    """The terms of a document, each as often as it has it."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 2)


class TextIndex:
    """``path``/postings/<batch>/folder=<n> for the batches that the last version names."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        self.spark, self.path, self.block = spark, path.rstrip("/"), block
        self.manifest = Manifest(spark, path)

    def append(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Indexes more documents."""
        state = self.manifest.state() or {"batches": [], "documents": 0, "length": 0, "key": docs.schema[key].dataType.simpleString()}
        rows = docs.select(F.col(key).alias("key"), terms_of(F.col(text)).alias("terms")).select("key", F.size("terms").cast("long").alias("length"), "terms")
        # Documents of a block are of about one length, so that its shortest one tells of all.
        rows = rows.withColumn("__size", F.floor(4 * F.log2(F.col("length") + 1)).cast("int"))
        sizes = materialise(rows.groupBy("__size").agg(F.count("*").alias("__documents"), F.sum("length").alias("__length")), "sizes")
        count, length = sizes.agg(F.coalesce(F.sum("__documents"), F.lit(0)), F.coalesce(F.sum("__length"), F.lit(0))).first()
        blocks = sizes.select("__size", F.ceil(F.col("__documents") / self.block).alias("__blocks"))
        rows = rows.join(F.broadcast(blocks), "__size")  # a row a size class: 4 for each power of two
        number = F.lit(len(state["batches"]) << 48) + F.col("__size").cast("long") * (1 << 40) + F.pmod(F.xxhash64("key"), F.col("__blocks"))
        # The documents of a block come to one task once, which then counts and collects its terms without another shuffle.
        rows = rows.select("key", "length", number.alias("block"), "terms").repartition(tasks(length), "block")
        each = rows.select("key", "length", "block", F.explode("terms").alias("term")).groupBy("term", "block", "key", "length").agg(F.count("*").alias("tf"))
        # A block bounds what is collected.
        blocks = each.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.collect_list(F.struct("key", "tf", "length")).alias("postings"))
        batch = uuid.uuid4().hex
        blocks = blocks.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int"))
        blocks.repartition("folder").sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{self.path}/postings/{batch}")
        self.manifest.commit(self.manifest.last() + 1, state | {"batches": [*state["batches"], batch], "documents": state["documents"] + count, "length": state["length"] + length})

    def _postings(self, columns: list[str], folders: list[int]) -> DataFrame:
        state = self.manifest.state()
        schema = f"term string, block long, n long, max_tf long, min_length long, postings array<struct<key {state['key']}, tf bigint, length bigint>>, folder int"
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/postings/{b}").where(F.col("folder").isin(folders)).select(*columns) for b in state["batches"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def topk(self, queries: DataFrame, k: int, query_key: str = "query_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
        """``query_key``, key, score, rank: the k best documents of each question by BM25; and per question the postings of its terms and how many were read."""
        state = self.manifest.state()
        wanted = materialise(queries.select(F.col(query_key).alias("query"), F.explode(T.lexical_terms(F.col(text))).alias("term")).distinct(), "wanted")
        folders = [r[0] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int").alias("f")).distinct().collect()]  # at most FOLDERS
        known = self._postings(["term", "block", "n", "max_tf", "min_length"], folders).join(wanted.select("term").distinct(), "term")
        known = materialise(known, "blocks")
        often = known.groupBy("term").agg(F.sum("n").alias("df"))
        count, mean = state["documents"], state["length"] / max(1, state["documents"])

        def weight(tf: Column, length: Column) -> Column:
            idf = F.log(1 + (F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5))
            return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))

        asked = materialise(wanted.join(often, "term"), "asked")  # query, term, df
        most = known.join(asked, "term").groupBy("query", "block").agg(F.sum(weight(F.col("max_tf"), F.col("min_length"))).alias("most"), F.sum("n").alias("postings"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("most"), "block"))
        most = materialise(most.withColumn("place", place), "bounds")

        of_term = small(asked.groupBy("term", "df").agg(F.collect_list("query").alias("asking")))

        def scored(blocks: DataFrame) -> DataFrame:
            # A block's postings come to one task once and are summed there for every query that reads it: no pair of them is shuffled.
            of_block = blocks.groupBy("block").agg(F.collect_list("query").alias("reading"))
            found = self._postings(["term", "block", "postings"], folders).join(of_term, "term").join(small(of_block), "block")
            found = found.withColumn("queries", F.array_intersect("asking", "reading")).where(F.size("queries") > 0)
            found = found.select("block", "df", "postings", "queries").repartition("block")
            each = found.select("block", "df", "queries", F.explode("postings").alias("p")).select("block", "p.key", "queries", weight(F.col("p.tf"), F.col("p.length")).alias("w"))
            sums = each.select("block", "key", "w", F.explode("queries").alias("query")).groupBy("block", "query", "key").agg(F.round(F.sum("w"), 9).alias("score"))
            return sums.select("query", "key", "score")

        first = most.where(F.col("place") <= FIRST).select("query", "block")
        sure = materialise(scored(first), "scored")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        least = sure.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query", F.col("score").alias("least"))
        rest = most.where(F.col("place") > FIRST).join(least, "query", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - 1e-6)).select("query", "block")
        rest = materialise(rest, "rest")
        out = sure.union(scored(rest)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        read = most.join(first.union(rest), ["query", "block"]).groupBy("query").agg(F.sum("postings").alias("read"))
        counts = most.groupBy("query").agg(F.sum("postings").alias("postings")).join(read, "query")
        return out.withColumnRenamed("query", query_key), counts.withColumnRenamed("query", query_key)
