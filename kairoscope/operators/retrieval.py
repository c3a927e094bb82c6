"""Dense and lexical scans, fusion and the unified list of hits.

Ties end at the key, so every ranking is total. A limit is a top-k report.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema as to_arrow
from pyspark.sql.types import StructType

from kairoscope.functions import text as T
from kairoscope.functions import vector as V
from kairoscope.session import materialise

#: Fixed value of reciprocal-rank fusion.
RRF_K = 60
#: Usual constants of BM25.
K1, B = 1.2, 0.75


def dense_topk(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, score, rank: the k rows nearest to the one row of ``query`` by cosine; invalid vectors never match."""
    one = query.select(F.col(vector).alias("__query")).where(V.is_valid(F.col("__query"))).limit(1)
    rows = vectors.where(V.is_valid(F.col(vector))).crossJoin(F.broadcast(one))  # one row
    top = rows.select(F.col(key), V.cosine(F.col(vector), F.col("__query")).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


#: Bytes of questions that are sent to all tasks; more are met in blocks of QUESTIONS with blocks of ROWS.
ASKED_BYTES, QUESTIONS, ROWS = 8 << 20, 16_384, 50_000
#: Questions and rows that are multiplied at once, 16 MiB of scores.
AT_ONCE = (512, 4_096)


def _by_length(keys: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys and unit vectors for each number of dimensions."""
    if isinstance(keys, pa.ChunkedArray):
        keys, vectors = keys.combine_chunks(), vectors.combine_chunks()
    lengths, found = pa.compute.list_value_length(vectors), {}
    for n in pa.compute.unique(lengths).to_pylist():
        same = pa.compute.equal(lengths, n)
        own, rows = keys.filter(same), vectors.filter(same).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        names = own.to_numpy(zero_copy_only=False) if not own.null_count else np.array(own.to_pylist(), object)
        found[n] = (names, rows / np.linalg.norm(rows, axis=1, keepdims=True))
    return found


class _Nearest:
    """The k best rows of each question among those that were added, as arrays: a score and a key for each result."""

    def __init__(self, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
        self.asked, self.k = asked, k
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, keys: pa.Array, vectors: pa.Array) -> None:
        for n, (own, rows) in _by_length(keys, vectors).items():
            if n in self.asked:
                questions = self.asked[n][1]
                if n not in self.found:
                    self.found[n] = np.full((len(questions), self.k), -np.inf), np.zeros((len(questions), self.k), own.dtype)
                for a in range(0, len(own), AT_ONCE[1]):
                    for b in range(0, len(questions), AT_ONCE[0]):
                        self._merge(n, b, own[a : a + AT_ONCE[1]], np.round(questions[b : b + AT_ONCE[0]] @ rows[a : a + AT_ONCE[1]].T, 9))

    def _merge(self, n: int, b: int, own: np.ndarray, scores: np.ndarray) -> None:
        best, names = (x[b : b + len(scores)] for x in self.found[n])
        least = best[:, -1].copy()
        if len(own) > self.k:
            least = np.maximum(least, np.partition(scores, len(own) - self.k, axis=1)[:, len(own) - self.k])
        q, at = np.nonzero(scores >= least[:, None])
        old_q, old_at = np.nonzero(np.isin(np.arange(len(scores)), q)[:, None] & (best > -np.inf))
        score, key, q = np.concatenate([scores[q, at], best[old_q, old_at]]), np.concatenate([own[at], names[old_q, old_at]]), np.concatenate([q, old_q])
        order = np.lexsort((key if key.dtype != object else np.unique(key, return_inverse=True)[1], -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        best[q[kept], place[kept]], names[q[kept], place[kept]] = score[order][kept], key[order][kept]

    def table(self, schema: pa.Schema) -> pa.Table:
        parts = []
        for n, (best, names) in self.found.items():
            q, at = np.nonzero(best > -np.inf)
            parts.append(pa.table([pa.array(x, f.type) for x, f in zip((self.asked[n][0][q], names[q, at], best[q, at]), schema, strict=True)], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()


def dense_topk_each(vectors: DataFrame, queries: DataFrame, k: int, query_key: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_key, key, score, rank: for each row of ``queries`` (query_key, vector) the k nearest rows by cosine, exactly.

    Questions of up to ASKED_BYTES are sent to all tasks, and each task keeps its k best rows of each before any is
    shuffled; more are dealt to blocks, and each block of them meets each block of rows. What a task holds is
    bounded by ASKED_BYTES, QUESTIONS, ROWS and k results a question, in arrays. Vectors that are not valid
    never match, nor do those of another length than the question's. For fewer reads see storage.vector_index.
    """
    asked = materialise(queries.select(F.col(query_key).alias("__q"), F.col(vector).alias("__v")).where(V.is_valid(F.col("__v"))), "asked")
    rows = vectors.select(F.col(key).alias("__k"), F.col(vector).alias("__v")).where(V.is_valid(F.col("__v")))
    schema = f"__q {asked.schema['__q'].dataType.simpleString()}, __k {rows.schema['__k'].dataType.simpleString()}, score double"
    size = asked.agg(F.coalesce(F.sum(F.size("__v") * 8 + 64), F.lit(0)), F.count("*")).first()
    out = to_arrow_schema(asked.select("__q").schema, rows.select("__k").schema)
    if size[0] <= ASKED_BYTES:
        known = asked.toArrow()
        sent = vectors.sparkSession.sparkContext.broadcast(_by_length(known["__q"], known["__v"]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nearest = _Nearest(sent.value, k)
            for batch in batches:
                nearest.add(batch.column(0), batch.column(1))
            yield from nearest.table(out).to_batches()

        scored = rows.mapInArrow(scan, schema)
    else:
        row_blocks, query_blocks = -(-rows.count() // ROWS), -(-size[1] // QUESTIONS)
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = rows.withColumn("__r", deal("__k", max(1, row_blocks))).withColumn("__b", each(query_blocks))
        asks = asked.withColumn("__b", deal("__q", query_blocks)).withColumn("__r", each(max(1, row_blocks)))

        def meet(own: pa.Table, asks: pa.Table) -> pa.Table:
            nearest = _Nearest(_by_length(asks["__q"], asks["__v"]), k)
            nearest.add(own["__k"], own["__v"])
            return nearest.table(out)

        scored = own.groupBy("__r", "__b").cogroup(asks.groupBy("__r", "__b")).applyInArrow(meet, schema)
    order = Window.partitionBy("__q").orderBy(F.desc("score"), "__k")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("__q").alias(query_key), F.col("__k").alias(key), "score", "rank")


def to_arrow_schema(query: StructType, key: StructType) -> pa.Schema:
    """__q, __k, score."""
    return pa.schema([*(to_arrow(s).field(0) for s in (query, key)), pa.field("score", pa.float64())])


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_key, key, score, rank: for each query the k best documents.

    Texts are read and split once. Only terms that some query has are kept, besides a row for each
    document that says its length, so that the corpus statistics cover every document.
    """
    wanted = queries.select(F.col(query_key), F.explode(T.lexical_terms(F.col(query_text))).alias("term")).distinct()
    terms = docs.select(F.col(key), F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 2).alias("terms"))
    # No term has a space; many marks keep the documents' own rows from meeting in one task.
    mark = F.concat(F.lit(" "), F.pmod(F.xxhash64(key), F.lit(1024)).cast("string"))
    rows = terms.select(key, F.size("terms").alias("length"), F.explode(F.concat("terms", F.array(mark))).alias("term"))
    asked = small(wanted.select("term").distinct().withColumn("asked", F.lit(True)))
    rows = rows.join(asked, "term", "left").where("asked OR term LIKE ' %'")
    rows = materialise(rows.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length")), "postings")
    corpus = rows.where("term LIKE ' %'").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    found = rows.where("term NOT LIKE ' %'")
    df = small(materialise(found.groupBy("term").agg(F.count("*").alias("df")), "df"))
    found = found.repartition(key)  # the terms of a document are summed for every query in one task, and no pair of them is shuffled
    tf = F.col("tf")
    scored = (
        found.join(df, "term")
        .crossJoin(F.broadcast(corpus))  # one row
        .withColumn("w", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean"))))
        .join(small(wanted), "term")
        .groupBy(query_key, key)
        .agg(F.sum("w").alias("score"))
    )
    # Rounded before ranking: the order of a sum is not defined.
    scored = scored.withColumn("score", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows`` marked to be sent to all executors if they are no more than ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows


def contains_scan(rows: DataFrame, text: str, needle: str, order: list[str], k: int) -> DataFrame:
    """Rows whose text contains the needle in any case, with the score 1."""
    return rows.where(T.contains_ignoring_case(F.col(text), F.lit(needle))).withColumn("score", F.lit(1.0)).orderBy(*order).limit(k)


def rrf(dense: DataFrame, lexical: DataFrame, k: int, query_key: str, key: str = "key") -> DataFrame:
    """query_key, key, score, sources: the k best of each query by reciprocal ranks; of a key seen twice in a list the last rank counts."""
    d = dense.groupBy(query_key, key).agg(F.max("rank").alias("dense_rank"), F.max("score").alias("dense_score"))
    x = lexical.groupBy(query_key, key).agg(F.max("rank").alias("lexical_rank"), F.max("score").alias("lexical_score"))
    both = d.join(x, [query_key, key], "full_outer")
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    both = both.withColumn("score", part("dense_rank") + part("lexical_rank"))
    both = both.withColumn("sources", F.concat_ws("+", F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("lexical_rank").isNotNull(), "lexical")))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.desc_nulls_last("dense_score"), F.desc_nulls_last("lexical_score"), F.col(key))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def as_hits(rows: DataFrame, module: str, query_key: str, source_id: str, score: str = "score", temporal: bool = False) -> DataFrame:
    """The projection that all modules share."""
    return rows.select(query_key, F.lit(module).alias("module"), F.col(source_id).cast("string").alias("source_id"), F.col(score).cast("double").alias("score"), F.lit(temporal).alias("temporal_applied"))


def unified(hits: list[DataFrame], k: int, query_key: str) -> DataFrame:
    """Bag union of the modules' hits, the k best of each query: score, temporal ones first, module, source id."""
    rows = hits[0]
    for h in hits[1:]:
        rows = rows.unionByName(h)
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.desc("temporal_applied"), "module", "source_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def seed_entities(rows: DataFrame, k: int, order: str = "position", score: str = "score", entities: str = "entities") -> DataFrame:
    """name, type, weight: the entities of ranked rows by score over position, summed; zero scores count as one."""
    score_ = F.coalesce(F.nullif(F.col(score), F.lit(0.0)), F.lit(1.0))
    each = rows.select(F.col(order).alias("at"), score_.alias("s"), F.posexplode(entities).alias("pos", "entity"))
    each = each.select("at", "pos", (F.col("s") / (F.col("pos") + 1)).alias("w"), F.trim("entity.name").alias("name"), F.coalesce("entity.type", F.lit("unknown")).alias("type")).withColumn("key", F.lower("name"))
    # Sums first, by hashing; the spelling is looked up for the k best alone, as a smallest text would need a sort of all rows.
    top = each.groupBy("key", "type").agg(F.sum("w").alias("weight"), F.min("at").alias("first")).withColumn("weight", F.round("weight", 9)).orderBy(F.desc("weight"), "first", "key", "type").limit(k)
    top = materialise(top, "top")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("key", "type")]
    found = each.alias("e").join(F.broadcast(top.select("key", "type", "first").alias("t")), [*same, F.col("e.at").eqNullSafe(F.col("t.first"))])  # k rows
    names = found.groupBy("e.key", "e.type").agg(F.min_by("name", F.struct("at", "pos")).alias("name"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("key", "type")]
    return top.alias("t").join(F.broadcast(names.alias("n")), same, "left").select("t.key", "t.type", "weight", "first", "name").orderBy(F.desc("weight"), "first", "t.key", "t.type")  # k rows


def dominant_project(rows: DataFrame, project: str, score: str, position: str, query_key: str) -> DataFrame:
    """query_key, project, total: for each question the project with the largest sum of scores; the one seen first wins a tie."""
    score_ = F.coalesce(F.nullif(F.col(score), F.lit(0.0)), F.lit(1.0))
    sums = rows.where(F.col(project).isNotNull()).groupBy(query_key, project).agg(F.round(F.sum(score_), 9).alias("total"), F.min(position).alias("first"))
    return sums.groupBy(query_key).agg(F.max_by(F.struct(project, "total"), F.struct("total", (-F.col("first")).alias("f"))).alias("top")).select(query_key, f"top.{project}", "top.total")


def as_of(rows: DataFrame, column: str, moment: str | None) -> DataFrame:
    """Rows not later than ``moment``, compared as text; nulls pass, and so does everything without a moment."""
    return rows if moment is None else rows.where(F.coalesce(F.col(column), F.lit("")) <= F.lit(moment))


def lexical_candidates(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """item_id, doc_id, score, rank: by the number of query terms that a text contains anywhere.

    Terms are looked up as substrings, and a substring of letters and digits lies within one run of
    them. So the distinct runs of the corpus are held against the distinct terms of the queries, and
    documents are joined with the terms that their runs contain.
    """
    terms = queries.select("item_id", F.explode(T.lexical_terms(F.col("text"))).alias("term")).distinct()
    runs = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"))).alias("run"))
    # The runs are looked up by all of their pieces of a length that some term has.
    lengths = [r.n for r in terms.select(F.length("term").alias("n")).distinct().collect()]
    each = runs.select("run").distinct().select("run", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)]) if lengths else F.array().cast("array<int>")).alias("n")).where(F.length("run") >= F.col("n"))
    pieces = each.select("run", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("n") + 1), lambda i: F.substring(F.col("run"), i, F.col("n")))).alias("term"))
    # Pieces that are no term go before any is shuffled, and so do a document's runs without one.
    held = materialise(pieces.join(small(terms.select("term").distinct()), "term").distinct(), "held")
    # All rows of a document come to one task once, which then counts for every query without another shuffle.
    found = runs.join(small(held), "run").select("doc_id", "term").repartition("doc_id").distinct()
    scored = found.join(small(terms), "term").groupBy("item_id", "doc_id").agg(F.count("*").cast("int").alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
