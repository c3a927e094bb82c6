"""The queries of the engine's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairoscope.functions import ids
from kairoscope.functions import text as T
from kairoscope.functions import vector as V
from kairoscope.operators import conversation, evaluation, events, graph, memory, retrieval, temporal
from kairoscope.plans import mapping as M
from kairoscope.plans.catalog import ORACLES, QUERIES, Query, query
from kairoscope.session import materialise, tasks
from kairoscope.streaming import turns

def queries() -> dict[str, Query]:
    """All registered queries; those of the other modules of this package too."""
    from kairoscope.plans import code, lookups, records, search, store, stored  # noqa: F401  they register on import

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: exact cosine and BM25, fused by reciprocal ranks."""
    return hybrid_rrf(spark, sf_dir)


# Retrieval

_COSINE = "list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)))"
_EACH = f"each AS (SELECT item_id, vec_id, round({_COSINE}, 9) AS score FROM embeddings, (SELECT item_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id)), near AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank FROM each)"
BM25_SQL = """terms AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2))) AS term FROM benchmark),
docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2) AS w FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM docs),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
  FROM post JOIN df USING (term) JOIN terms USING (term), corpus GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""


#: Every vector whose number is divisible by twenty asks.
ASKED_SQL = f"""asked AS (SELECT vec_id AS query_id, label AS own, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
dense AS (SELECT query_id, own, vec_id, label, round({_COSINE}, 9) AS score FROM embeddings, asked),
dense_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense)"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = M.table(spark, sf_dir, "embeddings")
    return retrieval.dense_topk_each(e, e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k, "query_id")


@query(f"WITH {ASKED_SQL} SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM dense_ranked WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {ASKED_SQL} SELECT query_id, vec_id, label, round(score, 6) AS score FROM dense_ranked WHERE rank <= 80 AND label = own")
def dense_topk_postfilter(spark, sf_dir):
    """Of the 80 best rows of each question those of its own label."""
    e = M.table(spark, sf_dir, "embeddings")
    own = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    top = _dense(spark, sf_dir, 80).join(e.select("vec_id", "label"), "vec_id").join(own, "query_id")
    return top.where("label = own").select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH {BM25_SQL} SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM ranked WHERE rank <= 5")
def lexical_bm25_topk(spark, sf_dir):
    rows = retrieval.bm25(M.table(spark, sf_dir, "documents"), M.table(spark, sf_dir, "benchmark"), 5)
    return rows.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {M.TURNS_SQL} SELECT session_id, turn_index, 1.0::DOUBLE AS score FROM t WHERE contains(lower(content), 'the') ORDER BY session_id, turn_index LIMIT 20")
def text_contains_fallback(spark, sf_dir):
    return retrieval.contains_scan(M.turns(spark, sf_dir), "content", "THE", ["session_id", "turn_index"], 20).select("session_id", "turn_index", "score")


def _lexical(spark, sf_dir, k):
    return retrieval.bm25(M.table(spark, sf_dir, "documents"), M.table(spark, sf_dir, "benchmark"), k)


def _dense_of_items(spark, sf_dir, k):
    """Every benchmark item asks with the vector of its number."""
    e = M.table(spark, sf_dir, "embeddings")
    asked = M.table(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select("item_id", "embedding")
    return retrieval.dense_topk_each(e, asked, k, "item_id")


@query(f"""WITH {_EACH}, {BM25_SQL},
d AS (SELECT item_id, vec_id::VARCHAR AS key, rank AS r, score FROM near WHERE rank <= 80),
x AS (SELECT item_id, doc_id::VARCHAR AS key, rank AS r, score FROM ranked WHERE rank <= 40),
f AS (SELECT coalesce(d.item_id, x.item_id) AS item_id, coalesce(d.key, x.key) AS key, coalesce(1.0 / (60 + d.r), 0) + coalesce(1.0 / (60 + x.r), 0) AS score, concat_ws('+', CASE WHEN d.key IS NOT NULL THEN 'dense' END, CASE WHEN x.key IS NOT NULL THEN 'lexical' END) AS sources, d.score AS ds, x.score AS xs
  FROM d FULL JOIN x ON d.key = x.key AND d.item_id = x.item_id)
SELECT item_id, key, round(score, 9) AS score, sources FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ds DESC NULLS LAST, xs DESC NULLS LAST, key) AS rank FROM f) WHERE rank <= 10""")
def hybrid_rrf(spark, sf_dir):
    """The ten best of every benchmark item."""
    dense = _dense_of_items(spark, sf_dir, 80).select("item_id", F.col("vec_id").cast("string").alias("key"), "rank", "score")
    lexical = _lexical(spark, sf_dir, 40).select("item_id", F.col("doc_id").cast("string").alias("key"), "rank", "score")
    return retrieval.rrf(dense, lexical, 10, "item_id").select("item_id", "key", F.round("score", 9).alias("score"), "sources")


@query(f"""WITH {_EACH}, {BM25_SQL}, {M.TURNS_SQL}, hits AS (
SELECT item_id, 'code' AS module, vec_id::VARCHAR AS source_id, score, false AS temporal_applied FROM near WHERE rank <= 10
UNION ALL SELECT item_id, 'research', doc_id::VARCHAR, score, true FROM ranked WHERE rank <= 10
UNION ALL SELECT item_id, 'conversation', session_id || ':' || turn_index, 1.0, false FROM (SELECT * FROM t WHERE contains(lower(content), 'the') ORDER BY session_id, turn_index LIMIT 10), benchmark)
SELECT item_id, module, source_id, round(score, 6) AS score, temporal_applied FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, temporal_applied DESC, module, source_id) AS place FROM hits) WHERE place <= 20""")
def unified_merge(spark, sf_dir):
    """One list for every benchmark item."""
    talk = retrieval.contains_scan(M.turns(spark, sf_dir), "content", "the", ["session_id", "turn_index"], 10).withColumn("id", F.concat_ws(":", "session_id", F.col("turn_index").cast("string")))
    talk = M.table(spark, sf_dir, "benchmark").select("item_id").crossJoin(F.broadcast(talk))  # ten rows
    hits = [retrieval.as_hits(_dense_of_items(spark, sf_dir, 10), "code", "item_id", "vec_id"), retrieval.as_hits(_lexical(spark, sf_dir, 10), "research", "item_id", "doc_id", temporal=True), retrieval.as_hits(talk, "conversation", "item_id", "id")]
    return retrieval.unified(hits, 20, "item_id").select("item_id", "module", "source_id", F.round("score", 6).alias("score"), "temporal_applied")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ingested_at FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') <= '2024-01-15T12'")
def as_of_filter(spark, sf_dir):
    rows = M.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ingested_at"))
    return retrieval.as_of(rows, "ingested_at", "2024-01-15T12")


@query("""WITH r AS (SELECT doc_id, 1.0 / (doc_id + 1) AS score, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, score, unnest(w) AS name, unnest(range(len(w))) AS pos FROM r),
s AS (SELECT lower(name) AS key, round(sum(score / (pos + 1)), 9) AS weight, min(doc_id) AS first, arg_min(name, doc_id * 100000 + pos) AS name FROM p GROUP BY lower(name))
SELECT name, 'word' AS type, weight FROM s ORDER BY weight DESC, first, key LIMIT 5""")
def seed_entities(spark, sf_dir):
    docs = M.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), (1.0 / (F.col("doc_id") + 1)).alias("score"), F.transform(T.words(F.col("text")), lambda w: F.struct(w.alias("name"), F.lit("word").alias("type"))).alias("entities"))
    return retrieval.seed_entities(docs, 5).select("name", "type", "weight")


@query(f"WITH {ASKED_SQL}, t AS (SELECT query_id, label, round(sum(CASE WHEN score = 0 THEN 1 ELSE score END), 9) AS total, min(rank) AS first FROM dense_ranked WHERE rank <= 80 GROUP BY query_id, label) SELECT query_id, arg_max(label, total * 1000 - first / 1000000) AS label, round(max(total), 6) AS total FROM t GROUP BY query_id")
def dominant_project(spark, sf_dir):
    """The label with the largest sum of scores among the 80 best rows of each question."""
    rows = _dense(spark, sf_dir, 80).join(M.table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return retrieval.dominant_project(rows, "label", "score", "rank", "query_id").select("query_id", "label", F.round("total", 6).alias("total"))


# Conversation


@query(f"""WITH {M.TURNS_SQL}, n AS (SELECT *, lag(content) OVER w AS before, lead(content) OVER w AS after FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn_index))
SELECT session_id, turn_index, coalesce(sha256(before), '') AS before_hash, coalesce(sha256(after), '') AS after_hash FROM n WHERE contains(lower(content), 'the')""")
def turn_context_window(spark, sf_dir):
    all_turns = M.turns(spark, sf_dir)
    hits = all_turns.where(T.contains_ignoring_case(F.col("content"), F.lit("the"))).select("session_id", "turn_index")
    rows = conversation.context_window(hits, all_turns)
    digest = lambda c: F.coalesce(F.sha2(F.col(c).cast("binary"), 256), F.lit(""))
    return rows.select("session_id", "turn_index", digest("before").alias("before_hash"), digest("after").alias("after_hash"))


@query(f"""WITH {M.DELIVERIES_SQL}
SELECT sha256(session_id || ':' || turn_index) AS content_hash, any_value(session_id) AS session_id, any_value(turn_index) AS turn_index, sha256(arg_min(content, ingested_at)) AS content_sha,
       max(ingested_at) AS ingested_at, any_value(role) IN ('user', 'assistant') AS embedded,
       (len(list_filter(string_split_regex(arg_min(content, ingested_at), '\\s+'), lambda x: x <> '')) * 1.3::DOUBLE - 0.5 + 1e-9)::INT AS tokens FROM d GROUP BY session_id, turn_index""")
def turn_ingest_final_state(spark, sf_dir):
    rows = conversation.ingest_turns(M.deliveries(spark, sf_dir))
    return rows.select("content_hash", "session_id", "turn_index", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"), "ingested_at", "embedded", "tokens")


@query(f"WITH {M.DELIVERIES_SQL} SELECT session_id, count(*) AS turn_count, max(turn_index) AS last_turn_index, arg_min(role, ingested_at * 100000 + turn_index) AS first_role FROM d GROUP BY session_id")
def session_rollup(spark, sf_dir):
    return conversation.sessions(M.deliveries(spark, sf_dir))


# Chunks and normalisers

_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, CASE WHEN floor(len(w) * 1.3::DOUBLE) <= 512 THEN [trim(text, E' \\n\\t\\r')] ELSE list_transform(range(ceil(greatest(len(w) - 393, 0) / 355.0)::INT + 1), lambda k: array_to_string(w[k * 355 + 1 : k * 355 + 393], ' ')) END AS chunks FROM w)
SELECT doc_id, unnest(range(len(chunks)))::INT AS chunk_index, len(chunks)::INT AS total, sha256(unnest(chunks)) AS chunk_hash FROM c""")
def chunk_windows(spark, sf_dir):
    rows = M.table(spark, sf_dir, "documents").select("doc_id", T.word_windows(F.col("text")).alias("chunks"))
    return rows.select("doc_id", F.size("chunks").alias("total"), F.posexplode("chunks").alias("chunk_index", "chunk")).select("doc_id", "chunk_index", "total", F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk_hash"))


@query("""WITH m AS (SELECT doc_id, '# top' || chr(10) || 'intro' || chr(10) || '## a' || chr(10) || substr(text, 1, length(text) // 2) || chr(10) || '### b' || chr(10) || '#### deep' || chr(10) || substr(text, length(text) // 2 + 1) AS md FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(md, '(^|\\n)(#{2,3}\\s)', '\\1' || chr(30) || '\\2', 'g'), chr(30)), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '') AS parts FROM m)
SELECT doc_id, len(parts)::INT AS total, sha256(array_to_string(parts, '|')) AS hash FROM s""")
def chunk_headers(spark, sf_dir):
    text = F.col("text")
    half = F.floor(F.length(text) / 2).cast("int")
    md = F.concat(F.lit("# top\nintro\n## a\n"), F.substring(text, F.lit(1), half), F.lit("\n### b\n#### deep\n"), F.substring(text, half + 1, F.length(text)))
    rows = M.table(spark, sf_dir, "documents").select("doc_id", T.header_sections(md).alias("parts"))
    return rows.select("doc_id", F.size("parts").alias("total"), F.sha2(F.array_join("parts", "|").cast("binary"), 256).alias("hash"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_hash_dedupe(spark, sf_dir):
    rows = M.table(spark, sf_dir, "documents").withColumn("content_hash", ids.finding_hash(F.col("text")))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace('  ' || p_name || '  X ', '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS name FROM part")
def name_normalise(spark, sf_dir):
    return M.table(spark, sf_dir, "part").select("p_partkey", T.name_norm(F.concat(F.lit("  "), "p_name", F.lit("  X "))).alias("name"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(upper(p_name || ' - ' || p_brand), '[\\s-]+', '_', 'g'), '[^A-Z0-9_]', '', 'g') AS predicate FROM part")
def predicate_normalise(spark, sf_dir):
    return M.table(spark, sf_dir, "part").select("p_partkey", T.relation_type(F.concat("p_name", F.lit(" - "), "p_brand")).alias("predicate"))


# Temporal edges


def _fine(spark, sf_dir):
    return temporal.upsert_edges(M.fine_observations(spark, sf_dir))


def _coarse(spark, sf_dir):
    return temporal.upsert_edges(M.coarse_observations(spark, sf_dir))


def _with_counts(edges):
    return temporal.contradiction_counts(edges.withColumn("edge_id", F.xxhash64(*temporal.EDGE)))


_PAIRS = """c AS (SELECT a.project_id, a.subject, a.predicate, a.object, a.valid_from, a.valid_to, b.object AS rival, b.valid_from AS rival_from, b.valid_to AS rival_to FROM e a JOIN e b
  ON a.project_id = b.project_id AND a.subject = b.subject AND a.predicate = b.predicate AND a.object <> b.object
  AND a.valid_from <= coalesce(b.valid_to, 9223372036854775807) AND b.valid_from <= coalesce(a.valid_to, 9223372036854775807))"""
_COUNTED = f"{_PAIRS}, n AS (SELECT project_id, subject, predicate, object, valid_from, valid_to, count(*) AS contradictions FROM c GROUP BY ALL), k AS (SELECT e.*, coalesce(n.contradictions, 0) AS contradictions FROM e LEFT JOIN n ON e.project_id = n.project_id AND e.subject = n.subject AND e.predicate = n.predicate AND e.object = n.object AND e.valid_from = n.valid_from AND e.valid_to IS NOT DISTINCT FROM n.valid_to)".replace("GROUP BY ALL", "GROUP BY project_id, subject, predicate, object, valid_from, valid_to")


@query(f"WITH {M.FINE_SQL}, {M.EDGES_SQL} SELECT project_id, subject, predicate, object, valid_from, coalesce(valid_to, -1) AS valid_to, round(confidence, 6) AS confidence, support, first_seen, last_seen FROM e")
def temporal_edge_upsert(spark, sf_dir):
    """In two batches, the second added to the result of the first."""
    rows = M.fine_observations(spark, sf_dir)
    early = temporal.upsert_edges(rows.where("observed_at < 883612800000000"))
    edges = temporal.upsert_edges(rows.where("observed_at >= 883612800000000"), early)
    return edges.select(*temporal.EDGE[:5], F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), F.round("confidence", 6).alias("confidence"), "support", "first_seen", "last_seen")


@query(f"""WITH {M.FINE_SQL}, {M.EDGES_SQL}, {_PAIRS}, n AS (SELECT project_id, subject, predicate, object, valid_from, valid_to, count(*) AS rivals, min(lpad(rival::VARCHAR, 12, '0') || ':' || rival_from) AS first FROM c GROUP BY ALL)
SELECT e.project_id, e.subject, e.predicate, e.object, e.valid_from, coalesce(e.valid_to, -1) AS valid_to, coalesce(rivals, 0) AS rivals, coalesce(ltrim(split_part(first, ':', 1), '0'), '') AS first_rival FROM e LEFT JOIN n
  ON e.project_id = n.project_id AND e.subject = n.subject AND e.predicate = n.predicate AND e.object = n.object AND e.valid_from = n.valid_from AND e.valid_to IS NOT DISTINCT FROM n.valid_to""".replace("GROUP BY ALL", "GROUP BY project_id, subject, predicate, object, valid_from, valid_to"))
def contradiction_pairs(spark, sf_dir):
    """Every edge with the number of its rivals and the first of them."""
    rows = temporal.rivals(_fine(spark, sf_dir))
    first = F.ltrim(F.coalesce(F.col("first_rival.object").cast("string"), F.lit("")), F.lit("0"))
    return rows.select(*temporal.EDGE[:5], F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), "rivals", first.alias("first_rival"))


@query(f"WITH {M.COARSE_SQL}, {M.EDGES_SQL}, {_COUNTED} SELECT project_id, subject, predicate, object, valid_from, coalesce(valid_to, -1) AS valid_to, contradictions, round(relevance * pow(0.9, contradictions), 9) AS relevance FROM k")
def contradiction_counts(spark, sf_dir):
    rows = temporal.penalised(_with_counts(_coarse(spark, sf_dir)))
    return rows.select(*temporal.EDGE[:5], F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), "contradictions", F.round("relevance", 9).alias("relevance"))


@query(f"""WITH {M.COARSE_SQL}, m AS (SELECT *, coalesce(valid_from + (valid_to - valid_from) // 2, valid_from)::DOUBLE AS mid FROM o),
s AS (SELECT project_id, subject, predicate, object, count(*) AS n, avg(mid) AS mean, coalesce(var_samp(mid), 0) AS v FROM m GROUP BY project_id, subject, predicate, object)
SELECT project_id, subject, predicate, object, n, round(mean / 3.6e9, 3) AS mean_hours, round(ln(n + 1.0) + n / 2.0 * ln(v + 1e-9), 4) AS mdl_score FROM s""")
def edge_stats_mdl(spark, sf_dir):
    rows = temporal.family_stats(M.coarse_observations(spark, sf_dir))
    return rows.select(*temporal.FAMILY, "n", F.round(F.col("mean_us") / 3.6e9, 3).alias("mean_hours"), F.round("mdl_score", 4).alias("mdl_score"))


@query(f"""WITH {M.COARSE_SQL}, {M.EDGES_SQL}, d AS (SELECT *, CASE WHEN relevance <= 0 THEN 0 ELSE least(greatest(relevance * pow(2, -greatest(({M.NOW_US} - last_seen) / 3.6e9, 0) / 168.0), 0), 1) END AS r FROM e)
SELECT project_id, subject, predicate, object, valid_from, coalesce(valid_to, -1) AS valid_to, round(CASE WHEN abs(r - relevance) < 1e-6 THEN relevance ELSE r END, 9) AS relevance FROM d""")
def relevance_decay(spark, sf_dir):
    rows = temporal.decay(_coarse(spark, sf_dir), M.NOW_US)
    return rows.select(*temporal.EDGE[:5], F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), F.round("relevance", 9).alias("relevance"))


@query(f"WITH {M.COARSE_SQL}, {M.EDGES_SQL} SELECT project_id, subject, predicate, object, valid_from, valid_to, support, 'expired_interval' AS reason FROM e WHERE valid_to < {M.NOW_US}")
def archive_expired(spark, sf_dir):
    return temporal.split_expired(_coarse(spark, sf_dir), M.NOW_US)[1].select(*temporal.EDGE, "support", "reason")


def _prune_sql(rounds: int) -> str:
    """The rounds of pruning, one after the other."""
    group = "project_id, subject, predicate"
    parts = ["p0 AS MATERIALIZED (SELECT k.*, coalesce(z.rounds, 0) AS rounds, false AS gone FROM k LEFT JOIN z USING (project_id, subject, predicate))"]
    for i in range(1, rounds + 1):
        live = f"(rounds >= {i} AND NOT gone)"
        parts.append(f"q{i} AS (SELECT *, {live} AND count(*) FILTER ({live}) OVER (PARTITION BY {group}) > 1 AND row_number() OVER (PARTITION BY {group}, {live} ORDER BY -(support * confidence * relevance), object, valid_from, coalesce(valid_to, 9223372036854775807)) > 1 AS hit FROM p{i - 1})")
        parts.append(f"p{i} AS MATERIALIZED (SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN relevance * 0.5 ELSE relevance END AS relevance, gone OR hit AND (relevance * 0.5 < 0.1 OR contradictions > 0) AS gone) FROM q{i})")
    return ", ".join(parts)


@query(f"""WITH {M.COARSE_SQL}, {M.EDGES_SQL}, {_COUNTED}, m AS (SELECT *, coalesce(valid_from + (valid_to - valid_from) // 2, valid_from)::DOUBLE AS mid FROM o),
s AS (SELECT project_id, subject, predicate, object, count(*) AS n, coalesce(var_samp(mid), 0) AS v FROM m GROUP BY project_id, subject, predicate, object),
z AS (SELECT project_id, subject, predicate, count(*) AS rounds FROM s WHERE n >= 3 AND v >= 3.6e12 AND ln(n + 1.0) + n / 2.0 * ln(v + 1e-9) >= 8 GROUP BY project_id, subject, predicate), {_prune_sql(5)}
SELECT project_id, subject, predicate, object, valid_from, coalesce(valid_to, -1) AS valid_to, round(relevance, 9) AS relevance, gone AS archived FROM p5""")
def mdl_prune(spark, sf_dir):
    """Five priorities are at most five families of a group, and so five rounds."""
    rows = temporal.mdl_prune(_with_counts(_coarse(spark, sf_dir)), M.coarse_observations(spark, sf_dir))
    return rows.select(*temporal.EDGE[:5], F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), F.round("relevance", 9).alias("relevance"), "archived")


_WEIGHTED = f"""w AS (SELECT *, greatest(1e-9, confidence * relevance * pow(2, -greatest(valid_from - {M.NOW_US}, {M.NOW_US} - coalesce(valid_to, {M.NOW_US}), 0) / (720 * 3.6e9)) / (1 + 0)) AS weight FROM e),
x AS (SELECT *, sum(weight) OVER (PARTITION BY project_id, subject) AS total FROM w)"""


def _weighted(spark, sf_dir):
    edges = temporal.upsert_edges(M.fine_observations(spark, sf_dir), by=["project_id", "subject"])  # a customer's edges and their total in one task
    return temporal.weighted(edges.withColumn("contradictions", F.lit(0)), M.NOW_US, 720.0)


@query(f"WITH {M.FINE_SQL}, {M.EDGES_SQL}, {_WEIGHTED} SELECT project_id, subject, predicate, object, valid_from, coalesce(valid_to, -1) AS valid_to, round(weight, 9) AS weight, round(total, 6) AS total FROM x")
def transition_weights(spark, sf_dir):
    return _weighted(spark, sf_dir).select(*temporal.EDGE[:5], F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), F.round("weight", 9).alias("weight"), F.round("total", 6).alias("total"))


_WALK = "y AS (SELECT DISTINCT project_id || ':s' || subject AS src, project_id || ':o' || object AS dst FROM e), b AS (SELECT src AS node, dst AS next FROM y UNION SELECT dst, src FROM y), h0 AS (SELECT project_id || ':s' || min(subject) AS node FROM e GROUP BY project_id)"


@query(f"""WITH {M.FINE_SQL}, {M.EDGES_SQL}, {_WALK}, h1 AS (SELECT DISTINCT next AS node FROM b JOIN h0 USING (node)), h2 AS (SELECT DISTINCT next AS node FROM b JOIN h1 USING (node))
SELECT node, min(hop)::INT AS hop FROM (SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node""")
def temporal_neighborhood(spark, sf_dir):
    """Around the first subject of each project, by the claims that a hop asks for; a node's name has its project, kind and number."""
    seeds = M.first_subjects(spark, sf_dir).withColumn("kind", F.lit("s"))
    rows = graph.reached(lambda nodes: M.fine_beside(spark, sf_dir, nodes), seeds, 2)
    node = F.concat(F.col("project_id").cast("string"), F.lit(":"), "kind", F.col("id").cast("string"))
    return rows.groupBy(node.alias("node")).agg(F.min("hop").alias("hop"))  # what has no project or number is one node


def walk_sql(edges: str, seeds: str, restart: float = 0.15, rounds: int = 12, tolerance: float = 1e-6) -> str:
    """The rounds of a walk for each part, and rr: its ranks after the first round that changes less than the tolerance."""
    parts = [
        f"pe AS MATERIALIZED (SELECT part, src, dst, sum(weight) AS w FROM ({edges}) GROUP BY ALL)",
        "ps AS MATERIALIZED (SELECT part, src, dst, w / sum(w) OVER (PARTITION BY part, src) AS p FROM pe)",
        f"sd AS MATERIALIZED (SELECT part, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY part) AS share FROM (SELECT DISTINCT part, node FROM ({seeds})))",
        "nd AS MATERIALIZED (SELECT x.part, x.node, coalesce(share, 0) AS s FROM (SELECT part, src AS node FROM ps UNION SELECT part, dst FROM ps UNION SELECT part, node FROM sd) x LEFT JOIN sd USING (part, node))",
        "r0 AS MATERIALIZED (SELECT part, node, s AS rank FROM nd)",
    ]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT nd.part, nd.node, {restart} * s + (1 - {restart}) * coalesce(f, 0) AS rank FROM nd LEFT JOIN (SELECT ps.part, dst, sum(rank * p) AS f FROM ps JOIN r{i} ON r{i}.part = ps.part AND node = src GROUP BY ALL) x ON x.part = nd.part AND x.dst = nd.node)")
    moved = " UNION ALL ".join(f"SELECT part, {i + 1} AS n, sum(abs(y.rank - x.rank)) AS moved FROM r{i} x JOIN r{i + 1} y USING (part, node) GROUP BY part" for i in range(rounds))
    every = " UNION ALL ".join(f"SELECT part, node, rank, {i + 1} AS n FROM r{i + 1}" for i in range(rounds))
    parts.append(f"ends AS (SELECT part, coalesce(min(n) FILTER (moved < {tolerance}), {rounds}) AS n FROM ({moved}) GROUP BY part)")
    parts.append(f"rr AS MATERIALIZED (SELECT part, node, rank FROM ({every}) JOIN ends USING (part, n))")
    return ", ".join(parts)


def ppr_sql(edges: str, seeds: str, restart: float, dangling: bool, rounds: int) -> str:
    """The rounds of personalised PageRank, one after the other; seeds: node, and the part that its restart belongs to."""
    parts = [
        f"pe AS MATERIALIZED (SELECT src, dst, sum(weight) AS w FROM ({edges}) GROUP BY src, dst)",
        "ps AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM pe)",
        f"sd AS MATERIALIZED (SELECT node, 1.0::DOUBLE / count(*) OVER (PARTITION BY part) AS share FROM (SELECT DISTINCT node, part FROM ({seeds})))",
        "nd AS MATERIALIZED (SELECT x.node, coalesce(sd.share, 0) AS s FROM (SELECT src AS node FROM ps UNION SELECT dst FROM ps UNION SELECT node FROM sd) x LEFT JOIN sd USING (node))",
        "r0 AS MATERIALIZED (SELECT node, s AS rank FROM nd)",
    ]
    for i in range(rounds):
        lost = f"(SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM ps))" if dangling else "0"
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT nd.node, {restart} * s + (1 - {restart}) * (coalesce(f, 0) + {lost} * s) AS rank FROM nd LEFT JOIN (SELECT dst, sum(rank * p) AS f FROM ps JOIN r{i} ON node = src GROUP BY dst) x ON x.dst = nd.node)")
    return ", ".join(parts)


_PROJECT_EDGES = "SELECT project_id AS part, 's' || subject AS src, 'o' || object AS dst, weight FROM w"
_PROJECT_SEEDS = "SELECT project_id AS part, 's' || subject AS node FROM e"


@query(f"""WITH {M.FINE_SQL}, {M.EDGES_SQL}, {_WEIGHTED}, {walk_sql(_PROJECT_EDGES, _PROJECT_SEEDS)},
sc AS (SELECT x.*, round(greatest(a.rank, b.rank) * weight / total, 12) AS score FROM x JOIN rr a ON a.part = project_id AND a.node = 's' || subject JOIN rr b ON b.part = project_id AND b.node = 'o' || object),
tp AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, subject, object, predicate, valid_from, valid_to NULLS LAST) AS place FROM sc)
SELECT project_id, subject, predicate, object, valid_from, coalesce(valid_to, -1) AS valid_to, round(score, 9) AS score FROM tp WHERE place <= 50""")
def temporal_ppr(spark, sf_dir):
    """The 50 best edges of each project by a walk in that project."""
    rows = materialise(_weighted(spark, sf_dir).select(*temporal.EDGE, "weight", "total"), "weighted")  # made once for the walk and its scores
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    walk = rows.select("project_id", name("s", "subject").alias("src"), name("o", "object").alias("dst"), "weight")
    ranks = graph.walk_each(walk, rows.select("project_id", name("s", "subject").alias("node")), ["project_id"], 0.15)
    a = ranks.select("project_id", F.col("node").alias("an"), F.col("rank").alias("ar"))
    b = ranks.select("project_id", F.col("node").alias("bn"), F.col("rank").alias("br"))
    scored = rows.withColumns({"an": name("s", "subject"), "bn": name("o", "object")}).join(a, ["project_id", "an"]).join(b, ["project_id", "bn"])
    scored = scored.withColumn("score", F.round(F.greatest("ar", "br") * F.col("weight") / F.col("total"), 12))
    order = Window.partitionBy("project_id").orderBy(F.desc("score"), "subject", "object", "predicate", "valid_from", F.asc_nulls_last("valid_to"))
    top = scored.withColumn("place", F.row_number().over(order)).where("place <= 50")
    return top.select("project_id", "subject", "predicate", "object", "valid_from", F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), F.round("score", 9).alias("score"))


@query(f"WITH {M.COARSE_SQL}, {M.EDGES_SQL}, p AS (SELECT project_id, predicate, count(*) AS n, sum(support) AS s FROM e GROUP BY project_id, predicate), q AS (SELECT project_id, count(DISTINCT node) AS nodes FROM (SELECT project_id, 's:' || subject AS node FROM e UNION ALL SELECT project_id, 'o:' || object FROM e) GROUP BY project_id) SELECT project_id, sum(n)::BIGINT AS edges, sum(s)::BIGINT AS evidence, string_agg(predicate || '=' || n, ',' ORDER BY predicate || '=' || n) AS by_predicate, any_value(nodes) AS nodes FROM p JOIN q USING (project_id) GROUP BY project_id")
def project_stats(spark, sf_dir):
    return temporal.project_stats(_coarse(spark, sf_dir))


@query(f"WITH {M.COARSE_SQL}, {M.EDGES_SQL} SELECT (SELECT count(*) FROM o) AS observations, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE valid_to < {M.NOW_US}) AS archived, (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM conversations) AS turns")
def module_health(spark, sf_dir):
    edges = _coarse(spark, sf_dir)
    counts = [M.coarse_observations(spark, sf_dir).agg(F.count("*").alias("observations")), edges.agg(F.count("*").alias("edges"), F.count_if(F.col("valid_to") < M.NOW_US).alias("archived")), M.table(spark, sf_dir, "customer").agg(F.count("*").alias("nodes")), M.table(spark, sf_dir, "conversations").agg(F.count("*").alias("turns"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out


@query(f"WITH {M.FINE_SQL} SELECT project_id, subject, object, coalesce(CASE WHEN subject % 3 <> 0 THEN valid_from END, observed_at, 0) AS valid_from, count(*) AS n FROM o GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4"))
def temporal_backfill(spark, sf_dir):
    rows = M.fine_observations(spark, sf_dir).withColumn("valid_from", F.when(F.col("subject") % 3 != 0, F.col("valid_from")))
    return temporal.backfill_valid_from(rows, "observed_at").groupBy("project_id", "subject", "object", "valid_from").agg(F.count("*").alias("n"))


# Structural graph


@query(f"""WITH {M.STRUCTURE_SQL}, {ppr_sql("SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g", "SELECT 'n' || n_nationkey AS node, 0 AS part FROM nation WHERE n_nationkey < 3", 0.2, True, 12)},
z AS (SELECT node, rank, CASE WHEN node IN ('n0', 'n1', 'n2') THEN 1.0 / (1 + substr(node, 2)::INT) ELSE 0 END AS baseline FROM r12),
f AS (SELECT node, baseline, round(0.6 * baseline / max(baseline) OVER () + 0.4 * rank / max(rank) OVER (), 9) AS combined FROM z)
SELECT node, round(baseline, 9) AS baseline, round(combined, 6) AS combined FROM f ORDER BY f.combined DESC, f.baseline DESC, node LIMIT 20""")
def code_ppr_blend(spark, sf_dir):
    g = M.structure(spark, sf_dir).select("src", "dst", "weight")
    both = g.union(g.select("dst", "src", "weight"))
    seeds = M.table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), (1.0 / (1 + F.col("n_nationkey"))).alias("score"))
    ranks = graph.pagerank(both, seeds, 0.2, True, tolerance=None)
    return graph.blend(seeds, ranks, 20).select("node", F.round("baseline", 9).alias("baseline"), F.round("combined", 6).alias("combined"))


@query(f"WITH RECURSIVE {M.STRUCTURE_SQL}, c AS (SELECT 'p0' AS node, 0 AS depth UNION SELECT src, depth + 1 FROM c JOIN g ON dst = node WHERE depth < 3) SELECT node, depth::INT AS depth FROM c WHERE depth > 0")
def impact_closure(spark, sf_dir):
    return graph.closure(M.structure(spark, sf_dir), spark.createDataFrame([("p0",)], "node string"), 3)


@query(f"WITH {M.STRUCTURE_SQL}, n AS (SELECT src AS node FROM g UNION SELECT dst FROM g) SELECT node, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM g WHERE src = node), '') AS imports, coalesce((SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM g WHERE dst = node), '') AS importers FROM n")
def direct_dependencies(spark, sf_dir):
    rows = graph.dependencies(M.structure(spark, sf_dir))
    return rows.select("node", F.array_join("imports", ",").alias("imports"), F.array_join("importers", ",").alias("importers"))


def _symbols(spark, sf_dir):
    return M.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("signature"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_name").alias("short_name"))


@query("""WITH s AS (SELECT p_partkey::VARCHAR AS signature, p_brand || '.' || p_name AS q, p_name AS n FROM part),
req AS (SELECT DISTINCT r FROM (SELECT signature AS r FROM s UNION ALL SELECT q FROM s UNION ALL SELECT n FROM s UNION ALL SELECT 'no ' || n FROM s)),
f AS (SELECT r, 0 AS o, 'signature' AS kind, signature FROM req JOIN s ON r = signature UNION ALL SELECT r, 1, 'qualified', signature FROM req JOIN s ON r = q UNION ALL SELECT r, 2, 'short', signature FROM req JOIN s ON r = n),
k AS (SELECT r, o, kind, count(*) AS c, min(signature) AS signature FROM f GROUP BY r, o, kind),
b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY o) AS x FROM k)
SELECT req.r AS request, coalesce(kind, 'none') AS kind, coalesce(c, 0) AS candidates, CASE WHEN c = 1 THEN signature END AS signature, CASE WHEN kind IS NULL THEN 'missing' WHEN c > 1 THEN 'ambiguous' ELSE 'resolved' END AS status
FROM req LEFT JOIN b ON req.r = b.r AND x = 1""")
def symbol_resolution(spark, sf_dir):
    s = _symbols(spark, sf_dir)
    requests = s.select(F.explode(F.array("signature", "qualified_name", "short_name", F.concat(F.lit("no "), "short_name"))).alias("request")).distinct()
    return graph.resolve_symbols(requests, s)


def _functions(spark, sf_dir):
    return _symbols(spark, sf_dir).withColumn("position", F.col("signature").cast("long") * 2)


_CALLS = """s AS (SELECT p_partkey::VARCHAR AS signature, p_brand || '.' || p_name AS q, p_name AS n, p_partkey * 2 AS pos FROM part),
calls AS (SELECT DISTINCT l_suppkey::VARCHAR AS caller, CASE l_linenumber % 3 WHEN 0 THEN q ELSE '?' END AS target, CASE l_linenumber % 3 WHEN 1 THEN l_partkey * 2 ELSE -1 END AS pos, CASE l_linenumber % 3 WHEN 2 THEN n ELSE '?' END AS short FROM lineitem JOIN s ON signature = l_partkey::VARCHAR),
r AS (SELECT caller, target, coalesce((SELECT min(signature) FROM s WHERE q = target), (SELECT min(signature) FROM s WHERE s.pos = calls.pos), CASE WHEN (SELECT count(*) FROM s WHERE n = short) = 1 THEN (SELECT min(signature) FROM s WHERE n = short) END) AS found, (SELECT count(*) FROM s WHERE n = short) AS c FROM calls),
w AS (SELECT caller, target, found, CASE WHEN found IS NOT NULL THEN CASE WHEN found = caller THEN 'self_call' END WHEN c > 1 THEN 'ambiguous' ELSE 'unknown_target' END AS reason FROM r)"""


def _calls(spark, sf_dir):
    f = _functions(spark, sf_dir)
    l = M.table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").cast("string").alias("signature"), (F.col("l_linenumber") % 3).alias("m"))
    calls = l.join(f, "signature").select(F.col("l_suppkey").cast("string").alias("caller"), F.when(F.col("m") == 0, F.col("qualified_name")).otherwise("?").alias("target"), F.when(F.col("m") == 1, F.col("position")).otherwise(-1).alias("position"), F.when(F.col("m") == 2, F.col("short_name")).otherwise("?").alias("short_name")).distinct()
    return graph.resolve_calls(calls, f)


@query(f"WITH {_CALLS} SELECT caller, coalesce(CASE WHEN reason IS NULL THEN found END, '') AS resolved, coalesce(reason, '') AS reason, count(*) AS n FROM w GROUP BY 1, 2, 3")
def call_target_cascade(spark, sf_dir):
    return _calls(spark, sf_dir).groupBy("caller", F.coalesce("resolved", F.lit("")).alias("resolved"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS caller, l_partkey AS callee, 1 - l_discount AS confidence FROM lineitem), f AS (SELECT count(*) AS functions FROM supplier),
a AS (SELECT count(*) AS edges, count(*) FILTER (confidence >= 0.9) AS confident, count(DISTINCT caller) AS with_calls, round(avg(confidence), 9) AS mean_confidence FROM e)
SELECT edges, confident::BIGINT AS confident, with_calls, mean_confidence, functions, round(with_calls / functions, 9) AS covered, round(confident / edges, 9) AS confident_share FROM a, f""")
def call_diagnostics(spark, sf_dir):
    l = M.table(spark, sf_dir, "lineitem")
    edges = l.select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), (1 - F.col("l_discount")).alias("confidence")).distinct()
    return graph.call_diagnostics(edges, M.table(spark, sf_dir, "supplier"))


# Events


@query("""WITH g AS (SELECT *, coalesce(epoch(lag(ts) OVER w) - epoch(ts) > 7200, false)::INT AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS gaps FROM g) SELECT user_id, event_id, event_type FROM s WHERE gaps = 0""")
def burst_latest(spark, sf_dir):
    return events.latest_burst(M.table(spark, sf_dir, "events"), "user_id", "ts", 7200).select("user_id", "event_id", "event_type")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
j AS (SELECT a.event_id, min(b.n) AS next FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.n > a.n AND b.us >= a.us + 86400000000 GROUP BY a.event_id),
r AS (SELECT event_id, user_id, event_type FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.event_type FROM r JOIN j ON j.event_id = r.event_id JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = j.next)
SELECT event_id, user_id, event_type FROM r""")
def debounce(spark, sf_dir):
    return events.debounce(M.table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 86400.0).select("event_id", "user_id", "event_type")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS calls FROM events")
def rate_limit_counts(spark, sf_dir):
    return events.calls_in_window(M.table(spark, sf_dir, "events"), "user_id", "ts", 21600).select("event_id", "calls")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def bounded_buffer(spark, sf_dir):
    return events.newest(M.table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 200).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id, event_type")
def usage_counters(spark, sf_dir):
    return events.counters(M.table(spark, sf_dir, "events"), ["user_id", "event_type"], "value")


@query("SELECT event_type, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_summary(spark, sf_dir):
    return events.nearest_rank_p95(M.table(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT event_id, user_id, 0 AS replay FROM events")
def cdc_signature_dedupe(spark, sf_dir):
    e = M.table(spark, sf_dir, "events")
    replayed = e.withColumn("replay", F.lit(0)).union(e.withColumn("replay", F.lit(1)))
    return events.dedupe_changes(replayed, "event_type", ["event_id"], ["user_id", "ts", "value", "props"], "replay").select("event_id", "user_id", "replay")


@query(f"WITH {M.TURNS_SQL} SELECT session_id, turn_index, (row_number() OVER (PARTITION BY session_id ORDER BY turn_index) - 1)::INT AS number FROM t")
def stream_turn_numbering(spark, sf_dir):
    """The conversations as a stream that ends, numbered by keyed state."""
    return turns.number_table(spark, f"{sf_dir}/conversations.parquet")


# Commits and files


@query("""SELECT l_partkey AS file, o_orderkey AS commit_id, c_name AS author, count(*) AS changes, sum(l_quantity) AS additions FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3""")
def file_history(spark, sf_dir):
    l, o, c = (M.table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    # The tasks follow the rows; those of the last join are grouped where they are, as an order is in one task.
    many, some = tasks(l.count()), tasks(o.count())
    orders = o.repartition(some, "o_custkey").join(c.repartition(some, "c_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_name")
    rows = l.repartition(many, "l_orderkey").join(orders.repartition(many, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("l_partkey").alias("file"), F.col("o_orderkey").alias("commit_id"), F.col("c_name").alias("author")).agg(F.count("*").alias("changes"), F.sum("l_quantity").alias("additions"))


@query("""SELECT o_orderkey AS commit_id, c_name AS author, coalesce(f.files, 0) AS files, coalesce(f.additions, 0) AS additions, coalesce(f.deletions, 0) AS deletions, coalesce(f.paths, '') AS paths
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS files, sum(l_quantity) AS additions, sum(l_linenumber)::BIGINT AS deletions, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS paths FROM lineitem GROUP BY l_orderkey) f ON l_orderkey = o_orderkey""")
def commit_context(spark, sf_dir):
    l, o, c = (M.table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    files = l.groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("files"), F.sum("l_quantity").alias("additions"), F.sum("l_linenumber").alias("deletions"), F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",").alias("paths"))
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(files, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    zero = lambda x, v: F.coalesce(x, F.lit(v)).alias(x)
    return rows.select(F.col("o_orderkey").alias("commit_id"), F.col("c_name").alias("author"), zero("files", 0), zero("additions", 0.0), zero("deletions", 0), zero("paths", ""))


# Memory


@query(f"""WITH {_EACH}, {BM25_SQL}, u AS (SELECT item_id, vec_id AS id, score, 'dense' AS source FROM near WHERE rank <= 40 UNION SELECT item_id, doc_id, score, 'lexical' FROM ranked WHERE rank <= 40),
g AS (SELECT item_id, id, max(score) AS score, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM u GROUP BY item_id, id)
SELECT item_id, id, score, sources FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS place FROM g) WHERE place <= 20""")
def memory_entity_search(spark, sf_dir):
    """The twenty best of every benchmark item."""
    dense = _dense_of_items(spark, sf_dir, 40).withColumnRenamed("vec_id", "id")
    lexical = _lexical(spark, sf_dir, 40).withColumnRenamed("doc_id", "id")
    return memory.search(dense, lexical, "item_id", "id", 20)


@query("""WITH r AS (SELECT DISTINCT c_custkey::VARCHAR AS source, o_orderstatus AS type, o_orderpriority AS target FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT c_custkey::VARCHAR AS name, c_mktsegment AS type, coalesce((SELECT string_agg(r.type || '>' || target, ',' ORDER BY r.type || '>' || target) FROM r WHERE source = c_custkey::VARCHAR), '') AS relations, coalesce((SELECT count(*) FROM r WHERE source = c_custkey::VARCHAR), 0) AS n_relations FROM customer""")
def memory_graph_read(spark, sf_dir):
    o, c = M.table(spark, sf_dir, "orders"), M.table(spark, sf_dir, "customer")
    entities = c.select(F.col("c_custkey").cast("string").alias("name"), F.col("c_mktsegment").alias("type"))
    relations = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").cast("string").alias("source"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("target"))
    return memory.read_graph(entities, relations)


# Evaluation

_LEX = """q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS terms FROM benchmark),
s AS (SELECT item_id, doc_id, len(list_filter(terms, lambda t: contains(lower(text), t))) AS score FROM documents, q),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)"""


@query(f"WITH {_LEX} SELECT item_id, doc_id, score::INT AS score, rank::INT AS rank FROM ranked WHERE rank <= 5")
def lexical_bench_candidates(spark, sf_dir):
    return retrieval.lexical_candidates(M.table(spark, sf_dir, "documents"), M.table(spark, sf_dir, "benchmark"))


@query(f"""WITH {BM25_SQL}, x AS (SELECT * FROM ranked WHERE rank <= 20), h AS (SELECT item_id, min(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN rank END) AS r FROM x GROUP BY item_id)
SELECT item_id, r::INT AS hit_rank, coalesce(round(1.0 / r, 9), 0) AS mrr, coalesce(CASE WHEN r <= 10 THEN round(1 / log2(r + 1), 9) END, 0) AS ndcg, CASE WHEN r <= 5 THEN 1 ELSE 0 END AS success, CASE WHEN r <= 10 THEN 1 ELSE 0 END AS recall FROM h""")
def retrieval_metrics(spark, sf_dir):
    bench = M.table(spark, sf_dir, "benchmark")
    ranked = retrieval.bm25(M.table(spark, sf_dir, "documents"), bench, 20)
    bad = M.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    expected = ranked.join(bad, "doc_id", "left_semi").select("item_id", "doc_id")
    return evaluation.query_metrics(ranked, expected)
