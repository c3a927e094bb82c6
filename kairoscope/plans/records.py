"""Queries over annotations, markers, schedules, contexts and normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoscope.operators import records, retrieval
from kairoscope.plans import mapping as M
from kairoscope.plans.catalog import query
from kairoscope.plans.registry import BM25_SQL


@query("""WITH p AS (SELECT 'a' || lpad((event_id % 40)::VARCHAR, 2, '0') AS annotation_id, event_id AS id FROM events WHERE event_type = 'click'),
n AS (SELECT id, max(annotation_id) AS annotation_id FROM p WHERE annotation_id < 'a30' GROUP BY id) SELECT event_id AS id, coalesce(n.annotation_id, '') AS annotation_id FROM events LEFT JOIN n ON n.id = event_id""")
def annotated_calls(spark, sf_dir):
    """Clicks get annotations of which thirty are pending."""
    e = M.table(spark, sf_dir, "events")
    name = lambda c: F.concat(F.lit("a"), F.lpad(c.cast("string"), 2, "0"))
    pending = spark.range(30).select(name(F.col("id")).alias("annotation_id"), F.lit("pending").alias("status"))
    matches = e.where("event_type = 'click'").select(name(F.col("event_id") % 40).alias("annotation_id"), F.col("event_id").alias("id"))
    calls = e.select(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("annotation_id"))
    return records.apply_annotations(calls, pending, matches)[0].select("id", F.coalesce("annotation_id", F.lit("")).alias("annotation_id"))


@query("""WITH b AS (SELECT o_custkey AS repo_id, CASE WHEN o_orderkey % 3 > 0 THEN 'name ' || o_orderkey END AS display_name, o_orderkey + 10 AS seq FROM orders), x AS (SELECT c_custkey AS repo_id, c_name AS display_name FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT repo_id, arg_max(display_name, seq) FILTER (display_name IS NOT NULL) AS name, min(seq) AS first, max(seq) AS last FROM b GROUP BY repo_id)
SELECT coalesce(n.repo_id, x.repo_id) AS repo_id, coalesce(name, display_name) AS display_name, CASE WHEN x.repo_id IS NULL THEN first ELSE 1 END AS created_at, greatest(CASE WHEN x.repo_id IS NOT NULL THEN 1 END, last) AS updated_at, x.repo_id IS NULL AS created FROM n FULL JOIN x ON n.repo_id = x.repo_id""")
def project_markers(spark, sf_dir):
    o, c = M.table(spark, sf_dir, "orders"), M.table(spark, sf_dir, "customer")
    stored = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("display_name"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at"))
    batch = o.select(F.col("o_custkey").alias("repo_id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("name "), F.col("o_orderkey").cast("string"))).alias("display_name"), (F.col("o_orderkey") + 10).alias("seq"))
    return records.upsert_markers(stored, batch)


@query("""WITH r AS (SELECT o_custkey AS schedule_id, count(*) AS n, max(epoch_us(o_orderdate)) AS last FROM orders GROUP BY o_custkey)
SELECT c_custkey AS schedule_id, c_nationkey AS project_id, coalesce(n, 0) AS run_count, coalesce(last, -1) AS last_run_at, c_custkey % 5 = 0 OR coalesce(n, 0) < 12 AS active, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS place FROM customer LEFT JOIN r ON schedule_id = c_custkey""")
def schedule_state(spark, sf_dir):
    c, o = M.table(spark, sf_dir, "customer"), M.table(spark, sf_dir, "orders")
    schedules = c.select(F.col("c_custkey").alias("schedule_id"), F.col("c_nationkey").alias("project_id"), F.col("c_acctbal").alias("created_at"), F.when(F.col("c_custkey") % 5 > 0, 12).alias("max_runs"))
    rows = records.schedule_runs(schedules, o.select(F.col("o_custkey").alias("schedule_id"), M.micros(F.col("o_orderdate")).alias("ran_at")))
    return rows.select("schedule_id", "project_id", "run_count", F.coalesce("last_run_at", F.lit(-1)).alias("last_run_at"), "active", "place")


@query("SELECT project_id, topic, valid_from, place FROM (SELECT c_nationkey AS project_id, c_mktsegment AS topic, epoch_us(o_orderdate) AS valid_from, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, c_mktsegment) AS place FROM orders JOIN customer ON c_custkey = o_custkey) WHERE place <= 10")
def recent_topics(spark, sf_dir):
    rows = M.table(spark, sf_dir, "orders").join(M.table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return records.recent_topics(rows.select(F.col("c_nationkey").alias("project_id"), F.col("c_mktsegment").alias("topic"), M.micros(F.col("o_orderdate")).alias("valid_from")))


@query("SELECT c_name AS name FROM customer WHERE c_acctbal < 0 OR c_custkey % 3 = 0 ORDER BY c_name LIMIT 100")
def embedding_backfill(spark, sf_dir):
    """The first hundred entities without an embedding."""
    c = M.table(spark, sf_dir, "customer")
    gone = (F.col("c_acctbal") < 0) | (F.col("c_custkey") % 3 == 0)
    rows = c.select(F.col("c_name").alias("name"), F.when(~gone, F.array(F.lit(0.0))).alias("embedding"))
    return records.without_embedding(rows, 100).select("name")


@query(f"""WITH {BM25_SQL}, h AS (SELECT item_id, doc_id, rank, text, source, ceil(length(text) / 4.0)::BIGINT AS tokens FROM ranked JOIN documents USING (doc_id) WHERE rank <= 6),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY item_id ORDER BY rank) AS spent FROM h)
SELECT item_id, sha256(string_agg('[#' || rank || '] ' || CASE WHEN doc_id % 2 = 0 THEN 'doc ' || doc_id ELSE 'Memory block ' || rank END || ' (' || source || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context, sum(tokens)::BIGINT AS tokens FROM s WHERE spent <= 1500 GROUP BY item_id""")
def context_assembly(spark, sf_dir):
    """What fits 1,500 tokens for every benchmark item."""
    docs = M.table(spark, sf_dir, "documents")
    hits = retrieval.bm25(docs, M.table(spark, sf_dir, "benchmark"), 6).join(docs.select("doc_id", "text", "source"), "doc_id")
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    rows = records.assembled_context(hits.select("item_id", "rank", title.alias("title"), "source", F.col("text").alias("content")), "item_id", 1500)
    return rows.select("item_id", F.sha2(F.col("context").cast("binary"), 256).alias("context"), "tokens")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE (CASE WHEN p_size % 3 = 0 THEN 'conversation' ELSE 'memory' END) || ':' || p_brand END AS path, CASE WHEN p_size % 2 = 0 THEN p_name || '#L' || p_size ELSE '' END AS citation, p_size AS start_line,
  CASE WHEN p_size % 3 = 0 THEN 'sessions' ELSE 'memory' END AS source, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS snippet FROM part WHERE CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_retailprice END >= 910""")
def plugin_search(spark, sf_dir):
    p = M.table(spark, sf_dir, "part")
    k = F.col("p_size")
    hits = p.select("p_partkey", F.when(k % 2 == 0, F.col("p_name")).alias("path"), F.when(k % 3 == 0, "conversation").alias("module"), F.col("p_brand").alias("title"), k.alias("start_line"), F.when(k % 5 > 0, F.col("p_retailprice")).alias("score"), F.lit(None).cast("string").alias("snippet"), F.when(k % 4 > 0, F.col("p_type")).alias("content"), F.lit(None).cast("string").alias("text"))
    return records.plugin_hits(hits, 910.0).select("p_partkey", "path", F.coalesce("citation", F.lit("")).alias("citation"), "start_line", "source", "snippet")


@query("""SELECT event_id, coalesce(CASE WHEN regexp_full_match(trim(substr(md5(event_type || event_id), 1, 5 + event_id % 4)), '[0-9a-fA-F]{7,40}') THEN 'git' WHEN event_id % 3 < 2 THEN CASE event_id % 3 WHEN 0 THEN 'code' ELSE 'hybrid' END END, '') AS tool,
  coalesce(CASE WHEN event_id % 2 = 0 THEN 'named' END, CASE WHEN event_id % 5 = 0 THEN 'active' END, 'bound') AS target FROM events""")
def tool_routing(spark, sf_dir):
    """The tool and the write target of every question."""
    e = M.table(spark, sf_dir, "events")
    k = F.col("event_id")
    question = F.substring(F.md5(F.concat("event_type", k.cast("string")).cast("binary")), F.lit(1), (5 + k % 4).cast("int"))
    domain = F.when(k % 3 == 0, " Code").when(k % 3 == 1, "HYBRID ").otherwise("other")
    target = records.write_target(F.when(k % 2 == 0, " named ").otherwise("  "), F.when(k % 5 == 0, "active").otherwise(""), F.lit("bound"))
    return e.select("event_id", F.coalesce(records.routed(domain, F.concat(F.lit(" "), question)), F.lit("")).alias("tool"), target.alias("target"))


@query("""SELECT page_id, CASE WHEN url SIMILAR TO 'https?://.*' THEN url ELSE '' END AS plain, 'http://x/' || page_id AS object, 't' || page_id AS title FROM pages""")
def citation_normalise(spark, sf_dir):
    """A url, an object and an entry that is neither."""
    p = M.table(spark, sf_dir, "pages")
    k = F.col("page_id").cast("string")
    entry = F.concat(F.lit('{"url": " http://x/'), k, F.lit(' ", "title": "t'), k, F.lit('"}'))
    c = p.select("page_id", records.citations(F.array(F.concat(F.lit(" "), "url"), entry, F.lit("no url"))).alias("c")).where("c[2].url IS NULL")
    return c.select("page_id", F.coalesce(F.col("c")[0]["url"], F.lit("")).alias("plain"), F.col("c")[1]["url"].alias("object"), F.col("c")[1]["title"].alias("title"))


@query(f"""WITH {BM25_SQL}, c AS (SELECT item_id, rank, source AS name, CASE WHEN doc_id % 3 > 0 THEN lang END AS kind FROM ranked JOIN documents USING (doc_id) WHERE rank <= 40),
f AS (SELECT item_id, lower(name) AS key, coalesce(kind, 'unknown') AS kk, min(rank) AS rank, arg_min(name, rank) AS name FROM c GROUP BY 1, 2, 3), s AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank, key, kk) AS place FROM f)
SELECT item_id, place, name, CASE WHEN kk = 'unknown' THEN '' ELSE kk END AS kind FROM s WHERE place <= 5""")
def derived_seeds(spark, sf_dir):
    docs = M.table(spark, sf_dir, "documents")
    hits = retrieval.bm25(docs, M.table(spark, sf_dir, "benchmark"), 40).join(docs.select("doc_id", "source", "lang"), "doc_id")
    rows = records.derived_seeds(hits.select("item_id", "rank", F.col("source").alias("seed_name"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("seed_kind")), "item_id")
    return rows.select("item_id", "place", "name", F.coalesce("kind", F.lit("")).alias("kind"))


@query("""WITH a AS (SELECT lang, sum(n_chars)::BIGINT AS b, sum(CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE 0 END)::BIGINT AS t FROM documents GROUP BY lang) SELECT lang, round(CASE WHEN b > 0 THEN (b - t) / b * 100 ELSE 0 END, 6) AS reduction FROM a""")
def token_reduction(spark, sf_dir):
    a = M.table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("b"), F.sum(F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).otherwise(0)).alias("t"))
    return a.select("lang", F.round(records.token_reduction(F.col("b"), F.col("t")), 6).alias("reduction"))
