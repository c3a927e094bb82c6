"""Queries over what is written: final states after re-delivery, evidence, reports, counts, bursts and texts to embed."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoscope.functions import cards
from kairoscope.functions import text as T
from kairoscope.operators import events, temporal, writes
from kairoscope.plans import mapping as M
from kairoscope.plans.catalog import query

# Upserts

_REPORTS_SQL = """r AS (SELECT doc_id % 7 AS project_id, doc_id // 4 AS session_id, 'title ' || n_chars AS title, lang AS question, doc_id AS seq FROM documents),
d AS (SELECT * FROM r UNION ALL SELECT project_id, session_id, 'again ' || title, source, seq + 1000000000 FROM r JOIN (SELECT doc_id AS seq, source FROM documents) USING (seq))"""


def _reports(spark, sf_dir):
    """Reports of several documents each; all of them delivered twice, with another title and question."""
    docs = M.table(spark, sf_dir, "documents")
    row = lambda title, question, seq: docs.select((F.col("doc_id") % 7).alias("project_id"), F.floor(F.col("doc_id") / 4).alias("session_id"), title.alias("title"), F.col(question).alias("question"), seq.alias("seq"))
    title = F.concat(F.lit("title "), F.col("n_chars").cast("string"))
    return row(title, "lang", F.col("doc_id")), row(F.concat(F.lit("again "), title), "source", F.col("doc_id") + 1_000_000_000)


@query(f"WITH {_REPORTS_SQL} SELECT project_id, session_id, arg_min(question, seq) AS question, arg_max(title, seq) AS title, min(seq) AS seq, max(seq) AS last_seq FROM d GROUP BY project_id, session_id")
def report_upsert(spark, sf_dir):
    """In two batches, the second added to the result of the first."""
    first, again = _reports(spark, sf_dir)
    keys = ["project_id", "session_id"]
    return writes.upsert(again, keys, ["title"], writes.upsert(first, keys, ["title"]))


@query("""WITH d AS (SELECT regexp_replace(url, '[?#].*$', '') AS url, 'page ' || page_id AS title, page_id AS seq FROM pages UNION ALL SELECT regexp_replace(url, '[?#].*$', ''), 'late ' || page_id, page_id + 1000000000 FROM pages WHERE page_id % 2 = 0)
SELECT url, arg_max(title, seq) AS title, min(seq) AS seq FROM d WHERE url IS NOT NULL GROUP BY url""")
def source_upsert(spark, sf_dir):
    url = F.regexp_replace("url", r"[?#].*$", "").alias("url")
    pages = M.table(spark, sf_dir, "pages")
    title = lambda word: F.concat(F.lit(word), F.col("page_id").cast("string")).alias("title")
    rows = pages.select(url, title("page "), F.col("page_id").alias("seq"))
    late = pages.where("page_id % 2 = 0").select(url, title("late "), (F.col("page_id") + 1_000_000_000).alias("seq"))
    return writes.upsert(rows.union(late), ["url"], ["title"]).drop("last_seq")


_CITES_SQL = """c AS (SELECT l_orderkey AS finding, l_partkey AS source, epoch_us(l_shipdate) + l_linenumber AS seq, 'seen ' || l_linenumber AS snippet, epoch_us(l_shipdate) AS valid_from, 1 - l_discount AS confidence FROM lineitem
UNION ALL SELECT l_orderkey, l_partkey, epoch_us(l_shipdate) + l_linenumber + 10000000000000000, 'again ' || l_linenumber, epoch_us(l_shipdate) + 1, 1 - l_tax FROM lineitem)"""


@query(f"""WITH {_CITES_SQL} SELECT finding, source, arg_min(valid_from, seq) AS valid_from, arg_max(snippet, seq) AS snippet, count(*) AS support, max(confidence) AS confidence, 0::BIGINT AS contradictions
FROM c WHERE finding IN (SELECT o_orderkey FROM orders) AND source IN (SELECT p_partkey FROM part WHERE p_size > 3) GROUP BY finding, source""")
def cites_upsert(spark, sf_dir):
    """Citations of known sources only, delivered twice."""
    l = M.table(spark, sf_dir, "lineitem")
    row = lambda word, later, c: l.select(F.col("l_orderkey").alias("finding"), F.col("l_partkey").alias("source"), (M.micros(F.col("l_shipdate")) + F.col("l_linenumber") + 10_000_000_000_000_000 * later).alias("seq"), F.concat(F.lit(word), F.col("l_linenumber").cast("string")).alias("snippet"), (M.micros(F.col("l_shipdate")) + later).alias("valid_from"), (1 - F.col(c)).alias("confidence"))
    ends = [(M.table(spark, sf_dir, "orders"), {"finding": "o_orderkey"}), (M.table(spark, sf_dir, "part").where("p_size > 3"), {"source": "p_partkey"})]
    first = writes.temporal_links(writes.with_ends(row("seen ", 0, "l_discount"), ends), ["finding", "source"], ["snippet"])
    rows = writes.temporal_links(writes.with_ends(row("again ", 1, "l_tax"), ends), ["finding", "source"], ["snippet"], first)
    return rows.select("finding", "source", "valid_from", "snippet", "support", "confidence", "contradictions")


@query("""WITH l AS (SELECT o_custkey AS entity, o_orderpriority AS memory, o_orderkey AS seq, epoch_us(o_orderdate) AS valid_from, 1.0 / (1 + o_orderkey % 10) AS confidence, o_orderstatus AS status FROM orders),
s AS (SELECT entity, memory, arg_min(valid_from, seq) AS valid_from, count(*) AS support, round(max(confidence), 9) AS confidence FROM l GROUP BY entity, memory),
c AS (SELECT entity, memory, arg_max(valid_from + 1, seq) AS valid_to FROM l WHERE status = 'F' GROUP BY entity, memory),
k AS (SELECT entity, memory, count(*) AS n FROM l WHERE status = 'P' GROUP BY entity, memory)
SELECT entity, memory, s.valid_from, coalesce(c.valid_to, -1) AS valid_to, support, confidence, coalesce(n, 0) AS contradictions FROM s LEFT JOIN c USING (entity, memory) LEFT JOIN k USING (entity, memory)""")
def relation_state(spark, sf_dir):
    """Relations after their closings and contradictions."""
    o = M.table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("memory"), F.col("o_orderkey").alias("seq"), M.micros(F.col("o_orderdate")).alias("valid_from"), (1.0 / (1 + F.col("o_orderkey") % 10)).alias("confidence"), F.col("o_orderstatus").alias("status"))
    keys = ["entity", "memory"]
    links = writes.temporal_links(rows.drop("status"), keys)
    links = writes.close_links(links, rows.where("status = 'F'").select(*keys, "seq", (F.col("valid_from") + 1).alias("valid_to")), keys)
    links = writes.contradict_links(links, rows.where("status = 'P'"), keys)
    return links.select(*keys, "valid_from", F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), "support", F.round("confidence", 9).alias("confidence"), "contradictions")


# Evidence, claims, reports


@query(f"""WITH {M.FINE_SQL}, {M.EDGES_SQL}, v AS (SELECT DISTINCT project_id, 'order' AS kind, subject, observed_at FROM o), x AS (SELECT DISTINCT project_id, subject, predicate, object, valid_from, valid_to, observed_at FROM o),
a AS (SELECT project_id, count(*) AS evidence FROM v GROUP BY project_id), b AS (SELECT project_id, count(*) AS links FROM x GROUP BY project_id), c AS (SELECT project_id, count(*) AS edges, (sum(support) * 2)::BIGINT AS support FROM e GROUP BY project_id)
SELECT project_id, evidence, links, edges, support FROM a JOIN b USING (project_id) JOIN c USING (project_id)""")
def claim_ingest(spark, sf_dir):
    """All claims delivered twice: support doubles, evidence and links stay."""
    rows = M.fine_observations(spark, sf_dir)
    digest = writes.evidence_hash(F.col("project_id"), F.lit("order"), F.col("subject").cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("observed_at"))
    claims = rows.withColumns({"source_kind": F.lit("order"), "source_id": F.col("subject").cast("string"), "hash": digest})
    twice = claims.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))  # both are in one task, so that they are folded before they are sent
    edges, evidence, links = writes.ingest_claims(twice)
    count = lambda df, name: df.groupBy("project_id").agg(F.count("*").alias(name))
    own = edges.groupBy("project_id").agg(F.count("*").alias("edges"), F.sum("support").alias("support"))
    return count(evidence, "evidence").join(count(links, "links"), "project_id").join(own, "project_id")


@query("""SELECT o_orderkey, sha256('{"projectId":' || o_custkey || ',"sourceKind":"order","sourceId":"' || o_orderkey || '","sourceUri":null,"rawExcerpt":"' || o_orderpriority || '","capturedAtUs":"' || epoch_us(o_orderdate) || '"}') AS hash FROM orders""")
def evidence_hashes(spark, sf_dir):
    o = M.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", writes.evidence_hash(F.col("o_custkey"), F.lit("order"), F.col("o_orderkey").cast("string"), F.lit(None).cast("string"), F.col("o_orderpriority"), M.micros(F.col("o_orderdate"))).alias("hash"))


@query(f"""WITH {M.COARSE_SQL}, s AS (SELECT project_id, subject, predicate, object, valid_from, valid_to, count(*) AS support FROM o GROUP BY ALL)
SELECT project_id, subject, predicate, object, valid_from, coalesce(valid_to, -1) AS valid_to, support FROM s""".replace("GROUP BY ALL", "GROUP BY project_id, subject, predicate, object, valid_from, valid_to"))
def backfill_ingest(spark, sf_dir):
    """An archive read twice: edges that are there keep their support."""
    rows = M.coarse_observations(spark, sf_dir)
    edges = writes.ingest_backfill(rows, writes.ingest_backfill(rows))
    return edges.select(*temporal.EDGE[:5], F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), "support")


@query("""WITH w AS (SELECT doc_id, doc_id % 5 AS project_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, project_id, CASE WHEN floor(len(w) * 1.3::DOUBLE) <= 512 THEN [trim(text, E' \\n\\t\\r')] ELSE list_transform(range(ceil(greatest(len(w) - 393, 0) / 355.0)::INT + 1), lambda k: array_to_string(w[k * 355 + 1 : k * 355 + 393], ' ')) END AS chunks FROM w),
n AS (SELECT project_id, sum(len(chunks))::BIGINT AS chunks, sum(len(chunks))::BIGINT AS has_chunk, count(*) AS cites FROM c GROUP BY project_id)
SELECT project_id, chunks, has_chunk, cites, (SELECT count(DISTINCT source) FROM documents) AS sources FROM n""")
def report_ingest(spark, sf_dir):
    """What reports bring, each delivered twice."""
    docs = M.table(spark, sf_dir, "documents")
    reports = docs.select((F.col("doc_id") % 5).alias("project_id"), F.col("doc_id").alias("session_id"), F.col("doc_id").alias("seq"), "text", "source")
    reports = reports.union(reports.withColumn("seq", F.col("seq") + 1_000_000_000))
    cited = F.array(F.struct(F.col("source").alias("url"), F.lit("t").alias("title"), F.lit("").alias("snippet")), F.struct(F.lit(" ").alias("url"), F.lit("none").alias("title"), F.lit("").alias("snippet")))
    parts = writes.report_parts(reports, T.word_windows(F.col("text")), cited)
    out = None
    for name in ("chunks", "has_chunk", "cites"):
        own = parts[name].groupBy("project_id").agg(F.count("*").alias(name))
        out = own if out is None else out.join(own, "project_id")
    return out.crossJoin(parts["sources"].agg(F.count("*").alias("sources")))  # one row


# Counts and lists


@query("SELECT event_type AS label, count(*) AS nodes, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_updated FROM events GROUP BY event_type")
def repo_status(spark, sf_dir):
    e = M.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("nodes"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_updated"))


@query("SELECT DISTINCT c_nationkey::VARCHAR AS repo_id FROM customer WHERE c_nationkey IS NOT NULL")
def known_repos(spark, sf_dir):
    return M.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("repo_id")).where("repo_id IS NOT NULL").distinct().orderBy("repo_id")


@query("SELECT p_brand AS file, count(*) AS n, string_agg(p_name || '#' || p_partkey, ',' ORDER BY p_name || '#' || p_partkey) AS functions, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS classes FROM part GROUP BY p_brand")
def file_info(spark, sf_dir):
    """Functions and classes of each file."""
    name = F.concat_ws("#", "p_name", F.col("p_partkey").cast("string"))
    return M.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("file")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(name)), ",").alias("functions"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("classes"))


_TOKENS = "(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 1.3::DOUBLE - 0.5 + 1e-9)::INT"


@query(f"SELECT lang, count(*) AS calls, sum({_TOKENS})::BIGINT AS tokens, round(sum({_TOKENS}) * 0.2 / 1e6, 9) AS cost FROM documents GROUP BY lang")
def run_cost(spark, sf_dir):
    """Tokens and dollars of embedding all texts."""
    docs = M.table(spark, sf_dir, "documents").select("lang", T.token_estimate(F.col("text")).alias("tokens"))
    out = docs.groupBy("lang").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return out.withColumn("cost", F.round(cards.embedding_cost(F.col("tokens")), 9))


# Bursts and quotas


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOURS, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, max(event_id) FILTER (ts = top) AS event_id, count(*) AS merged FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, burst) AS top FROM s) GROUP BY user_id, burst""")
def trailing_debounce(spark, sf_dir):
    """The last event of each run whose gaps stay below six hours."""
    return events.trailing_debounce(M.table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours", "event_id")


@query("""WITH w AS (SELECT event_id, count(*) OVER r AS requests, sum(value) OVER r AS tokens FROM events WINDOW r AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW))
SELECT event_id, requests, round(tokens, 6) AS tokens, requests <= 3 AND round(tokens, 6) <= 200 AS admitted FROM w""")
def quota_gate(spark, sf_dir):
    """Whether requests and tokens of the last six hours stay within a quota, for every call."""
    rows = events.quota(M.table(spark, sf_dir, "events"), "user_id", "ts", "value", 21600, 3, 200.0)
    return rows.select("event_id", "requests", "tokens", "admitted")


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS newest FROM events GROUP BY user_id HAVING epoch((SELECT max(ts) FROM events)) - epoch(max(ts)) BETWEEN 3600 AND 432000")
def burst_ready(spark, sf_dir):
    """Users whose newest event is between an hour and five days before the last of all."""
    e = M.table(spark, sf_dir, "events")
    return events.ready_bursts(e, "user_id", "ts", e.agg(F.max("ts").alias("now")), 3600, 432000).select("user_id", F.date_format("newest", "yyyy-MM-dd'T'HH:mm:ss").alias("newest"))


# Texts


@query("""SELECT doc_id, sha256(concat_ws(chr(10), 'domain: research', 'source: ' || source,
  CASE WHEN contains(s, chr(10)) THEN 'excerpt: |-' || chr(10) || '  ' || replace(s, chr(10), chr(10) || '  ') WHEN s <> '' THEN 'excerpt: ' || s END,
  'labels:' || chr(10) || '  - ' || lang || chr(10) || '  - doc')) AS card,
  sha256(replace(CASE WHEN length(text) > 24000 THEN substr(text, 1, 24000) || '...[TRUNCATED]' ELSE text END, chr(10), ' ')) AS embedded
FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents)""")
def card_texts(spark, sf_dir):
    """Cards for a reranker and texts to embed, of all documents."""
    d = M.table(spark, sf_dir, "documents")
    card = cards.yaml_card([("domain", F.lit("research")), ("nothing", F.lit(None)), ("blank", F.lit("  ")), ("source", F.col("source")), ("excerpt", F.col("text"))], [("labels", F.array("lang", F.lit(" doc "), F.lit(""))), ("none", F.array(F.lit(" ")))])
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select("doc_id", digest(card).alias("card"), digest(cards.embed_input(F.col("text"))).alias("embedded"))


@query("""SELECT p_partkey, 'Name: ' || p_name || chr(10) || 'Type: ' || p_type || CASE WHEN p_size % 3 > 0 THEN chr(10) || 'Observations:' || chr(10) || '- ' || p_brand || CASE WHEN p_size % 3 > 1 THEN chr(10) || '- ' || p_size ELSE '' END ELSE '' END AS memory,
  CASE WHEN p_size % 3 = 0 THEN 'Context: File ' || p_brand || ' > Class ' || p_type WHEN p_size % 3 = 1 THEN 'Context: File: ' || p_brand || ' > Class: ' || p_type || ' > Method: ' || p_name ELSE 'Context: File: ' || p_brand || ' > Method: ' || p_name END || chr(10) || chr(10) || floor(p_retailprice)::INT AS code,
  'about ' || p_name || ' and {other}, ' || p_size AS filled FROM part""")
def embed_texts(spark, sf_dir):
    """Texts of memory entities and code pieces, and filled templates."""
    p = M.table(spark, sf_dir, "part")
    kind = F.col("p_size") % 3
    seen = F.slice(F.array("p_brand", F.col("p_size").cast("string")), 1, kind)
    code = cards.code_context(F.col("p_brand"), F.when(kind < 2, F.col("p_type")), F.when(kind > 0, F.col("p_name")), F.floor("p_retailprice").cast("int").cast("string"))
    filled = cards.filled(F.lit("about {name} and {other}, {size}"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string")))
    return p.select("p_partkey", cards.memory_text(F.col("p_name"), F.col("p_type"), seen).alias("memory"), code.alias("code"), filled.alias("filled"))
