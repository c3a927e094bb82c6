"""Composite searches over the driver's tables, for all questions of a table at once."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kairoscope.operators import graph, retrieval, search, temporal
from kairoscope.plans import mapping as M
from kairoscope.plans.catalog import query
from kairoscope.plans.registry import BM25_SQL, ppr_sql, walk_sql

# Nodes and edges


def _nodes(spark, sf_dir):
    """Customers by name in the project of their nation; even ones have an account of the same name."""
    c = M.table(spark, sf_dir, "customer")
    node = lambda kind, mark: c.select(F.col("c_nationkey").alias("project_id"), F.lit(kind).alias("kind"), F.col("c_name").alias("name"), F.concat(F.lit(mark), F.col("c_custkey").cast("string")).alias("node"), "c_custkey")
    return node("customer", "s").union(node("account", "a").where("c_custkey % 2 = 0")).drop("c_custkey")


def _edges(spark, sf_dir):
    rows = temporal.upsert_edges(M.fine_observations(spark, sf_dir)).withColumn("contradictions", F.lit(0))
    return rows.withColumns({"subject": F.concat(F.lit("s"), F.col("subject").cast("string")), "object": F.concat(F.lit("o"), F.col("object").cast("string"))})


_NODES_SQL = """nodes AS (SELECT c_nationkey AS project_id, 'customer' AS kind, c_name AS name, 's' || c_custkey AS node FROM customer
UNION ALL SELECT c_nationkey, 'account', c_name, 'a' || c_custkey FROM customer WHERE c_custkey % 2 = 0)"""
_RESOLVED_SQL = """asked AS (SELECT DISTINCT query_id, project_id, lower(regexp_replace(regexp_replace(name, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS n, kind AS asked FROM requests),
found AS (SELECT query_id, a.project_id, n, asked, node, asked IS NULL OR kind = asked AS exact FROM asked a JOIN nodes ON nodes.project_id = a.project_id AND lower(name) = n),
seeds AS (SELECT DISTINCT query_id, project_id, node FROM (SELECT *, max(exact::INT) OVER (PARTITION BY query_id, project_id, n, asked) AS most FROM found) WHERE exact::INT = most)"""


_LIVE_SQL = f"""l AS (SELECT project_id, 's' || subject AS subject, predicate, 'o' || object AS object, valid_from, valid_to, confidence, relevance,
  greatest(1e-9, confidence * relevance * pow(2, -greatest(valid_from - {M.NOW_US}, {M.NOW_US} - coalesce(valid_to, {M.NOW_US}), 0) / (24 * 3.6e9))) AS weight FROM e WHERE relevance >= 0.05),
b AS MATERIALIZED (SELECT project_id, node, next, max(w) AS w FROM (SELECT project_id, subject AS node, object AS next, round(weight, 12) AS w FROM l UNION ALL SELECT project_id, object, subject, round(weight, 12) FROM l) GROUP BY ALL)"""


def reach_sql(most: int) -> str:
    """From seeds to h2: the nodes within two hops, the budget's heaviest edges first."""
    hop = lambda n: f"""c{n} AS (SELECT query_id, project_id, next AS node, max(w) AS w FROM h{n - 1} JOIN b USING (project_id, node) WHERE (query_id, project_id, next) NOT IN (SELECT (query_id, project_id, node) FROM h{n - 1}) GROUP BY ALL),
h{n} AS MATERIALIZED (SELECT * FROM h{n - 1} UNION ALL SELECT query_id, project_id, node FROM (SELECT *, row_number() OVER (PARTITION BY query_id, project_id ORDER BY w DESC, node) AS place FROM c{n}) JOIN (SELECT query_id, project_id, count(*) AS have FROM h{n - 1} GROUP BY ALL) USING (query_id, project_id) WHERE place + have <= {most})"""  # noqa: E731
    return f"h0 AS (SELECT DISTINCT query_id, project_id, node FROM seeds), {hop(1)}, {hop(2)}"


#: From seeds to h2: all nodes within two hops.
_WHOLE_REACH_SQL = """h1 AS (SELECT query_id, project_id, node FROM seeds UNION SELECT query_id, project_id, next FROM seeds JOIN b USING (project_id, node)),
h2 AS MATERIALIZED (SELECT query_id, project_id, node FROM h1 UNION SELECT query_id, project_id, next FROM h1 JOIN b USING (project_id, node))"""


def _retrieved_sql(max_edges: int, whole: bool = False) -> str:
    """From seeds (query_id, project_id, node) to the best edges of each question, as search.temporal_retrieve finds them; ``whole``: without a budget, and by all rounds."""
    part = "query_id || '|' || project_id"
    return f"""{M.FINE_SQL}, {M.EDGES_SQL}, {_LIVE_SQL}, {_WHOLE_REACH_SQL if whole else reach_sql(search.node_budget(max_edges))},
n AS (SELECT a.query_id, l.* FROM l JOIN h2 a ON a.project_id = l.project_id AND a.node = subject JOIN h2 z ON z.query_id = a.query_id AND z.project_id = l.project_id AND z.node = object),
t AS (SELECT *, {part} AS part, sum(weight) OVER (PARTITION BY query_id, project_id, subject) AS total FROM n),
{walk_sql("SELECT part, subject AS src, object AS dst, weight FROM t", f"SELECT {part} AS part, node FROM seeds", tolerance=0 if whole else graph.TOLERANCE)},
sc AS (SELECT t.*, round(greatest(a.rank, z.rank) * weight / total, 9) AS score FROM t JOIN rr a ON a.part = t.part AND a.node = subject JOIN rr z ON z.part = t.part AND z.node = object),
found_edges AS (SELECT * EXCLUDE (part) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, subject, object, predicate, valid_from, valid_to NULLS LAST) AS rank FROM sc) WHERE rank <= {max_edges})"""


@query(f"""WITH {_NODES_SQL}, requests AS (SELECT c_custkey AS query_id, c_nationkey AS project_id, '  ' || upper(c_name) || ' ' AS name, CASE c_custkey % 4 WHEN 0 THEN 'customer' WHEN 1 THEN 'nobody' WHEN 2 THEN 'account' END AS kind FROM customer),
{_RESOLVED_SQL} SELECT query_id, project_id, node FROM seeds""")
def seed_resolution(spark, sf_dir):
    """Names with a kind, with one that nothing has, and with none."""
    c = M.table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    kind = F.when(k == 0, "customer").when(k == 1, "nobody").when(k == 2, "account")
    requests = c.select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").alias("project_id"), F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("name"), kind.alias("kind"))
    return search.resolve_seeds(requests, _nodes(spark, sf_dir))


@query(f"""WITH seeds AS (SELECT c_nationkey AS query_id, c_nationkey AS project_id, 's' || min(c_custkey) AS node FROM customer GROUP BY c_nationkey),
{_retrieved_sql(10, whole=True)} SELECT query_id, rank, project_id, subject, predicate, object, valid_from, coalesce(valid_to, -1) AS valid_to, round(score, 6) AS score FROM found_edges""")
def temporal_retrieve(spark, sf_dir):
    """The best edges around the first customer of every project, of all nodes within two hops."""
    c = M.table(spark, sf_dir, "customer")
    first = c.groupBy(F.col("c_nationkey").alias("project_id")).agg(F.min("c_custkey").alias("c"))
    seeds = first.select(F.col("project_id").alias("query_id"), "project_id", F.concat(F.lit("s"), F.col("c").cast("string")).alias("node"))
    rows = search.temporal_retrieve(_edges(spark, sf_dir), seeds, M.NOW_US, max_nodes=None, tolerance=0)
    return rows.select("query_id", "rank", *temporal.EDGE[:5], F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), F.round("score", 6).alias("score"))


@query(f"""WITH {M.FINE_SQL}, {M.EDGES_SQL}, {_LIVE_SQL}, seeds AS (SELECT c_custkey AS query_id, c_nationkey AS project_id, 's' || c_custkey AS node FROM customer), {reach_sql(32)}
SELECT query_id, project_id, node FROM h2""")
def temporal_neighborhood_capped(spark, sf_dir):
    """For every customer the 32 nodes of its project that its heaviest edges lead to within two hops."""
    c = M.table(spark, sf_dir, "customer")
    seeds = c.select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").alias("project_id"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("node"))
    live = temporal.with_weight(_edges(spark, sf_dir), M.NOW_US, search.HALF_LIFE_HOURS, search.LEAST_RELEVANCE)
    return graph.capped_reach(live.select("project_id", F.col("subject").alias("src"), F.col("object").alias("dst"), "weight"), seeds, 2, 32)


# Hydration


@query("""WITH l AS (SELECT DISTINCT o_custkey AS subject, o_orderpriority AS predicate, lpad(o_orderkey::VARCHAR, 12, '0') AS id, o_orderstatus AS status, o_totalprice AS price FROM orders)
SELECT subject, predicate, count(*) AS linked, coalesce(string_agg(id || '=' || status, ',' ORDER BY id) FILTER (status <> 'P'), '') AS evidence FROM l GROUP BY subject, predicate""")
def evidence_hydration(spark, sf_dir):
    """Evidence of each customer and priority in order, without what is no longer stored."""
    o = M.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("evidence_id"), F.col("o_orderstatus").alias("status"))
    lists = search.evidence_lists(o, ["subject", "predicate"])
    rows = search.hydrate(lists, ["subject", "predicate"], "evidence_ids", o.where("status <> 'P'").select("evidence_id", "status"), "evidence_id", ["status"])
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["evidence_id"], e["status"])), ",")
    return rows.select("subject", "predicate", F.size("evidence_ids").cast("long").alias("linked"), F.coalesce(shown, F.lit("")).alias("evidence"))


def _ranked_turns(spark, sf_dir):
    """For every turn a ranked result of question conv_id % 5, with evidence of itself, the next turn and others that do not count."""
    c = M.table(spark, sf_dir, "conversations")
    at = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + n).cast("string"))
    one = lambda kind, i: F.struct(F.lit(kind).alias("source_kind"), i.alias("source_id"))
    order = Window.partitionBy(F.col("conv_id") % 5).orderBy(F.desc("turn"), "conv_id")
    return c.select((F.col("conv_id") % 5).alias("query_id"), F.row_number().over(order).alias("rank"), (1.0 / (1 + F.col("turn"))).alias("confidence"), F.lit(0.5).alias("relevance"), F.array(one("web", at(0)), one("conversation_turn", F.lit("no turn")), one("conversation_turn", at(1)), one("conversation_turn", at(0))).alias("evidence"))


_HYDRATED_SQL = """k AS (SELECT conv_id % 5 AS query_id, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY turn DESC, conv_id) AS rank, 0.5 / (1 + turn) AS score, conv_id, turn FROM conversations),
x AS (SELECT query_id, rank, 2 AS pos, score, conv_id, turn + 1 AS turn FROM k UNION ALL SELECT query_id, rank, 3, score, conv_id, turn FROM k),
y AS (SELECT x.*, role, row_number() OVER (PARTITION BY query_id, conv_id, turn ORDER BY rank, pos) AS n FROM x JOIN conversations USING (conv_id, turn) WHERE role = 'user'),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS place FROM y WHERE n = 1)"""


@query(f"WITH {_HYDRATED_SQL} SELECT query_id, place::INT AS place, conv_id::VARCHAR AS session_id, turn::INT AS turn_index, round(score, 9) AS score FROM z WHERE place <= 8")
def conversation_hydration(spark, sf_dir):
    rows = search.hydrate_turns(_ranked_turns(spark, sf_dir), M.turns(spark, sf_dir), 8, role="user")
    return rows.select("query_id", "place", "session_id", "turn_index", F.round("score", 9).alias("score"))


@query(f"""WITH {_HYDRATED_SQL}, q AS (SELECT unnest(range(8)) AS query_id),
a AS (SELECT query_id, place, conv_id, turn, 'temporal_graph' AS mode, 0 AS tier FROM z WHERE query_id < 3 AND place <= 8
UNION ALL SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY turn DESC, conv_id), conv_id, turn, 'dense_only', 1 FROM (SELECT conv_id % 7 AS query_id, conv_id, turn FROM conversations) WHERE query_id BETWEEN 2 AND 4
UNION ALL SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY conv_id, turn), conv_id, turn, 'text_fallback', 2 FROM conversations, q WHERE contains(lower(text), 'the')),
m AS (SELECT query_id, min(tier) AS tier FROM a GROUP BY query_id)
SELECT query_id, place::INT AS place, conv_id::VARCHAR AS session_id, turn::INT AS turn_index, mode FROM a JOIN m USING (query_id, tier) WHERE place <= 6""")
def conversation_search(spark, sf_dir):
    """Three questions have temporal hits, two more dense ones, the other three only text."""
    turns = M.turns(spark, sf_dir)
    graph_hits = search.hydrate_turns(_ranked_turns(spark, sf_dir), turns, 8, role="user").where("query_id < 3")
    dense = turns.withColumn("query_id", F.col("session_id").cast("long") % 7).where("query_id BETWEEN 2 AND 4").withColumn("score", F.lit(0.5))
    dense = dense.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("turn_index"), F.col("session_id").cast("long"))))
    order = [F.col("session_id").cast("long"), F.col("turn_index")]
    found = turns.where(F.contains(F.lower("content"), F.lit("the"))).orderBy(*order).limit(6)  # so that the window has six rows
    found = found.withColumns({"score": F.lit(1.0), "place": F.row_number().over(Window.orderBy(*order))})
    questions = spark.range(8).withColumnRenamed("id", "query_id")
    text = found.crossJoin(F.broadcast(questions))  # eight rows
    rows = search.conversation_tiers(graph_hits, dense, text, 6)
    return rows.select("query_id", "place", "session_id", "turn_index", "mode")


# Research


def _research(spark, sf_dir):
    """BM25 hits of every benchmark item, whose projects and entities are those of two customers; the last item has no hits."""
    bench = M.table(spark, sf_dir, "benchmark")
    asked = bench.where("item_id % 8 <> 7")
    c = M.table(spark, sf_dir, "customer")
    people = c.select((F.col("c_custkey") % 50).alias("m"), F.col("c_nationkey").alias("project_id"), F.struct(F.col("c_name").alias("name"), F.lit("customer").alias("kind")).alias("e")).where("project_id % 6 <> 5")
    people = people.groupBy("m", "project_id").agg(F.array_sort(F.collect_list("e")).alias("entities"))
    first = people.groupBy("m").agg(F.min(F.struct("project_id", "entities")).alias("p")).select("m", "p.*")
    hits = retrieval.bm25(M.table(spark, sf_dir, "documents"), asked, 30)
    hits = hits.join(F.broadcast(first), F.col("doc_id") % 50 == F.col("m"))  # at most fifty rows
    hits = hits.select(F.col("item_id").alias("query_id"), "rank", "score", "project_id", "entities")
    edges = _edges(spark, sf_dir)
    links = edges.select(*temporal.EDGE, F.concat_ws(":", "subject", F.col("valid_from").cast("string")).alias("evidence_id"))
    evidence = edges.select(F.concat_ws(":", "subject", F.col("valid_from").cast("string")).alias("evidence_id")).distinct()
    evidence = evidence.select("evidence_id", F.lit("order").alias("source_kind"), F.concat(F.lit("doc "), F.col("evidence_id")).alias("source_id"), F.lit("seen").alias("excerpt"))
    return search.research(hits, bench.select(F.col("item_id").alias("query_id")), _nodes(spark, sf_dir), edges, links, evidence, M.NOW_US, 5)


_RESEARCH_SQL = f"""{BM25_SQL}, {_NODES_SQL}, pp AS (SELECT c_custkey % 50 AS m, min(c_nationkey) AS project_id FROM customer WHERE c_nationkey % 6 <> 5 GROUP BY m),
hits AS (SELECT item_id AS query_id, rank, score, m, project_id FROM ranked JOIN pp ON doc_id % 50 = m WHERE rank <= 30 AND item_id % 8 <> 7),
pr AS (SELECT query_id, project_id, round(sum(CASE WHEN score = 0 THEN 1 ELSE score END), 9) AS total, min(rank) AS first FROM hits GROUP BY query_id, project_id),
dp AS (SELECT query_id, project_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, first) AS n FROM pr) WHERE n = 1),
en AS (SELECT query_id, rank, CASE WHEN score = 0 THEN 1 ELSE score END AS s, c_name, row_number() OVER (PARTITION BY query_id, rank, hits.m ORDER BY c_name) AS pos FROM hits JOIN customer ON c_custkey % 50 = hits.m AND c_nationkey = hits.project_id),
sn AS (SELECT query_id, lower(c_name) AS key, round(sum(s / pos), 9) AS weight, min(rank) AS first, any_value(c_name) AS name FROM en GROUP BY query_id, lower(c_name)),
s5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, first, key) AS place FROM sn) WHERE place <= 5),
requests AS (SELECT query_id, project_id, name, 'customer' AS kind FROM s5 JOIN dp USING (query_id)), {_RESOLVED_SQL}, {_retrieved_sql(60)}"""


@query(f"WITH {_RESEARCH_SQL} SELECT query_id, rank, 'doc ' || subject || ':' || valid_from AS source_id, 'order' AS source_kind, round(confidence * relevance, 9) AS score, 'temporal_graph' AS mode FROM found_edges WHERE rank <= 5")
def research_search(spark, sf_dir):
    """Research hits of every benchmark item by the temporal graph."""
    rows = _research(spark, sf_dir)[0]
    return rows.select("query_id", "rank", "source_id", "source_kind", F.round("score", 9).alias("score"), F.col("retrieval_provenance.mode").alias("mode"))


@query(f"""WITH {_RESEARCH_SQL} SELECT item_id AS query_id, CASE WHEN item_id NOT IN (SELECT query_id FROM hits) THEN 'no_baseline' WHEN item_id NOT IN (SELECT query_id FROM s5) THEN 'no_temporal_seeds'
WHEN item_id NOT IN (SELECT query_id FROM found_edges) THEN 'empty_temporal_result' ELSE 'temporal_graph' END AS status FROM benchmark""")
def research_status(spark, sf_dir):
    """Why a question has research hits or none."""
    return _research(spark, sf_dir)[1]


# Code and all modules


_CODE_SQL = f"""{M.STRUCTURE_SQL}, bl AS (SELECT n_regionkey AS query_id, 'n' || n_nationkey AS node, 1.0 / (1 + n_nationkey) AS score FROM nation UNION ALL SELECT 9, 'zz' || n_nationkey, 1.0 / (1 + n_nationkey) FROM nation),
bs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM bl), bw AS (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g),
sq AS (SELECT query_id, node FROM bs WHERE node IN (SELECT src FROM bw)), bn AS (SELECT DISTINCT src AS node, dst AS next FROM bw),
c1 AS (SELECT query_id, node FROM sq UNION SELECT query_id, next FROM sq JOIN bn USING (node)), c2 AS (SELECT query_id, node FROM c1 UNION SELECT query_id, next FROM c1 JOIN bn USING (node)),
{ppr_sql("SELECT a.query_id || '|' || src AS src, a.query_id || '|' || dst AS dst, weight FROM bw JOIN c2 a ON a.node = src JOIN c2 z ON z.node = dst AND z.query_id = a.query_id", "SELECT query_id || '|' || node AS node, query_id AS part FROM sq", 0.2, False, 12)},
pj AS (SELECT c2.query_id, c2.node, coalesce(bs.score, 0) AS baseline, rank_ FROM c2 JOIN (SELECT node AS k, rank AS rank_ FROM r12) ON k = c2.query_id || '|' || c2.node LEFT JOIN bs ON bs.query_id = c2.query_id AND bs.node = c2.node),
cb AS (SELECT query_id, node, baseline, round(0.6 * baseline / max(baseline) OVER w + 0.4 * rank_ / max(rank_) OVER w, 9) AS combined FROM pj WINDOW w AS (PARTITION BY query_id)),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, baseline DESC, node) AS rank FROM cb)"""


@query(f"""WITH {_CODE_SQL} SELECT 'safe' AS policy, query_id, node AS source_id, round(score, 6) AS score, rank, 'semantic_only' AS mode FROM bs WHERE rank <= 4
UNION ALL SELECT 'graph_reranked', query_id, node, round(combined, 6), rank, 'semantic_plus_graph_rerank' FROM cr WHERE rank <= 4
UNION ALL SELECT 'graph_reranked', query_id, node, round(score, 6), rank, 'semantic_only_fallback' FROM bs WHERE rank <= 4 AND query_id NOT IN (SELECT query_id FROM sq)""")
def code_search_policies(spark, sf_dir):
    """Hits of five questions by both policies, and of one whose hits are not in the graph."""
    n = M.table(spark, sf_dir, "nation")
    hit = lambda q, mark: n.select(q.cast("long").alias("query_id"), F.concat(F.lit(mark), F.col("n_nationkey").cast("string")).alias("node"), (1.0 / (1 + F.col("n_nationkey"))).alias("score"))
    rows = hit(F.col("n_regionkey"), "n").union(hit(F.lit(9), "zz"))
    baseline = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node")))
    edges = M.structure(spark, sf_dir).select("src", "dst", "weight")
    out = None
    for policy in ("safe", "graph_reranked"):
        found = search.code_search(baseline, edges, 4, policy).select(F.lit(policy).alias("policy"), "query_id", "source_id", F.round("score", 6).alias("score"), "rank", "mode")
        out = found if out is None else out.union(found)
    return out


@query(f"""WITH {BM25_SQL}, {M.TURNS_SQL}, w AS (SELECT item_id AS query_id, 'web' AS module, doc_id::VARCHAR AS source_id, score, true AS temporal_applied FROM ranked WHERE rank <= 10),
c AS (SELECT item_id AS query_id, 'conversation' AS module, session_id || ':' || turn_index AS source_id, 1.0 AS score, false AS temporal_applied FROM benchmark JOIN t ON turn_index = item_id % 3 AND session_id::INT % 11 = item_id % 11),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, temporal_applied DESC, module, source_id) AS rank FROM (SELECT * FROM w UNION ALL SELECT * FROM c))
SELECT query_id, module, source_id, round(score, 6) AS score, temporal_applied, rank FROM u WHERE rank <= 12 UNION ALL SELECT item_id, 'code', 'code pipeline unavailable', NULL, NULL, 0 FROM benchmark""")
def unified_search(spark, sf_dir):
    """One list for every benchmark item from two modules; the third is unavailable, which its error rows (rank 0) say."""
    bench = M.table(spark, sf_dir, "benchmark")
    web = retrieval.bm25(M.table(spark, sf_dir, "documents"), bench, 10).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("source_id"), "score", F.lit(True).alias("temporal_applied"))
    asked = bench.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).cast("int").alias("turn_index"), (F.col("item_id") % 11).alias("s"))
    turns = M.turns(spark, sf_dir).withColumn("s", F.col("session_id").cast("int") % 11)
    talk = turns.join(asked, ["turn_index", "s"]).select("query_id", F.concat_ws(":", "session_id", F.col("turn_index").cast("string")).alias("source_id"), F.lit(1.0).alias("score"), F.lit(False).alias("temporal_applied"))
    rows, errors = search.all_memory({"web": web, "conversation": talk, "code": None}, bench.select(F.col("item_id").alias("query_id")), 12, [" Web", "conversation", "CODE", "web"])
    gone = errors.select("query_id", "module", F.col("message").alias("source_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("temporal_applied"), F.lit(0).alias("rank"))
    return rows.withColumn("score", F.round("score", 6)).unionByName(gone)
