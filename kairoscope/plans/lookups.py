"""Lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoscope.functions import interval
from kairoscope.operators import conversation, lookups
from kairoscope.plans import mapping as M
from kairoscope.plans.catalog import query
from kairoscope.plans.registry import _EACH, BM25_SQL


@query("SELECT c_custkey::VARCHAR AS node, c_nationkey::VARCHAR AS repo_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND c_custkey % 2 = 0")
def label_property_scan(spark, sf_dir):
    """Customers as nodes with two labels and two properties."""
    c = M.table(spark, sf_dir, "customer")
    labels = F.array(F.lit("Customer"), F.initcap("c_mktsegment"))
    properties = F.create_map(F.lit("even"), (F.col("c_custkey") % 2 == 0).cast("string"), F.lit("solvent"), (F.col("c_acctbal") >= 0).cast("string"))
    nodes = c.select(F.col("c_custkey").cast("string").alias("node"), F.col("c_nationkey").cast("string").alias("repo_id"), labels.alias("labels"), properties.alias("properties"))
    return lookups.label_scan(nodes, ["Customer", "Building"], {"even": "true", "solvent": "true"}).select("node", "repo_id")


@query(f"WITH {M.TURNS_SQL}, w AS (SELECT session_id, turn_index, CASE turn_index % 3 WHEN 0 THEN project_id WHEN 1 THEN 'p9' END AS project FROM t UNION ALL SELECT session_id, turn_index + 1000, NULL FROM t) SELECT w.session_id, w.turn_index, role, content, project_id FROM w JOIN t ON t.session_id = w.session_id AND t.turn_index = w.turn_index AND (project IS NULL OR project = project_id)")
def turn_lookup(spark, sf_dir):
    """Every turn by its place: with its project, with another one, and with none."""
    t = M.turns(spark, sf_dir)
    third = F.col("turn_index") % 3
    wanted = t.select("session_id", "turn_index", F.when(third == 0, F.col("project_id")).when(third == 1, "p9").alias("project_id"))
    far = t.select("session_id", (F.col("turn_index") + 1000).alias("turn_index"), F.lit(None).cast("string"))
    return lookups.turns_at(t, wanted.union(far)).select("session_id", "turn_index", "role", "content", "project_id")


@query(f"""WITH {_EACH}, {BM25_SQL}
SELECT item_id, vec_id AS doc_id, round(score, 6) AS score, rank::INT AS rank, 'dense' AS mode FROM near WHERE rank <= 5 AND item_id % 4 <> 0
UNION ALL SELECT item_id, doc_id, round(score, 6), rank::INT, 'text' FROM ranked WHERE rank <= 5 AND (item_id % 4 = 0 OR item_id NOT IN (SELECT vec_id FROM embeddings))""")
def semantic_or_text(spark, sf_dir):
    """Every benchmark item; a fourth of them have no valid vector."""
    e, bench = M.table(spark, sf_dir, "embeddings"), M.table(spark, sf_dir, "benchmark")
    vector = F.when(F.col("item_id") % 4 != 0, F.col("embedding"))
    queries = bench.join(e, F.col("item_id") == F.col("vec_id"), "left").select("item_id", "text", vector.alias("embedding"))
    rows = lookups.semantic_or_text(e.withColumnRenamed("vec_id", "doc_id"), M.table(spark, sf_dir, "documents"), queries, 5, "item_id", "doc_id")
    return rows.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank", "mode")


@query("SELECT event_id, epoch_us(ts) AS us FROM events")
def strict_micros(spark, sf_dir):
    """The moment of every event from its ISO text."""
    e = M.table(spark, sf_dir, "events")
    return e.select("event_id", interval.micros_of_text_strict(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("us"))


@query(f"WITH {BM25_SQL}, x AS (SELECT DISTINCT item_id FROM ranked WHERE rank <= 10 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)), a AS (SELECT DISTINCT item_id FROM ranked WHERE rank <= 20) SELECT item_id, (item_id IN (SELECT item_id FROM x))::INT AS temporal_consistent FROM a")
def temporal_consistency(spark, sf_dir):
    """Whether the ten best documents of an item have one that is labelled bad."""
    from kairoscope.operators import retrieval

    ranked = retrieval.bm25(M.table(spark, sf_dir, "documents"), M.table(spark, sf_dir, "benchmark"), 20)
    bad = M.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return lookups.temporal_consistency(ranked, ranked.join(bad, "doc_id", "left_semi"), "item_id", "doc_id")


@query("""WITH f AS (SELECT p_brand AS path, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS functions FROM part GROUP BY p_brand), c AS (SELECT p_brand AS path, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS classes FROM part WHERE p_size > 10 GROUP BY p_brand),
i AS (SELECT 'Brand#' || s_nationkey AS path, string_agg(DISTINCT s_suppkey::VARCHAR, ',' ORDER BY s_suppkey::VARCHAR) AS imports FROM supplier GROUP BY s_nationkey)
SELECT path, coalesce(functions, '') AS functions, coalesce(classes, '') AS classes, coalesce(imports, '') AS imports FROM f FULL JOIN c USING (path) FULL JOIN i USING (path)""")
def file_parts(spark, sf_dir):
    """Brands as files: names are functions, types classes, the suppliers of a nation imports."""
    p, s = M.table(spark, sf_dir, "part"), M.table(spark, sf_dir, "supplier")
    rows = lambda df, path, name: df.select(F.lit("r").alias("repo_id"), path.alias("path"), name.alias("name"))
    found = lookups.file_parts(rows(p, F.col("p_brand"), F.col("p_name")), rows(p.where("p_size > 10"), F.col("p_brand"), F.col("p_type")), rows(s, F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")), F.col("s_suppkey").cast("string")))
    return found.select("path", *[F.array_join(c, ",").alias(c) for c in ("functions", "classes", "imports")])


# Turns


@query(f"""WITH {M.DELIVERIES_SQL}, k AS (SELECT session_id, sha256(session_id || ':' || turn_index) AS turn, turn_index, min(ingested_at) AS valid_from, count(*) AS support, max(CASE ingested_at WHEN 2 THEN 0.9 ELSE 0.8 END)::DOUBLE AS confidence FROM d GROUP BY session_id, turn_index)
SELECT 'HAS_TURN' AS type, session_id AS source, turn AS target, turn_index AS place, valid_from, support, confidence FROM k UNION ALL SELECT 'PART_OF', turn, session_id, -1, valid_from, support, confidence FROM k""")
def turn_links(spark, sf_dir):
    """Turns that are delivered twice, the second time with more confidence."""
    d = M.deliveries(spark, sf_dir)
    rows = d.select("session_id", "turn_index", F.col("ingested_at").alias("seq"), F.col("ingested_at").alias("valid_from"), F.when(F.col("ingested_at") == 2, 0.9).otherwise(0.8).alias("confidence"))
    first = conversation.turn_links(rows.where("seq = 1"))
    out = conversation.turn_links(rows.where("seq = 2"), first)
    return out.select("type", "source", "target", F.coalesce("place", F.lit(-1)).alias("place"), "valid_from", "support", "confidence")


@query(f"WITH {M.TURNS_SQL}, x AS (SELECT *, unnest(list_filter(string_split(content, ' ')[1:3], lambda n: n <> '')) AS name FROM t) SELECT project_id, session_id || ':' || turn_index AS subject, 'MENTIONS' AS predicate, name AS object, count(*) AS n, min(length(content[1:500]))::INT AS excerpt FROM x GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY project_id, session_id, turn_index, name"))
def shadow_claims(spark, sf_dir):
    """Every turn mentions its first three words."""
    t = M.turns(spark, sf_dir)
    names = F.transform(F.slice(F.split("content", " "), 1, 3), lambda n: F.struct(n.alias("name"), F.lit("word").alias("type")))
    rows = conversation.shadow_claims(t.select("project_id", "session_id", "turn_index", "content", F.col("ingested_at").alias("captured_us"), names.alias("entities")))
    return rows.groupBy("project_id", "subject", "predicate", "object").agg(F.count("*").alias("n"), F.min(F.length("excerpt")).alias("excerpt"))
