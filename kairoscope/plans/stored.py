"""Queries over stored indexes and sinks, each built from the driver's tables in the scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoscope.operators import paths, retrieval, temporal
from kairoscope.plans import mapping as M
from kairoscope.plans.catalog import query
from kairoscope.plans.registry import ASKED_SQL, BM25_SQL
from kairoscope.session import materialise, scratch_path, tasks
from kairoscope.sources import git_log
from kairoscope.storage import keyed_table, ledger, maintenance, snapshot, text_index, vector_index

# Vector index


def _index(spark, sf_dir):
    """Two thirds of the vectors at first, the others as an append."""
    e = M.table(spark, sf_dir, "embeddings")
    index = vector_index.VectorIndex.create(e.where("vec_id % 3 <> 0"), scratch_path(spark, "vectors"))
    index.append(e.where("vec_id % 3 = 0"))
    return index


def _asked(spark, sf_dir):
    return M.table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {ASKED_SQL} SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM dense_ranked WHERE rank <= 10")
def vector_index_exact(spark, sf_dir):
    """The exact mode of the index."""
    found = _index(spark, sf_dir).search(_asked(spark, sf_dir), 10, exact=True)
    return found.select("query_id", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("SELECT count(*) FILTER (vec_id % 20 = 0) AS questions, count(*) FILTER (vec_id % 20 = 0) * least(10, count(*)) AS wanted, true AS recall_reached, count(*) AS indexed FROM embeddings")
def vector_index_recall(spark, sf_dir):
    """The share of the exact ten best that the approximate mode finds, over all questions, and whether it is 0.9 at least."""
    index, asked = _index(spark, sf_dir), _asked(spark, sf_dir)
    found = materialise(index.search(asked, 10), "found")
    truth = retrieval.dense_topk_each(M.table(spark, sf_dir, "embeddings"), asked, 10, "query_id", "vec_id").withColumnRenamed("vec_id", "key")
    each = vector_index.recall(found, truth, "query_id")
    total = each.agg(F.count("*").alias("questions"), F.sum("wanted").alias("wanted"), (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("recall_reached"))
    return total.crossJoin(index.rows().agg(F.count("*").alias("indexed")))  # one row each


# Full-text index


def _text_index(spark, sf_dir):
    """Documents in three appends."""
    docs = M.table(spark, sf_dir, "documents")
    index = text_index.TextIndex(spark, scratch_path(spark, "texts"))
    for part in range(3):
        index.append(docs.where(F.pmod("doc_id", F.lit(3)) == part))
    return index


@query(f"WITH {BM25_SQL} SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM ranked WHERE rank <= 5")
def text_index_topk(spark, sf_dir):
    """The five best documents of every benchmark item, from the index."""
    found, _ = _text_index(spark, sf_dir).topk(M.table(spark, sf_dir, "benchmark"), 5, "item_id")
    return found.select("item_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {BM25_SQL} SELECT item_id, sum(df)::BIGINT AS postings, true AS fewer_read FROM terms JOIN df USING (term) GROUP BY item_id")
def text_index_reads(spark, sf_dir):
    """The postings of every item's terms, and whether the search read fewer over all items."""
    _, counts = _text_index(spark, sf_dir).topk(M.table(spark, sf_dir, "benchmark"), 5, "item_id")
    counts = materialise(counts, "counts")
    total = counts.agg((F.sum("read") < F.sum("postings")).alias("fewer_read"))
    return counts.select("item_id", "postings").crossJoin(total)  # one row


# Keyed tables


def _state(spark, sf_dir, batches):
    """The last event of each user, merged in batches; purchases delete."""
    e = M.table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "purchase", "delete").otherwise("update").alias("op"))
    table = keyed_table.KeyedTable(spark, scratch_path(spark, "state"), ["user_id"], "event_id", buckets=8)
    for n in range(batches):
        table.merge(e.where(F.pmod("event_id", F.lit(batches)) == n), n)
        table.merge(e, n)  # delivered again under its number
    table.vacuum()
    return table


@query("SELECT user_id, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'purchase'")
def keyed_state(spark, sf_dir):
    return _state(spark, sf_dir, 3).table().select("user_id", "event_id", F.round("value", 6).alias("value"))


#: Name, key and changes of each of the five tables; ``late`` changes come with the second batch.
_FIVE = {
    "node": ("c_custkey", "customer", "c_custkey % 3 = 0"),
    "edge": ("o_orderkey", "orders", "o_orderkey % 4 = 0"),
    "edge_evidence": ("p_partkey", "part", "p_partkey % 5 = 0"),
    "evidence": ("s_suppkey", "supplier", "s_suppkey % 2 = 0"),
    "stats": ("n_nationkey", "nation", "n_nationkey % 7 = 0"),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, 0 AS version, count(*) AS n, sum({key})::BIGINT AS keys FROM {table} UNION ALL SELECT '{name}', 1, count(*), sum({key})::BIGINT FROM {table} WHERE NOT ({late})" for name, (key, table, late) in _FIVE.items()))
def five_table_snapshot(spark, sf_dir):
    """Five tables as of the first and as of the second version of their set, which deletes some keys of each."""
    tables = snapshot.TableSet(spark, scratch_path(spark, "five"), {name: ["key"] for name in _FIVE}, "seq", buckets=4)
    rows = {name: M.table(spark, sf_dir, table).select(F.expr(key).cast("long").alias("key"), F.lit(0).alias("seq"), F.lit("insert").alias("op"), F.expr(late).alias("late")) for name, (key, table, late) in _FIVE.items()}
    tables.merge({name: r.drop("late") for name, r in rows.items()}, 0)
    tables.merge({name: r.where("late").withColumns({"seq": F.lit(1), "op": F.lit("delete")}).drop("late") for name, r in rows.items()}, 1)
    out = None
    for version in (0, 1):
        for name, table in tables.snapshot(version).items():
            one = table.agg(F.count("*").alias("n"), F.sum("key").alias("keys")).select(F.lit(name).alias("name"), F.lit(version).alias("version"), "n", "keys")
            out = one if out is None else out.union(one)
    return out


# Paths and histories

_FILES_SQL = "files AS (SELECT p_size % 5 AS repo_id, lower(p_brand) || '/' || replace(p_name, ' ', '_') || p_partkey || '.py' AS path, replace(substr(p_name, 1 + p_partkey % 4, 1 + p_partkey % 9), ' ', '_') AS part FROM part)"


@query(f"WITH {_FILES_SQL} SELECT i.repo_id, i.part, count(*) AS n, min(path) AS first, max(path) AS last FROM (SELECT DISTINCT repo_id, part FROM files WHERE part <> '') i JOIN (SELECT DISTINCT repo_id, path FROM files) f ON f.repo_id = i.repo_id AND contains(path, i.part) GROUP BY i.repo_id, i.part")
def fuzzy_imports(spark, sf_dir):
    """Parts of names of every part, with the files of their repository whose path contains them."""
    p = M.table(spark, sf_dir, "part")
    files = p.select((F.col("p_size") % 5).alias("repo_id"), F.concat(F.lower("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    parts = p.select((F.col("p_size") % 5).alias("repo_id"), F.expr("replace(substr(p_name, cast(1 + p_partkey % 4 AS int), cast(1 + p_partkey % 9 AS int)), ' ', '_')").alias("part"))
    found = paths.contains_join(files, parts)
    return found.groupBy("repo_id", "part").agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


@query("SELECT DISTINCT x.l_suppkey % 7 AS repo_id, x.l_suppkey::VARCHAR AS caller, y.l_suppkey::VARCHAR AS callee FROM (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem WHERE l_linenumber = 1) x JOIN (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem WHERE l_linenumber = 2) y ON x.l_shipdate = y.l_shipdate AND x.l_suppkey % 7 = y.l_suppkey % 7 AND x.l_suppkey <> y.l_suppkey")
def short_name_calls(spark, sf_dir):
    """Suppliers call those that shipped on their days, in the repository of their number."""
    l = M.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("repo_id"), F.col("l_suppkey").cast("string").alias("s"), F.col("l_shipdate").cast("string").alias("name"), "l_linenumber")
    return paths.short_name_calls(l.where("l_linenumber = 1").withColumnRenamed("s", "caller"), l.where("l_linenumber = 2").withColumnRenamed("s", "signature"))


@query("SELECT 'c' || event_id AS sha FROM events WHERE event_id > (SELECT max(event_id) // 40 * 30 FROM events)")
def commit_range(spark, sf_dir):
    """A history as long as the events, with a merged side commit in each ten and branches that lead nowhere: what follows a checkpoint."""
    e = M.table(spark, sf_dir, "events").select(F.col("event_id").alias("i"))
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    before = F.when(F.col("i") == 0, F.array().cast("array<string>")).when(F.col("i") % 10 == 4, F.array(name(F.col("i") - 2), name(F.col("i") - 1))).otherwise(F.array(name(F.col("i") - 1)))
    lost = e.where("i % 100 = 50").select(F.concat(F.lit("d"), F.col("i").cast("string")).alias("sha"), F.array(name(F.col("i"))).alias("parents"))
    head = e.agg(F.max("i")).first()[0]
    return git_log.commit_range(e.select(name(F.col("i")).alias("sha"), before.alias("parents")).union(lost), f"c{head}", f"c{head // 40 * 30}")[0].select("sha")


# Maintenance


@query(f"""WITH {M.COARSE_SQL}, {M.EDGES_SQL}, d AS (SELECT *, least(1, greatest(0, relevance * pow(2, -greatest(({M.NOW_US} - last_seen) / 3.6e9, 0) / 168))) AS new FROM e)
SELECT project_id, subject, predicate, object, valid_from, coalesce(valid_to, -1) AS valid_to, round(CASE WHEN abs(new - relevance) < 1e-6 THEN relevance ELSE new END, 9) AS relevance, coalesce(valid_to < {M.NOW_US}, false) AS archived FROM d""")
def maintenance_state(spark, sf_dir):
    """Edges after a night's decay and archiving, which two drivers ask for and one does."""
    path = scratch_path(spark, "maintained")
    claims = M.table(spark, sf_dir, "orders").count()  # one of each order
    edges = temporal.upsert_edges(M.coarse_observations(spark, sf_dir), parts=tasks(claims)).withColumns({"seq": F.lit(0).cast("long"), "op": F.lit("insert")})
    maintenance.edge_tables(spark, f"{path}/tables", 4).merge({"edges": edges}, 0)
    for _ in range(2):
        tables, jobs = maintenance.edge_tables(spark, f"{path}/tables", 4), ledger.JobLedger(spark, f"{path}/jobs")
        jobs.run_due(maintenance.jobs(tables, M.NOW_US, kinds=maintenance.JOBS[:2]), M.NOW_US)
    found = tables.snapshot()
    both = found["edges"].select(*temporal.EDGE, "relevance", F.lit(False).alias("archived")).union(found["archive"].select(*temporal.EDGE, "relevance", F.lit(True)))
    return both.select(*temporal.EDGE[:5], F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), F.round("relevance", 9).alias("relevance"), "archived")
