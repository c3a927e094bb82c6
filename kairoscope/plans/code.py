"""Queries over code, traces and commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoscope.operators import code_store
from kairoscope.plans import mapping as M
from kairoscope.plans.catalog import query

# Files: parts by brand and number; a second scan has changed and deleted ones.


def _scan(spark, sf_dir, second: bool):
    p = M.table(spark, sf_dir, "part")
    hash_ = F.md5(F.concat("p_name", F.when(F.lit(second) & (F.col("p_size") % 5 == 0), F.lit(" new")).otherwise("")).cast("binary"))
    rows = p.select(F.col("p_brand").alias("repo_id"), F.col("p_partkey").cast("string").alias("path"), hash_.alias("hash"), F.col("p_size").alias("size"))
    return (rows.where("size % 7 <> 0") if second else rows.where("size % 11 <> 0")).drop("size")


_SCANS_SQL = """s1 AS (SELECT p_brand AS repo_id, p_partkey::VARCHAR AS path, md5(p_name) AS hash FROM part WHERE p_size % 11 <> 0),
s2 AS (SELECT p_brand AS repo_id, p_partkey::VARCHAR AS path, md5(p_name || CASE WHEN p_size % 5 = 0 THEN ' new' ELSE '' END) AS hash FROM part WHERE p_size % 7 <> 0)"""


@query(f"""WITH {_SCANS_SQL} SELECT coalesce(s1.repo_id, s2.repo_id) AS repo_id, coalesce(s1.path, s2.path) AS path, CASE WHEN s1.path IS NULL THEN 'added' WHEN s2.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM s1 FULL JOIN s2 ON s1.repo_id = s2.repo_id AND s1.path = s2.path WHERE s1.hash IS DISTINCT FROM s2.hash""")
def file_changes(spark, sf_dir):
    return code_store.file_changes(_scan(spark, sf_dir, False), _scan(spark, sf_dir, True))


@query(f"""WITH {_SCANS_SQL} SELECT repo_id, path, hash, CASE WHEN EXISTS (SELECT 1 FROM s1 WHERE s1.repo_id = s2.repo_id AND s1.path = s2.path AND s1.hash = s2.hash) THEN 1 ELSE 2 END AS scan FROM s2""")
def file_rebuild(spark, sf_dir):
    """Rows of unchanged files stay those of the first scan."""
    first, second = _scan(spark, sf_dir, False), _scan(spark, sf_dir, True)
    changes = code_store.file_changes(first, second)
    return code_store.rebuilt(first.withColumn("scan", F.lit(1)), changes, second.withColumn("scan", F.lit(2)))


@query("""WITH f AS (SELECT p_partkey::VARCHAR AS signature, p_size % 4 = 0 AS gone FROM part), e AS (SELECT DISTINCT l_suppkey::VARCHAR AS caller, l_partkey::VARCHAR AS callee FROM lineitem)
SELECT caller, callee FROM e WHERE callee NOT IN (SELECT signature FROM f WHERE gone) AND caller NOT IN (SELECT signature FROM f WHERE gone)""")
def file_delete(spark, sf_dir):
    """Call edges without those of deleted files."""
    p = M.table(spark, sf_dir, "part").select(F.lit("r").alias("repo_id"), F.col("p_partkey").cast("string").alias("path"), F.col("p_partkey").cast("string").alias("signature"), "p_size")
    edges = M.table(spark, sf_dir, "lineitem").select(F.lit("r").alias("repo_id"), F.col("l_suppkey").cast("string").alias("caller"), F.col("l_partkey").cast("string").alias("callee")).distinct()
    return code_store.without_files(p.drop("p_size"), edges, p.where("p_size % 4 = 0"))[1].select("caller", "callee")


# Traces


def _calls(spark, sf_dir):
    """Customers call customers: direct calls, and callbacks that are not followed."""
    o = M.table(spark, sf_dir, "orders")
    n = M.table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    kind = F.when(F.col("o_orderstatus") == "F", "direct_call").when(F.col("o_orderstatus") == "O", "callback").otherwise("guess")
    return o.crossJoin(F.broadcast(n)).select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7 % F.col("n")).alias("dst"), kind.alias("kind"), ((F.col("o_orderkey") % 14 - 2) / 10.0).alias("confidence"))  # one row


_CALLED_SQL = "c AS (SELECT o_custkey AS src, o_orderkey * 7 % (SELECT count(*) FROM customer) AS dst, CASE o_orderstatus WHEN 'F' THEN 'direct_call' WHEN 'O' THEN 'callback' ELSE 'guess' END AS kind, (o_orderkey % 14 - 2) / 10.0 AS confidence FROM orders)"


@query(f"""WITH RECURSIVE {_CALLED_SQL}, d AS (SELECT DISTINCT src, dst FROM c WHERE kind = 'direct_call'), r AS (SELECT c_custkey AS root FROM customer WHERE c_mktsegment = 'FURNITURE'),
t AS (SELECT root, root AS node, 1 AS depth FROM r UNION SELECT root, dst, depth + 1 FROM t JOIN d ON src = node WHERE depth < 3) SELECT root, node, min(depth)::INT AS depth FROM t GROUP BY root, node""")
def function_trace(spark, sf_dir):
    """What each root reaches by direct calls to the depth 3."""
    roots = M.table(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("node"))
    return code_store.trace(_calls(spark, sf_dir), roots, 3)


@query(f"""WITH {_CALLED_SQL} SELECT src AS root, dst AS callee, kind, round(max(least(greatest(confidence, 0), 1)), 6) AS confidence FROM c WHERE kind <> 'guess' AND EXISTS (SELECT 1 FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment WHERE a.c_custkey = src AND b.c_custkey = dst) GROUP BY src, dst, kind""")
def trace_hops(spark, sf_dir):
    """Proposed edges of every root whose callee is of its segment."""
    hops = _calls(spark, sf_dir).select(F.col("src").alias("root"), F.col("dst").alias("callee"), "kind", "confidence")
    c = M.table(spark, sf_dir, "customer")
    of = lambda k, s: c.select(F.col("c_custkey").alias(k), F.col("c_mktsegment").alias(s))
    near = hops.select("root", "callee").distinct().join(of("root", "a"), "root").join(of("callee", "b"), "callee").where("a = b")
    rows = code_store.normalised_hops(hops, near)
    return rows.withColumn("confidence", F.round("confidence", 6))


@query("""WITH f AS (SELECT p_brand AS path, p_partkey::VARCHAR AS sig, p_type AS cls FROM part), i AS (SELECT DISTINCT a.p_brand AS path, b.p_brand AS target FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey),
im AS (SELECT path, string_agg(target, ',' ORDER BY target) AS imports FROM i GROUP BY path), ib AS (SELECT target AS path, string_agg(path, ',' ORDER BY path) AS imported_by FROM i GROUP BY target),
sb AS (SELECT path, count(*) AS siblings FROM f GROUP BY path), cl AS (SELECT path, string_agg(DISTINCT cls, ',' ORDER BY cls) AS classes FROM f GROUP BY path),
ca AS (SELECT r.path, count(DISTINCT sig) AS candidates FROM (SELECT path, target FROM i UNION SELECT DISTINCT path, path FROM f) r JOIN f ON f.path = r.target GROUP BY r.path)
SELECT sig AS signature, coalesce(imports, '') AS imports, coalesce(imported_by, '') AS imported_by, siblings, classes, candidates FROM f LEFT JOIN im USING (path) LEFT JOIN ib USING (path) JOIN sb USING (path) JOIN cl USING (path) JOIN ca USING (path)""")
def trace_context(spark, sf_dir):
    p, l = M.table(spark, sf_dir, "part"), M.table(spark, sf_dir, "lineitem")
    repo = F.lit("r").alias("repo_id")
    functions = p.select(repo, F.col("p_brand").alias("path"), F.col("p_partkey").cast("string").alias("signature"))
    classes = p.select(repo, F.col("p_brand").alias("path"), F.col("p_type").alias("name"))
    of = lambda k, c: p.select(F.col("p_partkey").alias(k), F.col("p_brand").alias(c))
    imports = l.select("l_partkey", "l_suppkey").distinct().join(of("l_partkey", "path"), "l_partkey").join(of("l_suppkey", "target"), "l_suppkey").select(repo, "path", "target")
    rows = code_store.trace_context(functions, classes, imports, counted=True)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("signature", joined("imports"), joined("imported_by"), "siblings", joined("classes"), "candidates")


@query(f"""WITH {_SCANS_SQL}, t AS (SELECT repo_id, path, hash, 'old' AS trace FROM s1 WHERE hash NOT LIKE 'f%' UNION ALL SELECT repo_id, path, hash, 'new' FROM s1 WHERE hash LIKE 'f%')
SELECT repo_id, path, trace FROM t WHERE EXISTS (SELECT 1 FROM s2 WHERE s2.repo_id = t.repo_id AND s2.path = t.path AND s2.hash = t.hash)""")
def trace_cache(spark, sf_dir):
    """Traces of the first scan, some stored again, that are valid after the second."""
    first = _scan(spark, sf_dir, False)
    stored = code_store.replaced(first.withColumn("trace", F.lit("old")), first.where("hash LIKE 'f%'").withColumn("trace", F.lit("new")), ["repo_id", "path"])
    return code_store.valid_traces(stored, _scan(spark, sf_dir, True)).select("repo_id", "path", "trace")


@query("SELECT p_partkey AS signature, count(*) OVER (PARTITION BY p_brand, p_type, p_name) = 1 AS qualified_unique, count(*) OVER (PARTITION BY p_brand, p_type, p_size) = 1 AS short_unique FROM part")
def signature_index(spark, sf_dir):
    p = M.table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo_id"), F.col("p_type").alias("path"), F.col("p_partkey").alias("signature"), F.col("p_name").alias("qualified_name"), F.col("p_size").alias("short_name"))
    return code_store.signature_index(p).select("signature", "qualified_unique", "short_unique")


# Commits


def _commits(spark, sf_dir):
    """An order is a commit of its customer in a repository of the customer's nation; its items are the touched files."""
    o, l, c = (M.table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    one = F.struct(F.col("l_partkey").cast("string").alias("path"), F.lit("M").alias("change_type"), F.col("l_linenumber").alias("additions"), F.lit(0).alias("deletions"))
    files = l.groupBy("l_orderkey").agg(F.collect_list(one).alias("files"))
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(files, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    parents = F.slice(F.array(F.lit("a"), F.lit("b")), 1, F.col("o_orderkey").cast("int") % 3)
    empty = F.from_json(F.lit("[]"), files.schema["files"].dataType)
    return rows.select(F.col("c_nationkey").alias("repo_id"), F.col("o_orderkey").cast("string").alias("sha"), M.micros(F.col("o_orderdate")).alias("committed_at"), F.concat(F.lit(" "), "c_mktsegment", F.lit("@X ")).alias("email"), F.col("c_name").alias("name"), parents.alias("parents"), F.coalesce("files", empty).alias("files"))


def _stored(spark, sf_dir):
    """The early commits, then all of them."""
    rows = _commits(spark, sf_dir)
    return code_store.store_commits(rows, code_store.store_commits(rows.where("committed_at < 883612800000000")))


_COMMITS_SQL = """k AS (SELECT c_nationkey AS repo_id, o_orderkey::VARCHAR AS sha, epoch_us(o_orderdate) AS committed_at, lower(c_mktsegment) || '@x' AS email, c_name AS name, o_orderkey % 3 AS parents FROM orders JOIN customer ON c_custkey = o_custkey),
v AS (SELECT DISTINCT c_nationkey AS repo_id, o_orderkey::VARCHAR AS sha, l_partkey::VARCHAR AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey)"""


@query(f"WITH {_COMMITS_SQL} SELECT repo_id, email, arg_max(name, committed_at::VARCHAR || name) AS name, max(committed_at) AS committed_at FROM k GROUP BY repo_id, email")
def commit_authors(spark, sf_dir):
    """The latest name of each author after two batches."""
    return _stored(spark, sf_dir)["authors"].select("repo_id", "email", "name", "committed_at")


@query(f"""WITH {_COMMITS_SQL}, q AS (SELECT repo_id, max(committed_at) AS done FROM k WHERE committed_at < 883612800000000 GROUP BY repo_id), a AS (SELECT repo_id, count(DISTINCT email) AS authors FROM k GROUP BY repo_id), w AS (SELECT repo_id, count(*) AS versions FROM v GROUP BY repo_id)
SELECT repo_id, count(*) AS commits, count(*) FILTER (done IS NULL OR committed_at > done) AS pending, any_value(authors) AS authors, coalesce(any_value(versions), 0) AS versions FROM k LEFT JOIN q USING (repo_id) LEFT JOIN a USING (repo_id) LEFT JOIN w USING (repo_id) GROUP BY repo_id""")
def git_status(spark, sf_dir):
    """Counts of each repository, with a checkpoint at the last early commit."""
    stored = _stored(spark, sf_dir)
    done = code_store.checkpoint_of(_commits(spark, sf_dir).where("committed_at < 883612800000000"))
    return code_store.git_status(stored["commits"], stored["authors"], stored["versions"], done)


@query(f"WITH {_COMMITS_SQL} SELECT repo_id, sha, path FROM v WHERE path IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size > 20)")
def version_links(spark, sf_dir):
    """File versions whose file is in the code graph."""
    versions = _stored(spark, sf_dir)["versions"]
    known = M.table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").cast("string").alias("path"))
    files = versions.select("repo_id", "path").distinct().join(known, "path")
    return code_store.version_links(versions, files)
