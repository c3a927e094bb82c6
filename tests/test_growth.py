"""Steps whose cost has to grow no faster than their input, against plain loops."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kairoscope import session
from kairoscope.operators import code_store, graph, paths, retrieval, search, temporal
from kairoscope.plans import mapping, registry
from kairoscope.storage import keyed_table, text_index


def test_rivals_of_open_edges_far_apart(spark):
    """An open edge is not copied to each stretch of time after it."""
    r = random.Random(5)
    spans = {(g, r.choice("abc"), f := r.randrange(10**12), r.choice([None, None, f + 10**11])) for g in range(4) for _ in range(8)}
    edges = spark.createDataFrame([(1, str(g), "p", o, f, t) for g, o, f, t in spans], "project_id int, subject string, predicate string, object string, valid_from long, valid_to long")
    far = 1 << 62
    met = lambda g, o, f, t: sorted((q, h) for s, q, h, u in spans if s == g and q != o and f <= (u or far) and h <= (t or far))
    for most, width in ((100, 1), (5, 10**11)):
        got = {(int(x.subject), x.object, x.valid_from, x.valid_to): (x.rivals, x.first_rival and tuple(x.first_rival)) for x in temporal.rivals(edges, width, most).collect()}
        assert got == {e: (len(met(*e)), (met(*e) or [None])[0]) for e in spans}


def test_trace_context_counts(spark):
    """Counts are the lengths of the lists, signatures of several files too."""
    r = random.Random(2)
    functions = spark.createDataFrame([("r", f"f{r.randrange(5)}", f"s{r.randrange(30)}") for _ in range(60)], "repo_id string, path string, signature string").distinct()
    classes = spark.createDataFrame([("r", "f0", "A"), ("r", "f1", "B"), ("r", "f9", "C")], "repo_id string, path string, name string")
    imports = spark.createDataFrame([("r", f"f{r.randrange(5)}", f"f{r.randrange(7)}") for _ in range(8)], "repo_id string, path string, target string")
    lists = {tuple(x) for x in code_store.trace_context(functions, classes, imports).select("path", "signature", "imports", "imported_by", "classes", F.size("siblings"), F.size("candidates")).toPandas().map(lambda c: tuple(c) if hasattr(c, "__len__") and not isinstance(c, str) else c).itertuples(index=False)}
    counts = {tuple(x) for x in code_store.trace_context(functions, classes, imports, counted=True).select("path", "signature", "imports", "imported_by", "classes", "siblings", "candidates").toPandas().map(lambda c: tuple(c) if hasattr(c, "__len__") and not isinstance(c, str) else c).itertuples(index=False)}
    assert lists == counts and len(lists) == functions.count()


def test_retrieval_around_a_customer_of_many_parts(spark, tmp_path):
    """The query expands to every node: each of a hundred equal edges has a hundredth of its subject's weight; with a budget of 60 nodes it would have more."""
    spark.sql("SELECT 7L AS c_custkey, 0 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 1L AS o_orderkey, 7L AS o_custkey, 'O' AS o_orderstatus, timestamp'1999-12-01 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1L AS l_orderkey, id AS l_partkey, 0.5D AS l_discount, timestamp'2000-01-02 00:00:00' AS l_shipdate FROM range(100)").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = registry.queries()["temporal_retrieve"](spark, str(tmp_path)).collect()
    assert [x.score for x in rows] == [0.0015] * 10


def test_nearest_holds_arrays_of_the_best(monkeypatch):
    """A task holds k results a question, whatever it reads; ties end at the key, also over parts and for texts."""
    monkeypatch.setattr(retrieval, "AT_ONCE", (3, 16))
    r = np.random.default_rng(4)
    rows = r.integers(-2, 3, (200, 3)).astype(np.float64)
    rows[~rows.any(axis=1)] = 1
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for keys in (r.permutation(200), np.array([f"k{i:03}" for i in r.permutation(200)], object)):
        asked = retrieval._by_length(pa.array(np.arange(8)), pa.array(rows[:8].tolist()))
        nearest = retrieval._Nearest(asked, 5)
        for a in range(0, 200, 70):
            nearest.add(pa.array(keys[a : a + 70]), pa.array(rows[a : a + 70].tolist()))
        assert {n: [x.shape for x in both] for n, both in nearest.found.items()} == {3: [(8, 5), (8, 5)]}
        kind = pa.string() if keys.dtype == object else pa.int64()
        got = nearest.table(pa.schema([("q", pa.int64()), ("k", kind), ("s", pa.float64())])).to_pylist()
        for q in range(8):
            scores = np.round(unit @ unit[q], 9)
            best = sorted(zip(-scores, keys.tolist(), strict=True))[:5]
            assert [x["k"] for x in got if x["q"] == q] == [k for _, k in best]


def test_seed_entities_by_sums_first(spark):
    """Sums are hashed, not sorted; the spelling is that of the first place, and of the first position in it."""
    rows = spark.createDataFrame([(2, 1.0, [("B", None), ("a", "x")]), (1, 0.0, [("A ", "x"), ("a", "x"), ("b", None)]), (3, 0.5, [("A", "x")])], "position int, score double, entities array<struct<name string, type string>>")
    found = retrieval.seed_entities(rows, 2)
    assert [(x.name, x.type, x.weight, x["first"]) for x in found.collect()] == [("A", "x", 2.5, 1), ("b", "unknown", 1.333333333, 1)]
    texts = spark.range(4).selectExpr("id AS position", "1.0D AS score", "array(struct('n' AS name, 't' AS type)) AS entities")
    plan = retrieval.seed_entities(texts, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Parquet" in plan  # the sums are made already; the spelling is joined to them


def test_lexical_candidates_shuffle_no_pairs(spark):
    """A document is dealt once; its pairs with the queries are not shuffled for their sums."""
    docs = spark.createDataFrame([(1, "Other sets"), (2, "the other"), (3, None), (4, "xx the")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "the other"), (8, "set thes"), (9, "")], "item_id long, text string")
    found = retrieval.lexical_candidates(docs, asked, 2)
    assert sorted(tuple(x) for x in found.collect()) == [(7, 1, 2, 1), (7, 2, 2, 2), (8, 1, 1, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(item_id#\w+, doc_id", plan)


def test_bm25_shuffles_no_pairs(spark):
    """A document's terms are dealt together; its pairs with the queries are not shuffled for their sums."""
    docs = spark.createDataFrame([(i, "one two three " * (i % 3) + "four") for i in range(9)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "one two"), (8, "four five")], "item_id long, text string")
    found = retrieval.bm25(docs, asked, 2)
    assert sorted((x.item_id, x.doc_id) for x in found.collect()) == [(7, 2), (7, 5), (8, 0), (8, 3)]
    assert not re.search(r"hashpartitioning\(item_id#\w+, doc_id", found._jdf.queryExecution().executedPlan().toString())


def test_calls_by_short_names_shuffle_no_pairs(spark):
    """However many names lead to a pair, it is made once, in the task that has it; nulls call nothing, stretches of any size."""
    r = random.Random(6)
    some = lambda xs, p=0.05: None if r.random() < p else r.choice(xs)
    make = lambda n: [(some("ab"), some("uvwxyz"), some([f"n{i}" for i in range(8)])) for _ in range(n)]
    calls, functions = make(80), make(60)
    want = {(a, x, y) for a, x, n in calls for b, y, m in functions if None not in (a, x, y, n) and (a, n) == (b, m) and x != y}
    one, two = spark.createDataFrame(calls, "repo_id string, caller string, name string"), spark.createDataFrame(functions, "repo_id string, signature string, name string")
    for cell in (1, 7, 1000):
        found = paths.short_name_calls(one, two, cell)
        rows = [tuple(x) for x in found.select("repo_id", "caller", "callee").collect()]
        assert set(rows) == want and len(rows) == len(want)
    plan = paths.short_name_calls(one, two)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]
    assert paths.short_name_calls(one.limit(0), two).count() == 0


def test_tasks_of_file_history_follow_the_rows(spark, monkeypatch):
    """Twice the bound halves the tasks, whatever the session's number of shuffle partitions is."""
    plan = registry.queries()["file_history"]
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for most in (100, 200):
        monkeypatch.setattr(session, "TASK_ROWS", most)
        assert plan(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-lines // most)


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """No task takes all of a bucket, however many rows it has, and each key is in it once."""
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    table = keyed_table.KeyedTable(spark, str(tmp_path / "t"), ["key"], "seq", buckets=2)
    rows = spark.range(1000).select(F.col("id").alias("key"), F.lit(0).alias("seq"), F.lit("insert").alias("op"))
    table.merge(rows, 0)
    table.merge(rows.where("key % 3 = 0").withColumns({"seq": F.lit(1), "op": F.when(F.col("key") % 2 == 0, "delete").otherwise("update")}), 1)
    assert sorted(map(tuple, table.table().collect())) == [(k, int(k % 3 == 0)) for k in range(1000) if k % 6]
    for bucket in range(2):
        assert table.rows(buckets=[bucket]).withColumn("f", F.input_file_name()).groupBy("f").count().agg(F.max("count")).first()[0] < 400


def test_claims_delivered_twice_are_read_once(spark):
    """Edges, evidence and links each read the line items once, so that both deliveries of a claim are folded where they are read."""
    plan = registry.queries()["claim_ingest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 3


def test_text_index_shuffles_no_pairs(spark, tmp_path):
    """A block's postings come to one task; their pairs with the queries are not shuffled for their sums."""
    docs = spark.createDataFrame([(i, "one two three " * (i % 3) + "four") for i in range(9)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "one two"), (8, "four five")], "item_id long, text string")
    index = text_index.TextIndex(spark, str(tmp_path / "texts"), block=2)
    index.append(docs)
    found = index.topk(asked, 2, "item_id")[0]
    assert sorted((x.item_id, x.key) for x in found.collect()) == [(7, 2), (7, 5), (8, 0), (8, 3)]
    assert not re.search(r"hashpartitioning\(query#\w+, key", found._jdf.queryExecution().executedPlan().toString())


def test_full_budgets_ask_no_more(spark, monkeypatch):
    """A question whose budget is full is not in the next hop's expansion."""
    edges = spark.createDataFrame([("p", "a", f"n{i}", 1.0) for i in range(6)] + [("p", "z", "y", 1.0), ("p", "y", "x", 1.0)], "project_id string, src string, dst string, weight double")
    seeds = spark.createDataFrame([(1, "p", "a"), (2, "p", "z")], "query_id int, project_id string, node string")
    kept = {}
    monkeypatch.setattr(graph, "materialise", lambda rows, name: kept.setdefault(name, []).append(r := session.materialise(rows, name)) or r)
    got = {(x.query_id, x.node) for x in graph.capped_reach(edges, seeds, 2, 4).collect()}
    assert got == {(1, "a"), (1, "n0"), (1, "n1"), (1, "n2"), (2, "z"), (2, "y"), (2, "x")}
    assert [x.query_id for x in kept["room"][1].collect()] == [2]
    assert kept["adjacent"][0].where("node = 'a'").count() == 4


@pytest.mark.parametrize("hub", [0, 2, 64])
def test_rounds_of_a_walk_shuffle_no_steps(spark, monkeypatch, hub):
    """Steps are dealt once: a round's join finds them where they lie, with hubs or without, and its ranks are those of loops."""
    monkeypatch.setattr(graph, "HUB", hub)
    r = random.Random(3)
    edges = {(r.randrange(12), r.randrange(12)): r.random() + 0.1 for _ in range(50)}
    rows = spark.createDataFrame([(*e, w) for e, w in edges.items()], "src int, dst int, weight double")
    rank = {n: 1.0 if n == 3 else 0.0 for n in {x for e in edges for x in e} | {3}}
    out = {n: sum(w for (a, _), w in edges.items() if a == n) for n in rank}
    for _ in range(4):
        rank = {n: 0.2 * (n == 3) + 0.8 * sum(rank[a] * w / out[a] for (a, b), w in edges.items() if b == n) for n in rank}
    got = {x.node: x["rank"] for x in graph.pagerank(rows, spark.createDataFrame([(3,)], "node int"), 0.2, False, rounds=4, tolerance=None).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-12 for n in rank)
    steps = graph._Steps(rows, [])
    plan = steps.pushed(spark.createDataFrame([(3, 1.0)], "node int, d double").hint("merge"))._jdf.queryExecution().executedPlan().toString()
    steps.release()
    assert "InMemoryTableScan" in plan
    assert not re.search(r"Exchange[^\n]*\n([^\n]*Filter[^\n]*\n)?[^\n]*InMemoryTableScan", plan)


def test_weighted_edges_are_shuffled_once_for_a_subject(spark):
    """Edges and the totals of their subjects share the shuffle that brings a subject's claims to one task."""
    plan = registry._weighted(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*valid_from", plan)


@pytest.mark.parametrize(("hub", "hops", "tolerance"), [(0, 2, 1e-6), (3, 2, 0.05), (64, 1, 1e-6), (64, 3, 1e-6)])
def test_walks_known_by_their_hubs(spark, monkeypatch, hub, hops, tolerance):
    """Every node within the hops and its rank, as loops find them: hits in hubs and in low nodes, edges twice, loops, islands; each question ends by itself."""
    monkeypatch.setattr(graph, "HUB", hub)
    r = random.Random(8)
    edges = [(f"n{r.randrange(40):02}", f"n{min(r.randrange(40), r.randrange(40)):02}", r.random() + 0.1) for _ in range(70)] + [("x", "y", 1.0), ("x", "x", 0.5), ("y", "x", 2.0)]
    hits = {(q, f"n{r.randrange(40):02}") for q in range(5) for _ in range(2)} | {(5, "x"), (6, "none"), (5, "none")}
    known = {n for a, b, _ in edges for n in (a, b)}
    want = {}
    for q in range(7):
        own = {n for x, n in hits if x == q} & known
        seen = set(own)
        for _ in range(hops):
            seen |= {b for a, b, _ in edges if a in seen} | {a for a, b, _ in edges if b in seen}
        names = sorted(seen)
        step = np.zeros((len(names), len(names)))
        for a, b, w in edges:
            if a in seen and b in seen:
                step[names.index(b), names.index(a)] += w
                step[names.index(a), names.index(b)] += w
        step /= np.maximum(step.sum(axis=0), 1e-300)
        rank = seed = np.array([1 / len(own) if n in own else 0 for n in names])
        for _ in range(12):
            new = 0.2 * seed + 0.8 * step @ rank
            moved, rank = np.abs(new - rank).sum(), new
            if moved < tolerance:
                break
        want |= {(q, n): x for n, x in zip(names, rank, strict=True)}
    rows = spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(list(hits), "query_id int, node string")
    got = [((x.query_id, x.node), x["rank"] or 0.0) for x in graph.walk_within(*rows, hops, 0.2, tolerance=tolerance).collect()]
    assert len(got) == len(want) and dict(got).keys() == want.keys()
    assert all(abs(x - want[n]) < 1e-12 for n, x in got)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 3)
    assert graph.walk_within(*rows, hops, 0.2) is None


def test_code_search_shuffles_no_edge_in_its_rounds(spark, monkeypatch):
    """Bytes that are shuffled for an edge: it is dealt once, and rounds send sums for hubs alone. The other way has the same hits."""
    edges = spark.range(40_000).select(F.concat(F.lit("s"), (F.col("id") % 40).cast("string")).alias("src"), F.concat(F.lit("p"), (F.col("id") / 40).cast("int").cast("string")).alias("dst"), (1 + F.col("id") % 7).cast("double").alias("weight"))
    baseline = spark.createDataFrame([(1, "s3", 1.0, 1), (1, "p7", 0.5, 2), (2, "none", 1.0, 1)], "query_id int, node string, score double, rank int")
    context = spark.sparkContext._jsc.sc()

    def sent() -> int:
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = sent()
    found = sorted(map(tuple, search.code_search(baseline, edges, 5, "graph_reranked").collect()))
    assert sent() - before < 30 * 40_000
    monkeypatch.setattr(graph, "walk_within", lambda *_: None)
    assert sorted(map(tuple, search.code_search(baseline, edges, 5, "graph_reranked").collect())) == found and len(found) == 6


def test_neighbourhood_makes_no_claims_it_is_not_asked_for(spark, tmp_path):
    """Bytes that are shuffled for a line item: hops look up what they ask for where it lies, so they do not follow the items."""
    spark.sql("SELECT id AS c_custkey, cast(id % 5 AS int) AS c_nationkey FROM range(4000)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT id AS o_orderkey, id % 4000 AS o_custkey, 'O' AS o_orderstatus, timestamp'1999-12-01 00:00:00' AS o_orderdate FROM range(20000)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id % 20000 AS l_orderkey, id * 7 % 9001 AS l_partkey, 0.5D AS l_discount, timestamp'2000-01-02 00:00:00' AS l_shipdate FROM range(80000)").write.parquet(f"{tmp_path}/lineitem.parquet")
    context = spark.sparkContext._jsc.sc()

    def sent() -> int:
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = sent()
    rows = registry.queries()["temporal_neighborhood"](spark, str(tmp_path)).collect()
    assert sent() - before < 2 * 80_000
    assert sorted({x.hop for x in rows}) == [0, 1, 2] and len(rows) == len({x.node for x in rows}) > 100


@pytest.mark.parametrize(("first", "most"), [(1, 1_000_000), (3, 0)])
def test_neighbourhood_of_odd_claims(spark, tmp_path, monkeypatch, first, most):
    """As its SQL: first customers without claims, keys that repeat or are null, a project without a number, one without claims; sent to all tasks or shuffled."""
    monkeypatch.setattr(mapping, "ASKED_FIRST", first)
    for module in (mapping, graph):
        monkeypatch.setattr(module, "small", lambda rows: retrieval.small(rows, most))
    r = random.Random(first)
    some = lambda n, p=0.05: None if r.random() < p else r.randrange(n)
    customers = [(some(60), some(5)) for _ in range(70)] + [(90, 9), (None, 9)]
    orders = [(some(150), some(60) if r.random() < 0.2 else r.randrange(20, 60)) for _ in range(120)]
    items = [(some(150), some(40)) for _ in range(160)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").selectExpr("*", "'O' AS o_orderstatus", "timestamp'1999-12-01 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").selectExpr("*", "0.5D AS l_discount", "timestamp'2000-01-02 00:00:00' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["temporal_neighborhood"]).fetchall()
    got = registry.queries()["temporal_neighborhood"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len({h for _, h in want}) == 3
