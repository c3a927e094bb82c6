"""Policies, module lists, required retrieval, folds over deliveries and file changes in small cases."""

import pytest
from pyspark.sql import functions as F

from kairoscope.operators import code_store, records, search, writes


def test_policies_and_modules():
    assert search.normalise_policy(None, False) == "safe" and search.normalise_policy(" Graph_Reranked ", False) == "graph_reranked"
    assert search.normalise_policy("auto", False) is None and search.normalise_policy("auto", True) == "auto" and search.normalise_policy("x", True) is None
    assert search.normalise_modules(None) == search.normalise_modules(["x"]) == ["code", "web", "conversation"]
    assert search.normalise_modules([" WEB", "code", "web"]) == ["web", "code"]
    assert [search.candidate_limit(*a) for a in ((5, "code"), (5, "code", True), (5, "web"), (40, "web"), (5, "conversation"), (5, "web", False, 50))] == [5, 15, 30, 40, 5, 50]


def test_required_retrieval(spark):
    rows = spark.createDataFrame([(1, "x")], "query_id int, source_id string")
    status = spark.createDataFrame([(1, "temporal_graph"), (2, "no_baseline")], "query_id int, status string")
    assert search.required(rows, status, "web").count() == 1
    with pytest.raises(search.TemporalRetrievalRequiredError) as e:
        search.required(rows, status.union(spark.createDataFrame([(3, "no_temporal_seeds")], "query_id int, status string")), "web")
    assert (e.value.module, e.value.reason, e.value.details) == ("web", "no_temporal_seeds", {"query_id": 3})


def test_best_row_of_each_source(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, 1), (1, "a", 0.9, 3), (1, "a", 0.9, 2), (1, "b", None, 4)], "q int, source string, score double, rank int")
    assert {(r.source, r.rank) for r in search.best_per_source(rows, ["q"], "source").collect()} == {("a", 2), ("b", 4)}


def test_upserts_do_not_depend_on_how_they_arrive(spark):
    rows = [("a", "one", "x", 1), ("a", "two", None, 2), ("b", None, "y", 3), ("a", "three", "z", 4), (None, "no key", "w", 5)]
    batch = lambda r: spark.createDataFrame(r, "k string, first string, last string, seq int")
    whole = writes.upsert(batch(rows), ["k"], ["last"])
    parts = writes.upsert(batch(rows[2:]), ["k"], ["last"], writes.upsert(batch(rows[:2]), ["k"], ["last"]))
    again = writes.upsert(batch(rows), ["k"], ["last"], whole)
    for got in (whole, parts, again):
        assert {(r.k, r.first, r.last) for r in got.collect()} == {("a", "one", "z"), ("b", None, "y")}
    assert writes.upsert(batch([]), ["k"], ["last"]).count() == 0
    latest = records.latest_records(batch(rows), ["k"])
    assert {tuple(r) for r in latest.collect()} == {("a", "three", "z"), ("b", None, "y")}


def test_links_close_and_contradict(spark):
    links = spark.createDataFrame([("a", "b", 1, 10, 0.5), ("a", "b", 2, 11, 0.9), ("a", "c", 3, 12, 0.1)], "s string, t string, seq int, valid_from int, confidence double")
    state = writes.temporal_links(links, ["s", "t"])
    state = writes.close_links(state, spark.createDataFrame([("a", "b", 1, 20), ("a", "b", 2, 30), ("x", "y", 1, 5)], "s string, t string, seq int, valid_to int"), ["s", "t"])
    state = writes.contradict_links(state, spark.createDataFrame([("a", "c"), ("a", "c"), ("x", "y")], "s string, t string"), ["s", "t"])
    assert {(r.t, r.valid_from, r.valid_to, r.support, r.confidence, r.contradictions) for r in state.collect()} == {("b", 10, 30, 2, 0.9, 0), ("c", 12, None, 1, 0.1, 2)}
    ends = [(spark.createDataFrame([("b",)], "name string"), {"t": "name"})]
    assert {r.t for r in writes.with_ends(links, ends).collect()} == {"b"}


def test_calls_of_changed_files(spark):
    functions = spark.createDataFrame([("f", "m.f", 1, "f"), ("g", "m.g", 2, "g"), ("h", "m.h", 3, "h")], "signature string, qualified_name string, position int, short_name string")
    calls = spark.createDataFrame([("f", "m.g", -1, "?"), ("g", "?", 3, "?"), ("h", "?", -1, "nothing"), ("h", "m.h", -1, "?")], "caller string, target string, position int, short_name string")
    analysed = spark.createDataFrame([("g", "f"), ("g", "unknown"), ("g", "g")], "caller string, callee string")
    edges, drops = code_store.call_edges(calls, functions, analysed)
    assert {(r.caller, r.callee, r.source) for r in edges.collect()} == {("f", "g", "static"), ("g", "f", "analyser")}
    assert {(r.reason, r.n) for r in drops.collect()} == {("unknown_target", 1), ("self_call", 1)}
    hits = spark.createDataFrame([(["Function"], "s", "p"), (["File"], None, "p"), (["Other"], "s", "p")], "labels array<string>, sig string, path string")
    assert {tuple(r) for r in code_store.seeds_by_label(hits).collect()} == {("Function", "s"), ("File", "p")}


def test_calls_are_kept_by_day(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 86_400_000, "b")], "id int, epoch_ms long, tool string")
    for _ in range(2):
        records.append_calls(rows, str(tmp_path / "calls"))
    got = spark.read.parquet(str(tmp_path / "calls"))
    assert got.count() == 4 and got.where(F.col("day") == "1970-01-02").select("tool").distinct().first().tool == "b"
