"""Operators that SQL does not express, and the rules that the queries leave out."""

import json

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kairoscope.functions import ids, interval, vector
from kairoscope.functions import text as T
from kairoscope.operators import conversation, evaluation, events, graph, memory, retrieval, temporal
from kairoscope.sources import code, files, git_log, html
from kairoscope.streaming import cdc, tail, turns


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalisers(spark):
    assert one(spark, T.name_norm(F.lit("  A \t b\n"))) == "a b"
    assert one(spark, T.relation_type(F.lit(" -- "))) == "_" and one(spark, T.relation_type(F.lit("?!"))) == "REFERENCES"
    assert one(spark, T.memory_label(F.lit("9 lives--x"))) == "Type_9_lives_x"
    assert one(spark, T.memory_relation(F.lit("knows of"))) == "KNOWS_OF"
    assert one(spark, T.token_estimate(F.lit("a b c d e"))) == 6
    assert one(spark, T.row_key(F.lit(""), F.lit(None).cast("string"), F.lit(" n "))) == "n"
    assert one(spark, T.split_message(F.lit("s\n\nb\nc"))) == ("s", "b\nc")
    assert one(spark, T.rel_path(F.lit("a\\b/c "))) == "a/b/c"
    assert tuple(one(spark, T.source_id_parts(F.lit("a:b:7")))) == ("a:b", 7)
    assert one(spark, T.source_id_parts(F.lit("a:b"))) is None and one(spark, T.source_id_parts(F.lit("7"))) is None
    assert one(spark, T.truncate_output(F.lit("abcdef"), 3)).startswith("abc\n")
    assert (one(spark, T.char_token_estimate(F.lit("abcde"))), one(spark, T.plugin_token_estimate(F.lit("abcde")))) == (1, 2)


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(1000))
    chunks = one(spark, T.word_windows(F.lit(words)))
    assert [len(c.split()) for c in chunks] == [393, 393, 290] and chunks[0].split()[-38:] == chunks[1].split()[:38]
    assert one(spark, T.word_windows(F.lit(""))) == [""]
    assert one(spark, T.header_sections(F.lit("# a\nx\n## b\ny\n#### c\n### d"))) == ["# a\nx", "## b\ny\n#### c", "### d"]


def test_ids_and_vectors(spark):
    assert ids.fnv1a64("") == ids.FNV_OFFSET and ids.fnv1a64("a") == 0xAF63DC4C8601EC8C
    assert one(spark, ids.stable_id(F.lit("p"), F.lit("kind"))) == ids.wide_id(["p", "kind"])
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vector.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.5**0.5)
    assert [one(spark, vector.is_valid(c)) for c in (v(1, 2), v(0, 0), v(float("nan")), v(), F.lit(None).cast("array<double>"))] == [True, False, False, False, False]


def test_intervals(spark):
    l = lambda x: F.lit(x).cast("long")
    assert one(spark, interval.overlaps(l(0), l(5), l(5), l(9))) and not one(spark, interval.overlaps(l(0), l(5), l(6), l(None)))
    assert one(spark, interval.midpoint(l(10), l(None))) == 10 and one(spark, interval.midpoint(l(10), l(21))) == 15
    assert [one(spark, interval.distance(l(10), l(20), l(x))) for x in (5, 15, 26)] == [5, 0, 6]
    assert one(spark, interval.decayed(F.lit(0.8), F.lit(168.0))) == pytest.approx(0.4)
    assert one(spark, interval.micros_of_text(F.lit("1970-01-01T00:00:01Z"))) == 1_000_000 and one(spark, interval.micros_of_text(F.lit("no"))) is None


def test_turns_keep_their_first_content(spark):
    cols = "source_key string, session_id string, turn_index int, role string, content string, ingested_at long"
    first = conversation.ingest_turns(spark.createDataFrame([("k", "s", 0, "user", "one", 1), ("k", "s", 1, "tool", "two", 1)], cols))
    again = conversation.ingest_turns(spark.createDataFrame([("k", "s", 0, "user", "changed", 2)], cols), first)
    assert {(r.turn_index, r.content, r.ingested_at, r.embedded) for r in again.collect()} == {(0, "one", 2, True), (1, "two", 1, False)}
    bad = conversation.rejected(spark.createDataFrame([("s", "x", "user", 0), (" ", "x", "user", 0), ("s", "x", "robot", 0), ("s", "x", "user", -1)], "session_id string, content string, role string, turn_index int"))
    assert [r.reject_reason for r in bad.collect()] == [None, "session_id is missing", "role is unknown", "turn_index is invalid"]


def test_prune_rounds(spark, monkeypatch):
    cols = "project_id int, subject string, predicate string, object string, valid_from long, valid_to long, confidence double, observed_at long"
    hour = 3_600_000_000
    # Two families of the group vary enough over three observations, so there are two rounds; the other group has none.
    seen = [(1, "s", "p", o, i * 400 * hour, None, 1.0, 0) for o in "ab" for i in range(3)] + [(1, "s", "q", "a", 0, None, 1.0, 0)]
    observations = spark.createDataFrame(seen, cols)
    rows = [(1, "s", "p", o, 1, t, s, 1.0, r, c) for o, t, s, r, c in [("a", None, 3, 1.0, 0), ("b", 2, 1, 0.9, 0), ("c", 3, 1, 0.3, 1), ("d", 3, 1, 0.3, 0)]] + [(1, "s", "q", "x", 1, None, 1, 1.0, 0.01, 5)]
    edges = spark.createDataFrame(rows, "project_id int, subject string, predicate string, object string, valid_from long, valid_to long, support long, confidence double, relevance double, contradictions long")
    got = {r.object: (round(r.relevance, 6), r.archived) for r in temporal.mdl_prune(edges, observations).collect()}
    assert got == {"a": (1.0, False), "b": (0.225, False), "c": (0.15, True), "d": (0.075, True), "x": (0.01, False)}


def test_contradictions_in_stretches_of_time(spark):
    r = random.Random(3)
    spans = {("a", 0, 5), ("b", 5, 9), ("b", 6, None), ("c", 0, 100), ("a", 200, 210), ("d", 10, 12)}
    spans |= {(r.choice("abcd"), f := r.randrange(300), r.choice([None, f, f + 3, f + 90])) for _ in range(40)}
    rows = [(1, "s", "p", o, f, t, 1.0, 0) for o, f, t in spans] + [(2, "s", "p", "z", 0, None, 1.0, 0)]
    obs = spark.createDataFrame(rows, "project_id int, subject string, predicate string, object string, valid_from long, valid_to long, confidence double, observed_at long")
    edges = temporal.upsert_edges(obs).withColumn("edge_id", F.xxhash64(*temporal.EDGE))
    far = 1 << 62
    against = {(o, f, t): sorted((q, g) for q, g, u in spans if q != o and f <= (far if u is None else u) and g <= (far if t is None else t)) for o, f, t in spans} | {("z", 0, None): []}
    for width in (1, 7, 10**9):
        counts = {(x.object, x.valid_from, x.valid_to): x.contradictions for x in temporal.contradiction_counts(edges, width).collect()}
        assert counts == {k: len(v) for k, v in against.items()}
        found = {(x.object, x.valid_from, x.valid_to): (x.rivals, x.first_rival and tuple(x.first_rival)) for x in temporal.rivals(edges, width).collect()}
        assert found == {k: (len(v), v[0] if v else None) for k, v in against.items()}
    assert {x.object for x in temporal.active_at(edges.where("valid_from < 8 AND valid_to < 101"), 7).collect()} >= {"b", "c"}


def test_pagerank_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(1,)], "node long")
    lossy = {r.node: r.rank for r in graph.pagerank(edges, seeds, 0.2, False).collect()}
    whole = {r.node: r.rank for r in graph.pagerank(edges, seeds, 0.2, True).collect()}
    assert lossy[1] > lossy[2] > 0 and sum(lossy.values()) < 1 and sum(whole.values()) == pytest.approx(1)
    assert {(r.node, r.hop) for r in graph.neighbourhood(edges, spark.createDataFrame([(3,)], "node long"), 2).collect()} == {(3, 0), (2, 1), (1, 2)}


def test_debounce_follows_accepted_events(spark):
    times = [0, 5, 9, 11, 22, 30, 31, 45]
    rows = spark.createDataFrame([(i, "k", t) for i, t in enumerate(times)], "event_id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want, last = [], None
    for t in times:
        if last is None or t - last >= 10:
            want.append(t)
            last = t
    assert sorted(r.s for r in events.debounce(rows, ["key"], "ts", 10.0).collect()) == want


def test_bursts_join_at_the_idle_gap(spark):
    rows = spark.createDataFrame([(i, "k", t) for i, t in enumerate([0, 100, 110, 121])], "event_id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.s for r in events.latest_burst(rows, "key", "ts", 11).collect()) == [100, 110, 121]


def test_memory_merges(spark):
    stored = spark.createDataFrame([("a", "T", ["x", "x"]), ("b", "T", ["y"])], "name string, type string, observations array<string>")
    batch = spark.createDataFrame([("a", "T", []), ("b", "T", ["z"]), ("c", "U", ["w"])], stored.schema)
    got = {r.name: r.observations for r in memory.upsert_entities(stored, batch).collect()}
    assert got == {"a": ["x", "x"], "b": ["z"], "c": ["w"]}
    added = memory.add_observations(stored, spark.createDataFrame([("a", ["x", "q"])], "name string, new array<string>"))
    assert {r.name: r.observations for r in added.collect()} == {"a": ["x", "x", "q"], "b": ["y"]}
    gone = memory.delete_observations(stored, spark.createDataFrame([("b", ["y"])], "name string, gone array<string>"))
    assert {r.name: r.observations for r in gone.collect()} == {"a": ["x", "x"], "b": []}
    relations = spark.createDataFrame([("a", "R", "b")], "source string, type string, target string")
    left, kept, unknown = memory.delete_entities(stored, relations, spark.createDataFrame([("b",), ("zz",)], "name string"))
    assert (left.count(), kept.count(), [r.name for r in unknown.collect()]) == (1, 0, ["zz"])


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "item_id int, doc_id int, rank int")
    got = {r.item_id: r for r in evaluation.query_metrics(ranked, spark.createDataFrame([(1, 11)], "item_id int, doc_id int")).collect()}
    assert got[1].mrr == 0.5 and got[1].ndcg == pytest.approx(0.6309297, abs=1e-6) and got[1].recall == 1
    assert got[2].hit_rank is None and got[2].mrr == 0 and got[2].success == 0


def test_fusion_takes_the_last_rank(spark):
    dense = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8), (1, "a", 3, 0.7), (2, "a", 1, 0.5)], "q int, key string, rank int, score double")
    got = {(r.q, r.key): r.score for r in retrieval.rrf(dense, dense.where("key = 'b'"), 5, "q").collect()}
    assert got == {(1, "a"): pytest.approx(1 / 63), (1, "b"): pytest.approx(2 / 62), (2, "a"): pytest.approx(1 / 61)}


PYTHON = '''import os
from ..pkg import thing

class A:
    def run(self, x):
        helper(x); helper(x)
        def inner():
            hidden()
        return self.go()

    def go(self):
        return os.getenv("X")

def helper(x):
    return helper(x)
'''


def test_code_tables(spark):
    rows = [("r1", "src/a.py", PYTHON), ("r2", "src/a.py", "def broken(:"), ("r1", "src/app.ts", "import {x} from './lib/h?raw';\nexport const go = async (a: number) => { call(a); };\nclass B {}\nfunction call(a) { return a }\n")]
    items = code.parse_files(spark.createDataFrame(rows, "repo_id string, path string, content string"))
    got = {(r.repo_id, r.path, r.kind, r.qualified_name): r for r in items.collect()}
    assert got["r1", "src/a.py", "function", "A.run"].calls == ["helper", "go"]
    assert got["r1", "src/a.py", "function", "A.run.inner"].calls == ["hidden"] and got["r1", "src/a.py", "import", "..pkg"]
    assert any(k[2] == "error" for k in got) and ("r1", "src/app.ts", "function", "go") in got
    calls = {(r.caller, r.callee) for r in code.same_file_calls(items).collect()}
    assert calls == {("A.run", "helper"), ("A.run", "A.go"), ("go", "call")}
    assert files.python_candidates("src/p/a.py", "..pkg") == ["src/pkg", "src/pkg.py", "src/pkg/__init__.py"]
    assert files.python_candidates("a.py", "...x") == [] and files.script_candidates("src/app.ts", "../../x") == []
    tree = spark.createDataFrame([("r1", "src/lib/h.ts"), ("r2", "src/lib/h.ts"), ("r1", "pkg.py")], "repo_id string, path string")
    imports = items.where("kind = 'import'").select("repo_id", "path", F.col("name").alias("module"))
    assert {(r.path, r.target) for r in files.resolve_imports(imports, tree).collect()} == {("src/app.ts", "src/lib/h.ts"), ("src/a.py", "pkg.py")}


def test_scan_skips_and_compares(spark, tmp_path):
    for name in ("a.py", "venv-x/b.py", "sub/c.py", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    found = files.scan(spark, str(tmp_path), "r", [".py"])
    assert sorted(r.path for r in found.collect()) == ["a.py", "sub/c.py"]
    stored = found.withColumn("hash", F.when(F.col("path") == "a.py", "old").otherwise(F.col("hash"))).select("repo_id", "path", "hash").union(spark.createDataFrame([("r", "gone.py", "h")], "a string, b string, c string"))
    assert [r.path for r in files.changed(found, stored).collect()] == ["a.py"] and [r.path for r in files.vanished(found, stored).collect()] == ["gone.py"]


def test_git_text(spark):
    rows = spark.createDataFrame([("c1", "12\t4\tsrc/core.py\n-\t-\tlogo.png\n1\t1\tonly.py", "M\tsrc/core.py\nR100\told.py\tnew.py\nA\tlogo.png")], "sha string, numstat string, name_status string")
    got = {r.path: (r.change_type, r.additions, r.deletions) for r in git_log.file_changes(rows, ["sha"]).collect()}
    assert got == {"src/core.py": ("M", 12, 4), "new.py": ("R", 0, 0), "logo.png": ("A", 0, 0), "only.py": ("M", 1, 1)}
    lines = [git_log.FIELD.join(x) for x in (("c", "a b", "N", "X@Y.z", "2024-01-01T00:00:00Z", "sub\n\nbody"), ("b", "a", "N", "x", "2024-01-01T00:00:00Z", "s"), ("a", "", "N", "x", "2024-01-01T00:00:00Z", "s"))]
    all_ = git_log.commits(spark.createDataFrame([(x,) for x in lines], "value string"))
    top = all_.where("sha = 'c'").first()
    assert top.is_merge and top.email == "x@y.z" and top.body == "body"
    assert sorted(r.sha for r in git_log.commits_since(all_, spark.createDataFrame([("b",)], "sha string")).collect()) == ["c"]
    assert git_log.commits_since(all_, spark.createDataFrame([("zz",)], "sha string")).count() == 3


def test_pages_to_markdown(spark):
    page = "<html><head><title>no</title></head><body><h2>A &amp; B</h2><p>one <b>two</b>\n three</p><ul><li>x</li><li><a href='/y'>y</a></li></ul><script>bad()</script></body></html>"
    assert html.to_markdown(page) == "## A & B\n\none **two** three\n\n* x\n* [y](/y)"
    rows = spark.createDataFrame([(page, "html"), ("# m", "markdown")], "c string, k string")
    assert [r.x for r in rows.select(html.normalised(F.col("c"), F.col("k")).alias("x")).collect()] == [html.to_markdown(page), "# m"]
    with pytest.raises(Exception, match="unsupported format"):
        spark.createDataFrame([("x", "pdf")], "c string, k string").select(html.normalised(F.col("c"), F.col("k"))).collect()


def test_session_logs(spark, tmp_path):
    say = lambda role, *texts: json.dumps({"type": "response_item", "timestamp": "t", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": t} for t in texts] + [{"type": "image", "text": "no"}]}})
    lines = [json.dumps({"type": "session_meta", "payload": {"id": "S1"}}), say("user", "a", "b"), "broken {", say("system", "x"), say("assistant", "c"), say("user", "cut")]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = [(r.session_id, r.turn_index, r.role, r.text) for r in tail.messages(tail.read_lines(spark, str(tmp_path))).orderBy("turn_index").collect()]
    assert got == [("S1", 0, "user", "a\nb"), ("S1", 1, "assistant", "c")]


def test_streams_equal_batches(spark, tmp_path):
    data = tmp_path / "conversations.parquet"
    for part in range(3):
        spark.createDataFrame([(c, t) for c in range(4) for t in range(part * 2, part * 2 + 2)], "conv_id long, turn long").coalesce(1).write.mode("append").parquet(str(data))
    got = turns.number_table(spark, str(data)).collect()
    assert len(got) == 24 and all(sorted(r.number for r in got if r.session_id == s) == list(range(6)) for s in "0123")
    changes = tmp_path / "changes"
    rows = [(1, "insert", "a", 1), (2, "insert", "b", 2), (1, "update", "c", 3), (2, "delete", "b", 4), (1, "insert", "a", 1)]
    schema = "id long, op string, value string, seq long"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(changes))
    sink = cdc.ChangeSink(["id"], "seq", str(tmp_path / "table"))
    cdc.run_to_end(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(changes)), sink, str(tmp_path / "state"))
    again = cdc.ChangeSink(["id"], "seq", str(tmp_path / "table"))  # after a restart
    again(spark.createDataFrame([(1, "delete", "z", 99)], schema), 0)  # delivered again
    assert {(r.id, r.value, r.deleted) for r in again.table(spark).collect()} == {(1, "c", False), (2, "b", True)}
    again(spark.createDataFrame([(1, "update", "d", 100)], schema), again.last(spark) + 1)
    assert {(r.id, r.value) for r in sink.table(spark).collect()} == {(1, "d"), (2, "b")}
