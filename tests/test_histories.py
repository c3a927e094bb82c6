"""Substring joins, commit histories, snapshots and stretches of time, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from kairoscope.operators import events, paths, temporal
from kairoscope.sources import git_log
from kairoscope.storage import snapshot


def test_parts_of_paths(spark):
    r = random.Random(4)
    files = [(r.randrange(3), "".join(r.choice("ab/é.") for _ in range(r.randint(0, 12)))) for _ in range(150)] + [(0, None), (None, "ab"), (1, "aaaaaaaa"), (1, "a.b|c")]
    parts = [(r.randrange(4), "".join(r.choice("ab/é.") for _ in range(r.randint(0, 5)))) for _ in range(80)] + [(0, None), (1, ""), (1, "aaaa"), (1, "a.b|"), (2, "zzz"), (1, "aaaaaaaaa")]
    got = paths.contains_join(spark.createDataFrame(files, "repo_id int, path string"), spark.createDataFrame(parts, "repo_id int, part string")).collect()
    want = {(i, f, p) for i, f in files for j, p in parts if i == j and i is not None and f is not None and p and p in f}
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    nothing = spark.createDataFrame([], "repo_id int, part string")
    assert paths.contains_join(spark.createDataFrame(files, "repo_id int, path string"), nothing).count() == 0


def brute_ancestors(parents, start):
    seen, waiting = set(start), list(start)
    while waiting:
        for p in parents.get(waiting.pop(), []):
            if p not in seen:
                seen.add(p)
                waiting.append(p)
    return seen


def test_ancestors_of_a_tangled_history(spark):
    r = random.Random(3)
    parents = {f"c{i}": [f"c{r.randrange(max(0, i - 30), i)}" for _ in range(r.choice([1, 1, 1, 2, 3]))] if i else [] for i in range(200)}
    parents |= {f"x{i}": [f"x{i - 1}"] if i else ["gone"] for i in range(20)}
    table = spark.createDataFrame(list(parents.items()), "sha string, parents array<string>")
    history = git_log.History(table)
    for start in (["c199"], ["c120", "x5"], ["c0"], []):
        got = history.ancestors(spark.createDataFrame([(s,) for s in start], "sha string")).collect()
        assert {x.sha for x in got} == brute_ancestors(parents, start) and len(got) == len(brute_ancestors(parents, start))
    rows = lambda head, last: {x.sha for x in git_log.commit_range(table, head, last)[0].collect()}
    assert rows("c199", "c150") == brute_ancestors(parents, ["c199"]) - (brute_ancestors(parents, ["c150"]) if "c150" in brute_ancestors(parents, ["c199"]) else set())
    assert rows("c199", None) == brute_ancestors(parents, ["c199"]) == rows("c199", "x5") and rows(None, None) == set()
    assert [git_log.commit_range(table, "c199", c)[1] for c in (None, "unknown", "x5", "c0")] == [False, True, True, not ("c0" in brute_ancestors(parents, ["c199"]))]


def test_a_long_line_of_commits_takes_few_rounds(spark):
    n = 100_000
    line = spark.range(n).select(F.col("id").cast("string").alias("sha"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("parents"))
    history = git_log.History(line)
    assert len(history.jumps) <= 20
    found = history.ancestors(line.where("sha = '99990'").select("sha"))
    assert found.count() == 99_991


def test_lines_are_contracted_before_jumps(spark):
    """Commits taken out in rounds are reached again, and all rounds have a few rows for each commit; a commit that comes twice counts once."""
    r = random.Random(4)
    parents = {f"c{i}": [f"c{r.randrange(max(0, i - 9), i)}" for _ in range(r.choice([1, 1, 2]))] if i else [] for i in range(150)} | {"x": ["gone"]}
    table = spark.createDataFrame([*parents.items(), ("c149", parents["c149"])], "sha string, parents array<string>")
    history = git_log.History(table, most=20)
    assert len(history.jumps) <= 6 and sum(out.count() + near.count() for out, near in history.rounds) <= 3 * len(parents)
    for start in (["c149"], ["c90", "x"]):
        got = [x.sha for x in history.ancestors(spark.createDataFrame([(s,) for s in start], "sha string")).collect()]
        assert set(got) == brute_ancestors(parents, start) and len(got) == len(set(got))


def test_snapshots_have_all_of_a_change(spark, tmp_path):
    schema = "key long, seq long, op string"
    tables = snapshot.TableSet(spark, str(tmp_path / "set"), {"a": ["key"], "b": ["key"]}, "seq", buckets=2)
    assert tables.snapshot() == {"a": None, "b": None}
    row = lambda *r: spark.createDataFrame([r], schema)
    assert tables.merge({"a": row(1, 0, "insert"), "b": row(1, 0, "insert")}, 0)
    # A change that ends after its first table is in no snapshot, and whole once it is delivered again.
    tables.tables["a"].merge(row(2, 1, "insert"), 1)
    keys = lambda number=None: {n: {x.key for x in t.collect()} for n, t in tables.snapshot(number).items()}
    assert keys() == {"a": {1}, "b": {1}}
    assert tables.merge({"a": row(2, 1, "insert"), "b": row(1, 1, "delete")}, 1) and not tables.merge({"a": row(3, 1, "insert")}, 1)
    assert keys() == {"a": {1, 2}, "b": set()} and keys(0) == {"a": {1}, "b": {1}}


def stamped(spark, rows):
    return spark.createDataFrame(rows, "event_id long, k string, us long, tokens double").withColumn("ts", F.timestamp_micros("us"))


@pytest.fixture(scope="module")
def log():
    r = random.Random(12)
    at, rows = {"a": 0, "b": 5_000_000, "hot": -3_000_000}, []
    for i in range(900):
        k = r.choice(["a", "b", "hot", "hot", "hot"])
        at[k] += r.choice([0, 1, 999_999, 1_000_000, 1_000_001, 400_000, 3_000_000, 900_000_000 if r.random() < 0.05 else 10])
        rows.append((i, k, at[k], r.randrange(10) / 4))
    return rows


def test_windows_in_stretches(spark, log):
    table = stamped(spark, log)
    got = {x.event_id: (x.requests, x.tokens, x.admitted) for x in events.quota(table, "k", "ts", "tokens", 1, 3, 4.0).collect()}
    calls = {x.event_id: x.calls for x in events.calls_in_window(table, "k", "ts", 1).collect()}
    for i, k, us, _ in log:
        near = [t for _, other, at, t in log if other == k and us - 1_000_000 <= at <= us]
        assert calls[i] == len(near) and got[i] == (len(near), round(sum(near), 6), len(near) <= 3 and sum(near) <= 4.0)
    assert len(got) == len(calls) == len(log)


def test_bursts_and_debounce(spark, log):
    table = stamped(spark, log)
    burst = {x.event_id for x in events.latest_burst(table, "k", "ts", 1).collect()}
    accepted = {x.event_id for x in events.debounce(table, ["k"], "ts", 1).collect()}
    for key in ("a", "b", "hot"):
        own = sorted(((us, i) for i, k, us, _ in log if k == key))
        want, last = set(), None
        for us, i in reversed(own):
            if last is not None and last - us > 1_000_000:
                break
            want.add(i)
            last = us
        assert {i for _, i in own} & burst == want
        want, last = set(), None
        for us, i in own:
            if last is None or us - last >= 1_000_000:
                want.add(i)
                last = us
        assert {i for _, i in own} & accepted == want


def test_counts_with_open_ends(spark):
    r = random.Random(5)
    rows = [("p", r.choice("st"), "r", f"o{r.randrange(4)}", (start := r.randrange(0, 10**14)), None if r.random() < 0.5 else start + r.randrange(10**13)) for _ in range(150)]
    edges = spark.createDataFrame(list(dict.fromkeys(rows)), "project_id string, subject string, predicate string, object string, valid_from long, valid_to long").withColumn("edge_id", F.xxhash64(*temporal.EDGE))
    got = {tuple(x)[:-1]: x.contradictions for x in temporal.contradiction_counts(edges).select(*temporal.EDGE, "contradictions").collect()}
    end = lambda x: 1 << 62 if x[5] is None else x[5]
    for x in set(rows):
        assert got[x] == sum(y[:3] == x[:3] and y[3] != x[3] and y[4] <= end(x) and x[4] <= end(y) for y in set(rows))


def test_watched_tree_ends_as_a_whole_parse(spark, tmp_path):
    import os

    from kairoscope.sources import code, files
    from kairoscope.streaming.watch import Watcher

    root = tmp_path / "tree"
    (root / "pkg" / "node_modules").mkdir(parents=True)
    write = lambda name, text, at: ((root / name).write_text(text), os.utime(root / name, (at, at)))
    write("a.py", "def one():\n    two()\n\ndef two():\n    pass\n", 1_000)
    write("pkg/b.js", "function three() { four(); }\n", 1_000)
    write("pkg/node_modules/c.js", "function hidden() {}\n", 1_000)
    write("notes.txt", "no code", 1_000)

    def same(watcher):
        whole = code.parse_files(files.scan(spark, str(root), "r", [".py", ".js"]))
        stored = watcher.tables.snapshot()["items"].select(*whole.columns)
        assert sorted(map(repr, stored.collect())) == sorted(map(repr, whole.collect()))

    watch = lambda: Watcher(spark, str(tmp_path / "state"), str(root), "r")
    poll = lambda at: {(x.path, x.change) for x in watch().poll(at * 1_000_000).collect()}
    assert poll(1_000) == set()  # written just now
    assert poll(2_000) == {("a.py", "added"), ("pkg/b.js", "added")}
    same(watch())
    assert poll(2_001) == set()
    write("a.py", "def two():\n    return 1\n", 2_010)
    write("new.py", "class C:\n    def m(self):\n        pass\n", 2_010)
    (root / "pkg" / "b.js").unlink()
    assert poll(2_010) == {("pkg/b.js", "deleted")}  # the others wait
    assert poll(2_020) == {("a.py", "changed"), ("new.py", "added")}
    same(watch())
    query = watch().follow(lambda: 9_000 * 1_000_000)
    try:
        write("late.py", "def late():\n    pass\n", 3_000)
        for _ in range(60):
            if any(x.path == "late.py" for x in watch().tables.snapshot()["files"].collect()):
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    same(watch())


def test_lookups(spark):
    from kairoscope.functions import interval
    from kairoscope.operators import lookups

    nodes = spark.createDataFrame([("r", ["A", "B"], {"x": "1"}), ("r", ["A"], {"x": "1"}), ("s", ["A", "B"], {"x": "1"}), ("r", ["A", "B"], {}), ("r", None, None)], "repo_id string, labels array<string>, properties map<string,string>")
    assert lookups.label_scan(nodes, ["A", "B"], {"x": 1}, "r").count() == 1 and lookups.label_scan(nodes, []).count() == 5
    assert lookups.scoped(nodes, ["s"]).count() == 1 and lookups.scoped(nodes, None).count() == 5
    times = spark.createDataFrame([("2024-01-02T03:04:05.000006Z",), (None,), ("1970-01-01T00:00:00",)], "t string")
    assert [x[0] for x in times.select(interval.micros_of_text_strict(F.col("t"))).collect()] == [1_704_164_645_000_006, None, 0]
    with pytest.raises(Exception, match="no ISO time"):
        spark.createDataFrame([("yesterday",)], "t string").select(interval.micros_of_text_strict(F.col("t"))).collect()
