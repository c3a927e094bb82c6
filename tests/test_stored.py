"""Stored indexes, the keyed table and growing logs, against scans and plain loops."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoscope.operators import graph, retrieval, search
from kairoscope.session import materialise
from kairoscope.storage import keyed_table, text_index, vector_index
from kairoscope.storage.manifest import ConflictError, Manifest
from kairoscope.streaming import cdc, tail_source

# Vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def cloud():
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 24))
    rows = [(int(i), (centres[i % 12] + 0.4 * r.normal(size=24)).astype(np.float32).tolist()) for i in range(1500)]
    hot = rows[0][1]
    rows += [(10_000 + i, hot) for i in range(700)]  # one vector that a third of the rows have
    return rows + [(20_000, None), (20_020, []), (20_040, [0.0] * 24), (20_060, [float("nan")] * 24), (20_080, [1.0] * 7)]


def test_vector_index(spark, cloud, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 150)
    e = vectors(spark, cloud)
    asked = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = vector_index.VectorIndex.create(e.where("vec_id % 2 = 0"), str(tmp_path / "index"))
    index.append(e.where("vec_id % 2 = 1"))
    index = vector_index.VectorIndex(spark, str(tmp_path / "index"))  # as another session finds it
    assert index.rows().count() == 2200 and index.cells().where("blocks > 1").count() > 0
    ok = e.where(F.size("embedding") == 24)
    truth = materialise(retrieval.dense_topk_each(ok, asked, 10, "query_id").withColumnRenamed("vec_id", "key"), "truth")
    exact = index.search(asked, 10, exact=True)
    rows = lambda df: sorted((x.query_id, x["rank"], x.key, round(x.score, 6)) for x in df.collect())
    assert rows(exact) == rows(truth)
    found = vector_index.recall(index.search(asked, 10), truth, "query_id").agg(F.sum("hits") / F.sum("wanted")).first()[0]
    assert found >= 0.9
    assert {x.query_id for x in exact.collect()} & {20_000, 20_020, 20_040, 20_060, 20_080} == set()


def test_blocks_of_questions(spark, cloud, monkeypatch):
    e = vectors(spark, cloud)
    asked = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    one = {tuple(x) for x in retrieval.dense_topk_each(e, asked, 7, "query_id").collect()}
    monkeypatch.setattr(retrieval, "ASKED_BYTES", 0)
    monkeypatch.setattr(retrieval, "QUESTIONS", 20)
    monkeypatch.setattr(retrieval, "ROWS", 300)
    assert {tuple(x) for x in retrieval.dense_topk_each(e, asked, 7, "query_id").collect()} == one
    assert {x[1] for x in one if x[0] == 20_080} == {20_080}  # only vectors of its length


# Walks


def test_a_hub_costs_its_budget(spark):
    edges = spark.range(100_000).select(F.lit("p").alias("project_id"), F.lit("hub").alias("src"), F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("dst"), (1.0 / (1 + F.col("id"))).alias("weight"))
    extra = spark.createDataFrame([("p", "q", "hub", 5.0), ("p", "n000003", "far", 0.5), ("r", "hub", "other", 9.0)], edges.schema)
    seeds = spark.createDataFrame([(1, "p", "q"), (2, "p", "hub"), (3, "r", "none")], "query_id int, project_id string, node string")
    got = {(x.query_id, x.node) for x in graph.capped_reach(edges.union(extra), seeds, 3, 6).collect()}
    assert got == {(1, "q"), (1, "hub"), *((1, f"n00000{i}") for i in range(4)), (2, "hub"), (2, "q"), *((2, f"n00000{i}") for i in range(4)), (3, "none")}


def brute_reach(edges, seeds, hops, most):
    seen, frontier = set(seeds), set(seeds)
    for _ in range(hops):
        found = {}
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if x in frontier and y not in seen:
                    found[y] = max(found.get(y, 0), round(w, 12))
        room = len(found) if most is None else max(0, most - len(seen))
        frontier = set(sorted(found, key=lambda y: (-found[y], y))[:room])
        seen |= frontier
    return seen


@pytest.mark.parametrize("most", [None, 4, 9, 20])
def test_reach_against_loops(spark, most):
    r = random.Random(5)
    edges = [(r.choice("ab"), f"n{r.randrange(40):02}", f"n{r.randrange(40):02}", r.choice([0.5, 1.0, r.random()])) for _ in range(120)]
    seeds = [(q, r.choice("ab"), f"n{r.randrange(40):02}") for q in range(6) for _ in range(r.randint(1, 5))]
    got = graph.capped_reach(spark.createDataFrame(edges, "project_id string, src string, dst string, weight double"), spark.createDataFrame(seeds, "query_id int, project_id string, node string"), 3, most).collect()
    want = set()
    for q, p in {(q, p) for q, p, _ in seeds}:
        own = [(a, b, w) for project, a, b, w in edges if project == p]
        want |= {(q, p, n) for n in brute_reach(own, {n for x, y, n in seeds if (x, y) == (q, p)}, 3, most)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("tolerance", [1e-6, 0.05])
def test_each_walk_ends_by_itself(spark, tolerance):
    r = random.Random(6)
    edges = [(q, r.randrange(9), r.randrange(9), r.random() + 0.1) for q in range(5) for _ in range((3, 12, 25, 6, 1)[q])]
    edges += [(7, 0, 1, 1.0)]  # ends after two rounds
    seeds = [(q, n) for q in (0, 1, 2, 3, 4, 7) for n in range(2)] + [(9, 4)]  # nothing leaves the last
    got = {(x.q, x.node): x["rank"] for x in graph.walk_each(spark.createDataFrame(edges, "q int, src int, dst int, weight double"), spark.createDataFrame(seeds, "q int, node int"), ["q"], 0.15, tolerance=tolerance).collect()}
    rounds = set()
    for q in (0, 1, 2, 3, 4, 7, 9):
        own = {n for x, n in seeds if x == q}
        seed = np.array([1 / len(own) if n in own else 0 for n in range(9)])
        step = np.zeros((9, 9))
        for x, a, b, w in edges:
            if x == q:
                step[b, a] += w
        step /= np.maximum(step.sum(axis=0), 1e-300)
        rank = seed
        for n in range(12):
            new = 0.15 * seed + 0.85 * step @ rank
            moved, rank = np.abs(new - rank).sum(), new
            if moved < tolerance:
                break
        rounds.add(n)
        for node in range(9):
            assert got.get((q, node), 0.0) == pytest.approx(rank[node], abs=1e-12)
    assert len(rounds) > 1


def test_retrieval_with_and_without_a_budget(spark):
    r = random.Random(9)
    edges = [("p", f"n{r.randrange(30):02}", "knows", f"n{r.randrange(30):02}", i, None, r.random(), r.random(), 0) for i in range(150)]
    table = spark.createDataFrame(edges, "project_id string, subject string, predicate string, object string, valid_from long, valid_to long, confidence double, relevance double, contradictions int")
    seeds = spark.createDataFrame([(1, "p", "n01"), (2, "p", "n02")], "query_id int, project_id string, node string")
    whole = search.temporal_retrieve(table, seeds, 100, max_edges=500, max_nodes=None).collect()
    capped = search.temporal_retrieve(table, seeds, 100, max_edges=500, max_nodes=8).collect()
    nodes = lambda rows, q: {n for x in rows if x.query_id == q for n in (x.subject, x.object)}
    assert 0 < len(capped) < len(whole) and all(len(nodes(capped, q)) <= 8 < len(nodes(whole, q)) for q in (1, 2))
    assert search.node_budget(10) == 60 and search.node_budget(1) == 32


# Texts


def test_text_index_is_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "FIRST", 2)
    r = random.Random(2)
    words = [f"word{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(words[: r.choice([5, 20, 60])]) for _ in range(r.randint(0, 40)))) for i in range(400)] + [(900, None), (901, ""), (902, "ab cd"), (903, "word1 " * 3000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(4))) for i in range(12)] + [(50, "nothing here"), (51, None), (52, "")], "item_id long, text string")
    index = text_index.TextIndex(spark, str(tmp_path / "texts"), block=16)
    index.append(table.where("doc_id < 150"))
    index.append(table.where("doc_id >= 150"))
    found, counts = text_index.TextIndex(spark, str(tmp_path / "texts")).topk(asked, 6, "item_id")
    rows = lambda df, key: sorted((x.item_id, x[key], round(x.score, 6), x["rank"]) for x in df.collect())
    assert rows(found, "key") == rows(retrieval.bm25(table, asked, 6), "doc_id")
    total = counts.agg(F.sum("read"), F.sum("postings")).first()
    assert 0 < total[0] < total[1]


# The keyed table


def folded(batches):
    table = {}
    for batch in batches:
        for key, seq, value, op in batch:
            if key not in table or seq >= table[key][0]:
                table[key] = (seq, value, op == "delete")
    return table


SCHEMA = "id long, seq long, value string, op string"


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_keyed_table_rewrites_what_a_batch_touches(spark, tmp_path):
    path = str(tmp_path / "table")
    first = [(i, i, f"value {i} " * 5, "insert") for i in range(3000)]
    assert keyed_table.KeyedTable(spark, path, ["id"], "seq", buckets=32).merge(spark.createDataFrame(first, SCHEMA), 0)
    whole = size_of(path)
    second = [(5, 9_000, "new", "update"), (6, 9_001, None, "delete"), (7, 1, "late", "update"), (9_999, 9_002, "added", "insert")]
    table = keyed_table.KeyedTable(spark, path, ["id"], "seq")  # after a restart; the number of buckets is the table's
    assert table.buckets == 32 and table.merge(spark.createDataFrame(second, SCHEMA), 1)
    assert size_of(path) - whole < 0.3 * whole
    assert not table.merge(spark.createDataFrame([(1, 10**6, "again", "update")], SCHEMA), 1)
    rows = lambda df: {x.id: (x.seq, x.value) for x in df.collect()}
    want = {k: v[:2] for k, v in folded([first, second]).items() if not v[2]}
    assert rows(table.table()) == want and rows(table.table(0)) == {k: v[:2] for k, v in folded([first]).items()}
    assert table.merge(spark.createDataFrame([], SCHEMA), 2) and table.batch() == 2
    assert table.merge(spark.createDataFrame([(None, 5, "no key", "insert"), (None, 6, "no key", "insert")], SCHEMA), 3)
    assert rows(table.table()) == want | {None: (6, "no key")}
    table.vacuum()
    assert rows(table.table()) == want | {None: (6, "no key")} and len(table.manifest.numbers()) == 1
    with pytest.raises(ConflictError):
        Manifest(spark, path).commit(table.manifest.last(), {})


def test_deleted_keys_go_behind_the_horizon(spark, tmp_path):
    table = keyed_table.KeyedTable(spark, str(tmp_path / "t"), ["id"], "seq", buckets=1, horizon=100)
    table.merge(spark.createDataFrame([(1, 10, "a", "insert"), (1, 11, None, "delete"), (2, 12, "b", "insert")], SCHEMA), 0)
    table.merge(spark.createDataFrame([(1, 5, "stale", "update")], SCHEMA), 1)
    assert {(x.id, x.deleted) for x in table.rows().collect()} == {(1, True), (2, False)}
    table.merge(spark.createDataFrame([(3, 500, "c", "insert")], SCHEMA), 2)
    assert {(x.id, x.deleted) for x in table.rows().collect()} == {(2, False), (3, False)}


def test_equal_order_has_one_result(spark, tmp_path):
    ties = [(1, 1, v, "insert") for v in "abcdefgh"]
    got = set()
    for n in range(3):
        table = keyed_table.KeyedTable(spark, str(tmp_path / f"t{n}"), ["id"], "seq", buckets=2)
        table.merge(spark.createDataFrame(random.Random(n).sample(ties, 8), SCHEMA).repartition(n + 1), 0)
        got.add(table.table().first().value)
    assert len(got) == 1


# Growing logs


class Kept:
    """A sink that notes what it gets and fails when it is told to."""

    def __init__(self):
        self.rows, self.fail = [], False

    def __call__(self, batch, number):
        rows = [tuple(x) for x in batch.collect()]
        if self.fail and rows:
            raise RuntimeError("sink")
        self.rows += [(os.path.basename(f), b, line) for f, b, line in rows]


def test_lines_of_growing_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    one, two = logs / "one.jsonl", logs / "two.jsonl"
    sink, state = Kept(), str(tmp_path / "state")

    def run():
        cdc.run_to_end(tail_source.stream_lines(spark, str(logs), split=7), sink, state)
        found, sink.rows = sorted(sink.rows), []
        return found

    one.write_bytes(b'{"a":1}\n\n{"b":2}\npart')
    two.write_bytes(b"no end yet")
    assert run() == [("one.jsonl", 0, '{"a":1}'), ("one.jsonl", 9, '{"b":2}')]
    one.write_bytes(one.read_bytes() + b"ly\n\xff\xfe\n" + "é世 last\n".encode())
    two.write_bytes(two.read_bytes() + b"\n")
    sink.fail = True
    with pytest.raises(Exception, match="sink"):
        run()
    sink.fail = False
    assert run() == [("one.jsonl", 17, "partly"), ("one.jsonl", 27, "é世 last"), ("two.jsonl", 0, "no end yet")]
    assert run() == []
    one.write_bytes(b"cut\n")  # truncated
    two.write_bytes(b"another begin, and longer\nsecond\n")  # replaced
    assert run() == [("one.jsonl", 0, "cut"), ("two.jsonl", 0, "another begin, and longer"), ("two.jsonl", 26, "second")]


def test_splits_have_each_line_once(tmp_path):
    r = random.Random(1)
    lines = ["x" * r.choice([0, 1, 2, 5, 30, 200]) + str(i) for i in range(300)]
    path = tmp_path / "a.log"
    path.write_text("\n".join(lines) + "\n")
    for split in (1, 3, 64, 1000, 10**6):
        reader = tail_source.TailReader(str(path), split)
        end = reader.latestOffset()
        got = [x for p in reader.partitions({}, end) for x in reader.read(p)]
        assert [x[2] for x in got] == lines and json.loads(json.dumps(end)) == end
        assert all(path.read_bytes()[b:].startswith(line.encode() + b"\n") for _, b, line in got)
