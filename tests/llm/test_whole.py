"""Whole jobs: nothing of the input, the vocabulary or the accepted overlaps is left out."""

import random
from itertools import combinations
from math import ceil

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kairoscope.llm import compaction, decontaminate, lm_score
from kairoscope.session import scratch_path

TEXTS = "doc_id long, text string"


def test_lm_scores_with_every_word(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "GROUP_BYTES", 3_000)
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 2_000)
    r = random.Random(5)
    word = lambda: f"W{int(r.paretovariate(0.6)) % 5000}"
    docs = [(i, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(150)]
    docs += [(200, docs[3][1]), (3, docs[3][1]), (201, None), (202, " \n"), (203, "ÄÖ äö W1\tw1"), (204, "only here twice only here twice")]
    docs += [(300 + i, " ".join(["w1"] * 50 + [f"rare{i}"] * 3)) for i in (0, 1)]
    documents = pd.DataFrame(docs, columns=["doc_id", "text"]).drop_duplicates("doc_id")
    labels = pd.DataFrame([(i, int(i % 3 == 0)) for i in range(301)], columns=["doc_id", "quality"])
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("labels", labels)
    want = {x[0]: x[1:] for x in con.execute(lm_score.oracle_sql()).fetchall()}
    rows = [(int(i), None if t is None else t) for i, t in documents.itertuples(index=False)]
    good = spark.createDataFrame([(int(i),) for i, q in labels.itertuples(index=False) if q], "doc_id long")
    got = {x.doc_id: x for x in lm_score.cross_entropy_difference(spark.createDataFrame(rows, TEXTS).repartition(3), good).collect()}
    assert set(got) == set(want) and got[201].n_words == got[202].n_words == 0
    for i, (n, *losses) in want.items():
        assert got[i].n_words == n
        assert [got[i].target_loss, got[i].background_loss, got[i].score] == (losses if n == 0 else pytest.approx(losses, abs=2e-6))
    assert abs(got[300].score - got[301].score) > 0.01  # they differ in a rare word only, which the target has from 300


def test_every_accepted_pattern_has_a_seed():
    for n in range(1, decontaminate.WINDOW + 1):
        masks = [m for m, least, most in decontaminate.SEEDS if least <= n and (most is None or n <= most)]
        spots = [{i + o for o in m} for m in masks for i in range(n - max(m))]
        for replaced in combinations(range(n), n - ceil(n * decontaminate.SHARE)):
            assert any(not spot & set(replaced) for spot in spots), (n, replaced)


def test_overlaps_against_all_diagonals(spark):
    r = random.Random(11)
    # Each item has words of its own, so that a hit can only be where it was put.
    items = [(n, [f"i{n}x{i}" for i in range(n)]) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 14, 15, 16, 17, 18, 19, 20, 33)]
    docs = [(0, ["clean", "words"]), (1, [])]
    puts = {n: [r.sample(range(min(n, 20)), r.randint(0, min(n, 20) // 4 + 1)) for _ in range(12)] for n, _ in items}
    puts[15].append([5, 8, 13])
    puts[20].append([3, 6, 9, 12, 15])
    for n, item in items:
        for replaced in puts[n]:
            words = [f"z{r.randrange(99)}" if i in replaced else w for i, w in enumerate(item)]
            docs.append((len(docs), ["a"] * r.randint(0, 3) + words + ["b"] * r.randint(0, 3)))
    want = {}
    for d, have in docs:
        for n, item in items:
            window, found = min(n, decontaminate.WINDOW), []
            for diagonal in range(-n, len(have) + 1):
                equal = [0 <= j + diagonal < len(have) and have[j + diagonal] == w for j, w in enumerate(item)]
                found.append((max(sum(equal[s : s + window]) for s in range(n - window + 1)), sum(equal), -diagonal))
            matched, n_equal, back = max(found)
            if matched >= ceil(window * decontaminate.SHARE):
                want[d, n] = (-back, window, matched, n_equal)
    table = lambda rows, schema: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], schema)
    got = decontaminate.find_overlaps(table(docs, TEXTS), table(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): (x.start, x.window, x.matched, x.n_equal) for x in got} == want
    assert {n for _, n in want} == {n for n, _ in items}


def test_compaction_goes_on_behind_a_settled_tier(spark, monkeypatch):
    t = compaction.ShardedTable(spark, scratch_path(spark, "settled"), target_bytes=2_000_000)
    docs = spark.range(60_000).selectExpr("id", "sha2(cast(id as string), 512) AS v")
    for _ in range(4):
        t.append(spark.range(10).selectExpr("id", "cast(id as string) AS v").coalesce(1))
    for k in range(4):
        t.append(docs.where(f"id % 4 = {k}").repartition(1))
    assert t.tiers().select("tier").distinct().count() == 2
    merge = t._merge
    low = {r.file for r in t.tiers().orderBy("tier").limit(4).collect()}

    def kept_apart(files, total, folder):
        """The lower tier stays as many files as before."""
        if set(files) == low:
            spark.read.parquet(*files).repartition(4).write.parquet(folder)
        else:
            merge(files, total, folder)

    monkeypatch.setattr(t, "_merge", kept_apart)
    assert t.compact() == 2
    assert t.read().count() == 60_040 and t.entries().where("rows > 1000").count() < 4


def test_compaction_of_an_empty_table(spark):
    for batch in (None, "k"):
        t = compaction.ShardedTable(spark, scratch_path(spark, "empty"))
        rows = spark.range(5).withColumn("k", F.lit(1))
        assert t.append(rows.limit(0), batch) == 1
        assert t.compact() == 0
        t.vacuum()
        assert t.read().columns == ["id", "k"] and t.read().count() == 0
        t.append(rows, batch)
        assert t.read().count() == 5 and t.read(1).count() == 0
