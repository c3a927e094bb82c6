"""Rows that repeat an id, rows without one, long texts and clashing columns, against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_exact import shingles

from kairoscope.llm import decontaminate, jaccard_join, joins, quality_crf, set_links, suffix_dedup, warc

TEXTS = "doc_id long, text string, lang string, doc long, kept string, `group` int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "k", 2) for i, t in rows], TEXTS).repartition(3)


def removed(rows, length=50):
    """For each row (id, text): its bytes that a string covers which starts in a row with a smaller id."""
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1) if i is not None else ():
            low[b[p : p + length]] = min(low.get(b[p : p + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1) if i is not None else ():
            if low[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9)))
    return [" ".join(word() for _ in range(n)) for n in (40, 60, 80, 20_000)]


def test_suffix_dedup_of_repeated_and_missing_ids(spark, texts):
    a, b, c, long = texts
    rows = [(5, a), (7, a), (7, b), (7, b), (8, b[:100]), (8, None), (9, b + a), (None, a), (None, None), (10, long), (11, c + long[3000:90_000]), (11, long), (12, ""), (-3, long[500:700]), (12, "x" * 300), (13, "x" * 60)]
    got = suffix_dedup.remove_repeats(table(spark, rows), carry=["lang", "kept"]).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=key) == sorted(removed(rows), key=key)
    assert {(r.carried.lang, r.carried.kept) for r in got} == {("x", "k")}


@pytest.mark.parametrize("step", [5, 1])
def test_suffix_dedup_of_near_copies_with_equal_anchors(spark, texts, step):
    """Near copies often have the same anchors; with ids that differ by the number of groups (5) they are one group's."""
    a, b, c, _ = texts
    rows = []
    for n, text in enumerate([a, b, c, a + " " + b]):
        variants = [text, text + " x", "yy " + text, text[:120] + "#" + text[120:], text + " x"]
        rows += [(1 + n * 1000 + k * step, t) for k, t in enumerate(variants)]
    got = suffix_dedup.remove_repeats(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(removed(rows))
    assert sum(x[2] for x in removed(rows[:2])) == len(a)


def test_whole_characters(spark):
    passage = "é世" * 40
    rows = [(1, passage), (2, "ä" + passage[1:] + "ß end of it")]  # of ß, the first byte is a repeat
    for r in suffix_dedup.remove_repeats(table(spark, rows), whole_characters=True).collect():
        assert bytes(r.kept).decode() == (passage if r.doc_id == 1 else "ä end of it")
    assert {r.n_removed for r in suffix_dedup.remove_repeats(table(spark, rows)).where(F.col("doc_id") == 1).collect()} == {0}


def test_warc_of_repeated_and_missing_ids(spark, monkeypatch):
    r = random.Random(4)
    page = ["".join(r.choice("abc <>é") for _ in range(n)) for n in (1_000, 1_500, 900, 30_000)]
    rows = [(1, page[0]), (4, page[0]), (4, page[0]), (4, page[1]), (9, page[1]), (None, page[1]), (None, page[2]), (None, None), (5, page[2]), (6, page[2]), (7, page[3]), (3, page[3]), (8, "")]
    pages = spark.createDataFrame([(i, f"http://h/{n}", t, "d", 1) for n, (i, t) in enumerate(rows)], "page_id long, url string, html string, digest string, refers_to int").repartition(3)
    want = []
    for n, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        same = [j for j, u in rows if (u or "") == (t or "") and j is not None]
        top = max(same, default=None) if len(raw) >= 1_000 else None
        revisit = i is not None and top is not None and top > i
        want.append((f"http://h/{n}", i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    for most in (1_000_000, 0):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
        got = warc.archive_roundtrip(pages).select("url", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    index = warc.write_archives(warc.classify(pages))
    assert warc.read_records(index, stretch=20_000).rdd.getNumPartitions() > 1
    whole = {x.url: x.payload for x in warc.read_records(index.where("page_id = 7"), stretch=20_000).collect()}
    assert whole == {"http://h/10": page[3].encode()}
    assert warc.archive_roundtrip(pages.limit(0)).count() == 0


def test_jaccard_of_repeated_and_missing_ids(spark, texts, monkeypatch):
    a, b, c, long = texts
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(None, a), (1, a), (3, near), (3, b), (5, b + " more"), (5, b + " more"), (6, None), (7, " \t"), (8, long), (9, long + " end"), (9, c), (None, None), (12, c)]
    sets = [(i, shingles(t)) for i, t in rows]
    part = [i for i, _ in rows]
    for _ in range(5):
        for j, (i, x) in enumerate(sets):
            for m, (k, y) in enumerate(sets):
                if i is not None and k is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                    part[j] = part[m] = min(part[j], part[m])
    want = [(i, len(s), None if i is None else part[k]) for k, (i, s) in enumerate(sets)]
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_KEY_ROWS", 1)
    monkeypatch.setattr(set_links, "HOT_PAIRS", 1)
    monkeypatch.setattr(set_links, "HOT_ROWS", 1)
    got = [tuple(r) for r in jaccard_join.near_duplicates(table(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert part == [None, 1, 1, 3, 3, 3, 6, 7, 8, 8, 9, None, 9]


def test_overlaps_of_repeated_and_missing_ids(spark, texts):
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(1, "clean"), (1, "x " + item), (1, item), (2, None), (None, item), (3, texts[3] + " " + item), (4, ""), (5, "q0 q1 q2")]
    bench = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (None, item, "x"), (9, item, "x")], "item_id long, text string, doc string")
    got = {(r.doc_id, r.item_id): r.start for r in decontaminate.find_overlaps(table(spark, rows), bench).collect()}
    at = len(texts[3].split())
    assert got == {(i, j): s for i, s in ((1, 0), (3, at)) for j in (7, 9)}
    kept = decontaminate.remove_contaminated(table(spark, rows).withColumn("__hit", F.col("doc_id")), bench)
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect() if r.text != item) == [(2, None), (4, ""), (5, "q0 q1 q2")]
    assert decontaminate.find_overlaps(table(spark, rows).limit(0), bench).count() == decontaminate.find_overlaps(table(spark, rows), bench.limit(0)).count() == 0


def test_quality_against_enumeration(spark):
    """The marginals of every labelling, their mean by line length, and the curve, for whole documents."""
    r = random.Random(5)
    rows = [(i, "\n".join(" ".join(r.choice(["good", "words", "here."]) for _ in range(r.randint(1, 9))) if i % 2 else "#$ %& 99 " * r.randint(1, 5) for _ in range(r.randint(1, 5)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n \n"), (None, "good words here."), (3, rows[3][1]), (3, "$$$ ###"), (63, "good words here.\n" * 3_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    model = quality_crf.train(docs, labels)
    got = quality_crf.classify(docs, labels).collect()
    assert len(got) == len(rows)

    def enumerated(text):
        x, lengths = quality_crf.document_features(text)
        if not len(lengths):
            return model.prior
        node = model.node_scores(x)
        total, good = 0.0, np.zeros(len(node))
        for labelling in itertools.product((0, 1), repeat=len(node)):
            w = np.exp(sum(s for s, y in zip(node, labelling, strict=True) if y) + sum(model.pairs[a, b] for a, b in itertools.pairwise(labelling)))
            total += w
            good += w * np.array(labelling)
        share = min(max((good / total * lengths).sum() / lengths.sum(), 1e-6), 1 - 1e-6)
        return 1 / (1 + np.exp(-(model.slope * np.log(share / (1 - share)) + model.shift)))

    want = sorted(round(enumerated(t), 5) for i, t in rows if i != 63)
    assert sorted(round(x.score, 5) for x in got if x.doc_id != 63) == pytest.approx(want, abs=2e-5)
    assert all(x.predicted == int(x.score >= 0.3) and x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert next(x.score for x in got if x.doc_id == 63) > 0.9
    assert quality_crf.classify(docs.limit(0), labels).count() == 0
