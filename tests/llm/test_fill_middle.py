"""Cuts by run-length classes against slicing, over every kind of text."""

import hashlib
import random

import numpy as np

from kairoscope.llm import fill_middle

TEXTS = "doc_id long, text string, form string, h1 string, `group` int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "f", "h", 2) for i, t in rows], TEXTS).repartition(3)


def expected(doc, text):
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_every_text_is_cut_and_rebuilt(spark):
    r = random.Random(3)
    letters = "ab \n<>PSM" + "éß" + "世界―" + "👍𝄞" + "\x00́"
    rows = [(i, "".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 3, 9, 60, 400])))) for i in range(-40, 260)]
    rows += [(500, None), (501, ""), (None, "no id"), (None, None), (7, "again"), (7, "again"), (7, "other <P> text"), (502, "<S"), (503, "ends in <")]
    rows += [(510 + k, t * 400_000) for k, t in enumerate(("abcde", "é世👍a", "世"))]
    got = [tuple(x) for x in fill_middle.transform(table(spark, rows)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    want = [(i, *expected(i, t)) for i, t in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {x[1] for x in map(lambda x: expected(*x), rows)} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = [(x.doc_id, x.output_sha256, x.restored_sha256) for x in fill_middle.digest(fill_middle.transform(table(spark, rows))).collect()]
    assert sorted(map(repr, digests)) == sorted(repr((i, sha(expected(i, t)[4]), sha(t or ""))) for i, t in rows)
    assert fill_middle.transform(table(spark, []).limit(0)).count() == 0


def test_shares_are_parameters(spark):
    rows = table(spark, [(i, "some text") for i in range(300)])
    assert {x.form for x in fill_middle.transform(rows, cut=100, suffix_first=100).collect()} == {"spm"}
    assert {x.form for x in fill_middle.transform(rows, cut=0).collect()} == {"plain"}


def test_runs_are_maximal_over_stretches(monkeypatch):
    monkeypatch.setattr(fill_middle, "STRETCH", 7)
    r = random.Random(4)
    texts = ["".join(r.choice("abcéß世👍") * r.randint(1, 9) for _ in range(r.randint(1, 12))) for _ in range(60)]
    data = [t.encode() for t in texts]
    begins = np.cumsum([0, *map(len, data)])
    index = fill_middle.ClassRuns.of(np.frombuffer(b"".join(data), np.uint8), begins[:-1])
    wide = [(len(c.encode()), k) for k, t in enumerate(texts) for c in t]
    assert len(index.units) == 1 + sum(a != b for a, b in zip(wide, wide[1:], strict=False))
    every = "".join(texts)
    at = [len(every[:k].encode()) for k in range(len(every) + 1)]
    assert index.bytes_before(np.arange(len(every) + 1)).tolist() == at
    assert index.units_before(np.array(at)).tolist() == list(range(len(every) + 1))
