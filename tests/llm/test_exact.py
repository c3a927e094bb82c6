"""Operators against brute force on small tables with nulls, empty texts, ties, repeats and long texts."""

import hashlib
import os
import random
import re
import struct

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kairoscope.llm import bpe, compaction, components, decontaminate, induced_sort, jaccard_join, joins, lm_score, quality_crf, suffix_dedup, url_filter, warc, winnow
from kairoscope.session import scratch_path

TEXTS = "doc_id long, text string, lang string, source string, n_chars long, token string, `group` int"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark, rows):
    """Rows of (id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "x", 1) for i, t in rows], TEXTS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    out = []
    for _ in range(14):
        base = [r.choice(vocabulary) for _ in range(r.choice([2, 4, 5, 7, 12, 40, 90, 200]))]
        for _ in range(r.randint(1, 6)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 15))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            text = " ".join(own) + (" " + passage[: r.randint(5, 300)] if r.random() < 0.4 else "")
            out.append((len(out) * 3 - 20, text))
    out += [(1000, None), (1001, ""), (1002, "a"), (1003, "A"), (1004, " \n"), (1005, "x" * 4000), (1006, "x" * 4000), (1007, "é" * 60 + passage)]
    return out


def test_bpe_is_exact(spark, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(2000, "a  b\n c\t \x1c<|endoftext|> it's 日本 👍"), (2001, "ab" * 3000), (None, "no id")]
    got = bpe.encode_decode(table(spark, rows + extra)).collect()
    assert len(got) == len(rows) + len(extra)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows + extra}
    for r in got:
        assert r.ids == want[r.doc_id]
        assert r.decoded == library.decode(want[r.doc_id], skip_special_tokens=False)
    assert bpe.digest(bpe.encode_decode(table(spark, []))).count() == 0


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_components(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRS_FROM", 3)
    monkeypatch.setattr(jaccard_join, "TRIPLES_FROM", 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(table(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    own = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and own[a] < own[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    own[b] = own[a]
                    changed = True
    assert got == {i: (len(s), own[i]) for i, s in sets.items()}
    assert jaccard_join.near_duplicates(table(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_suffix_dedup(spark, rows):
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            low[b[p : p + 50]] = min(low.get(b[p : p + 50], i), i)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if low[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        assert got[i] == (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_induced_sort_spills_and_carries_common_prefixes():
    r = random.Random(1)
    for n in (1, 2, 60, 500, 3000):
        for k in (1, 2, 40, 256):
            text = bytes(r.randrange(k) if k == 256 else 97 + r.randrange(k) for _ in range(n))
            text = text[: n // 2] + text[: n - n // 2]
            for allowance in (64, 1 << 20):
                found = [(p, c) for positions, common in reversed(list(induced_sort.sorted_suffixes(np.frombuffer(text, np.uint8), 50, allowance))) for p, c in zip(positions.tolist(), common.tolist(), strict=True)]
                keys = [text[p : p + 50] for p, _ in found]
                assert sorted(p for p, _ in found) == list(range(n)) and keys == sorted(keys)
                assert [c for _, c in found] == [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(keys, keys[1:], strict=False)]


def test_queues_of_tuples_keep_their_order_on_disk():
    queues = induced_sort.TupleQueues(200)
    for i in range(0, 300, 3):
        queues.put(i % 2, np.arange(i, i + 3), np.full(3, i % 50))
    assert queues.spilled > 200
    for symbol in (0, 1):
        positions, common = queues.all(symbol)
        assert positions.tolist() == [j for i in range(0, 300, 3) if i % 2 == symbol for j in range(i, i + 3)]
        assert common.tolist() == [i % 50 for i in range(0, 300, 3) if i % 2 == symbol for _ in range(3)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def winnowed(text):
    runs = re.findall(r"[^\t-\r ]+", text)
    units = [xxhash.xxh64_intdigest(u.encode(), 42) for r in runs for u in ([r] if len(r) <= 16 else r)]

    def rolling(values):
        h = 0
        for v in values:
            h = (h << 1 | h >> 63) & (1 << 64) - 1 ^ v
        return signed(h)

    if not units:
        return []
    grams = [rolling(units[i : i + 4]) for i in range(max(1, len(units) - 3))]
    out = []
    for i in range(max(1, len(grams) - 4)):
        window = grams[i : i + 5]
        at = i + min(range(len(window)), key=lambda j: (window[j], -j))
        if not out or out[-1][0] != at:
            out.append((at, grams[at]))
    return out


def test_winnow(spark, rows):
    rows = [*rows, (1008, "日本語の文" * 30 + " w1 w2"), (1009, "w1 " * 40 + "日本語の文" * 7 + "é" * 17), (1010, "w1 w2 w3"), (1011, "a" * 16 + " " + "b" * 17)]
    got = {r.doc_id: r for r in winnow.digest(winnow.edited_against_next(table(spark, rows))).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    shown = lambda f: " ".join(f"{p}:{h % (1 << 64):x}" for p, h in f)
    for k, (i, text) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == shown(winnowed(text)) and got[i].edited_fingerprint == shown(winnowed(edited))
        a, b = {h for _, h in winnowed(text)}, {h for _, h in winnowed(after)}
        assert got[i].near_next == pytest.approx(1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b)))
    assert winnow.edited_against_next(table(spark, [])).count() == 0


def test_winnow_keeps_its_guarantee(spark):
    """Any K + WINDOW - 1 units in a row that two texts share bring a shared hash, in words and in text without spaces."""
    r = random.Random(8)
    n = winnow.K + winnow.WINDOW - 1
    shared = [" ".join(f"s{i}" for i in range(n)), "".join(chr(0x4E00 + i) for i in range(n))]
    filler = lambda sep: sep.join(chr(0x5000 + r.randrange(900)) for _ in range(r.randint(17, 40)))
    docs = [(2 * i + j, filler(sep) + sep + shared[kind] + sep + filler(sep)) for kind, sep in enumerate((" ", "")) for i in range(10 * kind, 10 * kind + 10) for j in (0, 1)]
    got = {x.doc_id: set(x.hashes) for x in winnow.fingerprint(table(spark, docs)).collect()}
    assert all(got[2 * i] & got[2 * i + 1] for i in range(20))


def test_winnow_of_missing_and_repeated_ids(spark):
    docs = [(None, "no id " * 9), (None, None), (4, "b c d"), (4, "a b c"), (9, "x " * 30)]
    got = sorted(((x.doc_id or 0), x.edited_sha256, x.near_next) for x in winnow.digest(winnow.edited_against_next(table(spark, docs))).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    edit = lambda t, u: t[: len(t) - len(t) // 2] + u[: len(t) // 2]
    texts = [(0, "no id " * 9, "no id " * 9), (0, "", ""), (4, "a b c", "b c d"), (4, "b c d", "x " * 30), (9, "x " * 30, "a b c")]
    assert [g[:2] for g in got] == sorted((i, sha(edit(t, u))) for i, t, u in texts)


def test_next_in_order_of_sparse_keys(spark):
    keys = [-(2**57), -5, 0, 1, 2**12, 2**30, 2**40 + 1, 2**57 - 1]
    got = {r.k: r.next for r in winnow.next_in_order(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()}
    assert got == dict(zip(keys, [*keys[1:], None], strict=True))


def test_warc_roundtrip(spark):
    long = "<p>" + "ö" * 900 + "</p>"
    data = [(1, "http://a/", long), (2, "http://b/", long), (3, None, "short"), (4, "http://d/\r\nX: y", "short"), (5, "http://e/", None), (6, "http://f/", long), (7, "x", "")]
    pages = spark.createDataFrame([(*d, "extra") for d in data], "page_id long, url string, html string, digest string")
    index = warc.write_archives(warc.classify(pages), scratch_path(spark, "test-warc"))
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert {i: got[i].refers_to for i, *_ in data} == {1: 6, 2: 6, 3: None, 4: None, 5: None, 6: None, 7: None}
    for i, _, html in data:
        raw = (html or "").encode()
        assert got[i].payload_digest == hashlib.sha1(raw).hexdigest() and got[i].payload_bytes == len(raw)
        assert (got[i].payload is None) == (i in (1, 2)) and (i in (1, 2) or bytes(got[i].payload) == raw)
    some = warc.read_records(index.where("page_id IN (2, 6)"))
    assert sorted(r.page_id for r in some.collect()) == [2, 6]
    assert warc.archive_roundtrip(pages.limit(0)).count() == 0


def test_ranges_are_coalesced():
    assert list(warc.coalesce_ranges([(0, 5), (6, 4), (50, 5), (55, 100)], gap=10, most=60)) == [[(0, 5), (6, 4)], [(50, 5)], [(55, 100)]]


def test_url_rules(spark):
    urls = {1: "https://A.example.NET/en/x?q#f", 2: "http://any-name.net/", 3: "http://example.net", 4: "https://example.com/de/1", 5: "http://a.org/fr/", 6: None, 7: "no scheme", 8: "ftp://www.casino-pills-bonus.example.biz?x", 9: "http://library.example.org/en/1", 10: "http://xexample.net/en/"}
    pages = spark.createDataFrame([(i, u, "h") for i, u in urls.items()], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("any-name.net", "/", "net/", "block")
    assert got[3][:3] == ("example.net", "", None)
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[6][:3] == ("", "", None) == got[7][:3]
    assert got[8] == ("www.casino-pills-bonus.example.biz", "", None, "block") and got[9][3] == "allow"
    assert got[10][2] == "net/"


_URL_SQL = """
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS hp FROM r),
s AS (SELECT page_id, translate(regexp_extract(hp, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(hp, length(regexp_extract(hp, '^[^/]*')) + 1) AS path FROM h),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS t(action, rh, rp)),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS ruled FROM s JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, ruled FROM s LEFT JOIN m USING (page_id)
"""


def test_url_rules_against_sql(spark):
    r = random.Random(9)
    part = lambda: r.choice(["a", "WWW.", "x.", "example", "Example", ".com", ".net", ".org", "/", "/en/", "/de/", "/fr/", "?", "#", "://", "é", ":8080", ""])
    urls = [(i, r.choice(["http://", "https://", "", "x"]) + "".join(part() for _ in range(r.randint(0, 9)))) for i in range(2000)] + [(2000, None), (2001, "http://" + "a." * 5000 + "net/" + "q" * 5000)]
    pages = pd.DataFrame(urls, columns=["page_id", "url"])
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.execute(_URL_SQL).fetchall()
    spark_pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("rule", F.lit(1)).repartition(3)
    got = url_filter.judge(spark_pages).collect()
    verdicts = {i: v for i, *_, v in want}
    assert sorted((x.page_id, x.host, x.path, x.rule or "") for x in got) == sorted((i, h, p, rule or "") for i, h, p, rule, _ in want)
    assert {x.verdict for x in got} == {"block", "allow"} and all(x.verdict == (verdicts[x.page_id] or ("block" if x.block_score >= 0.5 else "allow")) for x in got)
    both = url_filter.judge(spark.createDataFrame([(None, "http://a.net/"), (None, None), (1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")).collect()
    assert len(both) == 4 and url_filter.judge(spark_pages.limit(0)).count() == 0


def test_url_features_one_by_one():
    hosts, paths = ["ab.c", "", "aaaaaa", "é.org"], ["/x", "", "/aaaa", "/"]
    at, column = url_filter.features(hosts, paths)
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        alone = url_filter.features([h], [p])[1]
        assert column[at == i].tolist() == alone.tolist() and len(set(alone.tolist())) == len(alone)
    weights = url_filter.fit(url_filter.labelled_urls())
    assert url_filter.score(weights, hosts, paths)[2] == pytest.approx(url_filter.score(weights, hosts[2:3], paths[2:3])[0])


def test_url_model_on_hosts_left_out():
    labelled = url_filter.labelled_urls()
    right = {0: [], 1: []}
    for k in range(5):
        weights = url_filter.fit([x for i, x in enumerate(labelled) if i % 5 != k])
        rest = [x for i, x in enumerate(labelled) if i % 5 == k]
        for (*_, y), p in zip(rest, url_filter.score(weights, [x[0] for x in rest], [x[1] for x in rest]), strict=True):
            right[y].append((p >= 0.5) == bool(y))
    assert np.mean(right[0]) >= 0.9 and np.mean(right[1]) >= 0.9


def test_decontamination_tolerates_substitutions(spark, monkeypatch):
    item = [f"q{i}" for i in range(40)]
    fourth = [w if i % 4 else "zz" for i, w in enumerate(item)]
    half = [w if i % 2 else "zz" for i, w in enumerate(item)]
    docs = [(1, "x " * 30 + " ".join(item).upper() + "!"), (2, " ".join(fourth)), (3, " ".join(half)), (4, "clean words only"), (5, None), (6, ""), (7, " ".join(item[10:32])), (8, " ".join(item[:8]))]
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (2, None, "x"), (3, "short item", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_overlaps(table(spark, docs), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 1)}
    assert got[1, 1].start == 30 and got[1, 1].n_equal == 40 and got[2, 1].matched == 15
    kept = decontaminate.remove_contaminated(table(spark, docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]
    for module, name, value in ((joins, "BROADCAST_ROWS", 0), (joins, "HOT_KEY_ROWS", 1), (decontaminate, "HOT_HITS", 1)):
        monkeypatch.setattr(module, name, value)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(table(spark, docs), bench).collect()} == set(got)
    again = decontaminate.remove_contaminated(table(spark, docs), bench)
    assert again.columns == kept.columns and sorted(r.doc_id for r in again.collect()) == [3, 4, 5, 6, 8]


def test_lm_scores_prefer_the_target(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(("a", "b", "c") if i % 2 else ("x", "y", "z")) for _ in range(50))) for i in range(60)] + [(100, None), (101, " ")]
    target = spark.createDataFrame([(i,) for i in range(1, 30, 2)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(table(spark, docs), target).collect()}
    assert len(got) == 62 and got[100].score is None and got[101].n_words == 0
    assert max(got[i].score for i in range(31, 60, 2)) < min(got[i].score for i in range(0, 60, 2))
    assert lm_score.cross_entropy_difference(table(spark, []), target).count() == 0


def test_quality_of_lines(spark):
    r = random.Random(4)
    good = lambda: "\n".join(" ".join(r.choice(("the", "house", "river", "walks", "slowly")) for _ in range(12)) + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(r.choice(("BUY", "NOW", "$$$", "***", "!!")) for _ in range(9)) for _ in range(4))
    docs = [(i, good() if i % 2 else bad()) for i in range(120)] + [(500, None), (501, "")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_crf.classify(table(spark, docs), labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(120)) and 0 <= got[500].score <= 1
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(120))
    assert quality_crf.classify(table(spark, docs), labels.limit(0)).where("score <> 0.5").count() == 0


def test_forward_backward_against_all_labelings():
    from itertools import product

    scores, pairs = np.array([0.3, -1.0, 0.7, 2.0]), np.array([[0.5, -0.2], [0.1, 0.9]])
    weight = {y: np.exp(sum(s for s, l in zip(scores, y, strict=True) if l) + sum(pairs[a, b] for a, b in zip(y, y[1:], strict=False))) for y in product((0, 1), repeat=4)}
    good, _ = quality_crf.forward_backward(np.append(scores, 0.0), np.array([4, 0, 1]), pairs)
    for i in range(4):
        assert good[i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / sum(weight.values()))
    assert good[4] == pytest.approx(0.5)


def test_compaction_and_conflicts(spark):
    docs = spark.range(4000).withColumn("v", F.sha2(F.col("id").cast("string"), 256)).withColumn("none", F.lit(None).cast("string"))
    t = compaction.ShardedTable(spark, scratch_path(spark, "test-shards"), target_bytes=200_000)
    for k in range(6):
        t.append(docs.where(f"id % 6 = {k}").repartition(2))
    assert t.version() == 6 and t.entries().count() == 12
    before = t.read(6)
    assert t.compact() >= 1
    assert t.read().exceptAll(docs).count() == 0 and t.read().count() == 4000 == before.count()
    assert t.entries().count() < 12
    assert not t._commit(t.entries(3), 2)  # version 3 exists
    assert t.vacuum() > 0 and t.read().count() == 4000
    t.append(docs.limit(0))
    assert t.read().count() == 4000
