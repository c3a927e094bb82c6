"""Groups, links and corpus counts of two tokenizers against both libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kairoscope.llm import token_alignment
from kairoscope.llm.bpe import byte_alphabet

TEXTS = "doc_id long, text string, chunk int, pairs string, n_a int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "p", 2) for i, t in rows], TEXTS).repartition(parts)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def groups_of(libraries, text):
    a, b = libraries
    if not text:
        return []
    to_byte = {c: x for x, c in byte_alphabet().items()}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return []
    ends = []
    for own in (bytes_a, bytes_b):
        at, mine = 0, set()
        for t in own:
            at += len(t)
            mine.add(at)
        ends.append(mine)
    cuts, out = sorted(ends[0] & ends[1]), []
    i = j = at_a = at_b = 0
    for cut in cuts:
        x, y = [], []
        while at_a < cut:
            x.append(ids_a[i])
            at_a += len(bytes_a[i])
            i += 1
        while at_b < cut:
            y.append(ids_b[j])
            at_b += len(bytes_b[j])
            j += 1
        out.append((x, y))
    return out


def expected(libraries, rows):
    groups = [groups_of(libraries, t) for _, t in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    count = Counter(p for own in links for p in own)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (i, _), g, own in zip(rows, groups, links, strict=True):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for p, n in own.items() if count[p] == top[p[0]])
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()), best, sum(count[p] * n for p, n in own.items()), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return out


def rows_of(seed=1, n=70):
    r = random.Random(seed)
    words = ["tion", "the", "Schön", "naïve", "世界", "👍", "<|endoftext|>", "<s>", "don't", "1234567", "\n\n", "  ", "\t", "ﬁ", " ", "x́", "aaaaaaaa", "réeaux", "antidisestablishment", "<0x41>"]
    rows = [(i, r.choice([" ", "", "  "]).join(r.choice(words) for _ in range(r.randint(1, 40)))) for i in range(n)]
    return rows + [(100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "\x00"), (None, "no id"), (None, None), (3, rows[5][1]), (3, rows[5][1]), (105, "ab" * 3_000), (106, "\n" * 700), (107, "é" * 5_000)]


def test_links_of_every_text(spark, libraries):
    rows = rows_of()
    got = [tuple(x) for x in token_alignment.align_tokens(table(spark, rows)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    want = expected(libraries, rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(x[4] for x in want) > sum(x[1] for x in want) > 500 and [x for x in want if x[0] == 103][0][1] == 0
    assert token_alignment.align_tokens(table(spark, []).limit(0)).count() == 0


def test_many_chunks_shards_and_buckets(spark, libraries, monkeypatch):
    """Every chunk of one row: the sums pass through several shards and buckets."""
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 50)
    monkeypatch.setattr(token_alignment, "SHARD_CHUNKS", 3)
    monkeypatch.setattr(token_alignment, "BUCKET_BYTES", 400)
    rows = rows_of(2, 40)
    got = [tuple(x) for x in token_alignment.align_tokens(table(spark, rows, 9)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected(libraries, rows)))


@pytest.mark.parametrize("wide", [0, 3, 4096])
def test_wide_groups_and_long_texts(libraries, monkeypatch, wide):
    monkeypatch.setattr(token_alignment, "WIDE", wide)
    monkeypatch.setattr(token_alignment, "LONG", 200)
    model = token_alignment.TwoTokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t or "" for _, t in rows_of(3, 30)]
    found = token_alignment.align_texts(model, texts)
    for k, t in enumerate(texts):
        own = found.text == k
        got = {(int(p) >> model.shift, int(p) & ((1 << model.shift) - 1)): int(n) for p, n in zip(found.pair[own], found.times[own], strict=True)}
        assert got == Counter((a, b) for x, y in groups_of(libraries, t) for a in x for b in y)
        assert found.n_links[k] == sum(got.values())


def test_gaps_that_nothing_spans():
    a, b = token_alignment.align(np.array([2, 3, 1, 4]), np.array([1, 4, 1, 2, 2]))
    assert a.tolist() == [0, 0, 1, 2] and b.tolist() == [0, 0, 1, 2, 2]
    a, b = token_alignment.align(np.array([5]), np.array([1, 1, 1, 1, 1]))
    assert a.tolist() == [0] and b.tolist() == [0] * 5
