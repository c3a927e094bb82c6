"""Components of 2-word shingles against all pairs, and what sketches promise."""

import random

import numpy as np
import pytest
from test_exact import LOWER

from kairoscope.llm import joins, minhash_dedup, set_links

TEXTS = "doc_id long, text string, row long, keys string, sig int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], TEXTS).repartition(3)


def shingles(text, k=2):
    w = (text or "").encode().translate(LOWER).replace(b"\x0b", b" ").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    part = [i for i, _ in rows]
    for _ in range(8):
        for j, (i, _) in enumerate(rows):
            for m in range(j):
                if i is not None and rows[m][0] is not None and sets[j] and sets[m] and 100 * len(sets[j] & sets[m]) >= 80 * len(sets[j] | sets[m]):
                    part[j] = part[m] = min(part[j], part[m])
    return [(i, len(s), p, i == p) for (i, _), s, p in zip(rows, sets, part, strict=True)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(80)]
    out = []
    for _ in range(16):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 6, 11, 40, 120, 300]))]
        for _ in range(r.randint(1, 7)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 14))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            out.append((len(out) * 5 - 30, " ".join(own + (passage if r.random() < 0.3 else []))))
    long = " ".join(f"u{r.randrange(9_000)}" for _ in range(20_000))
    out += [(900, long), (901, long + " end"), (902, None), (903, ""), (904, " \n"), (905, "One"), (906, "one"), (907, "one one"), (908, "one one one")]
    return out + [(None, out[0][1]), (None, None), (1, out[3][1]), (1, out[9][1]), (1, out[9][1])]


@pytest.mark.parametrize("forced", [False, True])
def test_components(spark, rows, monkeypatch, forced):
    if forced:  # nothing is sent to all executors, and every key with two rows is hot
        for module, name, value in ((joins, "BROADCAST_ROWS", 0), (joins, "HOT_KEY_ROWS", 1), (set_links, "HOT_PAIRS", 1), (set_links, "HOT_ROWS", 1)):
            monkeypatch.setattr(module, name, value)
    got = [tuple(x) for x in minhash_dedup.near_duplicates(table(spark, rows)).collect()]
    want = [(i, n, p, True if i is None else k) for i, n, p, k in expected(rows)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len({p for i, _, p, _ in want}) < len(rows) - 20


def test_no_rows(spark):
    assert minhash_dedup.near_duplicates(table(spark, []).limit(0)).count() == 0


def test_every_coordinate_is_filled_and_tells_the_similarity():
    r = np.random.default_rng(1)
    sets, similarity = [], []
    for n in (1, 2, 5, 50, 400, 5_000):
        for share in (0.0, 0.5, 0.8, 1.0):
            both = round(n * 2 * share / (1 + share)) if share < 1 else n
            x, y, z = np.split(r.integers(1, 1 << 63, 2 * n - both, dtype=np.uint64), [both, n])
            sets += [np.sort(np.append(x, y)), np.sort(np.append(x, z))]
            similarity.append(both / (2 * n - both))
    found = minhash_dedup.sketches(sets)
    assert not (found == minhash_dedup._OPEN).any()
    assert np.array_equal(found, np.concatenate([minhash_dedup.sketches([s]) for s in sets]))  # whatever is beside it
    equal = (found[0::2] == found[1::2]).mean(axis=1)
    assert np.abs(equal - similarity).max() < 0.1
    bits = minhash_dedup.sketch_bits(found)
    different = np.array([sum(int(a ^ b).bit_count() for a, b in zip(x.view(np.uint64), y.view(np.uint64), strict=True)) for x, y in zip(bits[0::2], bits[1::2], strict=True)])
    assert np.abs(different / minhash_dedup.COORDINATES - (1 - np.array(similarity)) / 2).max() < 0.1
    linked = np.array(similarity) >= 0.8
    assert (different[linked] <= minhash_dedup.most_bits(80)).all()


def test_a_pair_at_the_threshold_is_found():
    """Of pairs that share just 0.8, all meet in a band and none is ruled out by its bits."""
    r = np.random.default_rng(2)
    sets = []
    for n in (5, 9, 18, 90, 450) * 30:
        tokens = r.integers(1, 1 << 63, n + n // 9 if n > 5 else 5, dtype=np.uint64)
        sets += [np.sort(tokens[:n] if n > 5 else tokens), np.sort(tokens[len(tokens) - n :] if n > 5 else tokens[1:])]
    found = minhash_dedup.sketches(sets)
    keys, bits = minhash_dedup.band_keys(found), minhash_dedup.sketch_bits(found)
    for a, b in zip(range(0, len(sets), 2), range(1, len(sets), 2), strict=True):
        assert len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
        assert (keys[a] == keys[b]).any()
        assert sum(int(x ^ y).bit_count() for x, y in zip(bits[a].view(np.uint64), bits[b].view(np.uint64), strict=True)) <= minhash_dedup.most_bits(80)
