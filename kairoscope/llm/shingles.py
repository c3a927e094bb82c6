"""Word shingles of byte texts, hashed without a loop over words.

Words are runs without the bytes 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is a
polynomial of its bytes modulo 2**64, taken from running sums; a shingle's hash is one of its
words' hashes. Equal shingles have equal hashes; for unequal ones that is as unlikely as for any
64-bit hash of non-adversarial text.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A fixed pseudo-random 64-bit value for each byte.
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}
#: Texts are hashed in stretches of about this many bytes.
STRETCH = 2 << 20


def _powers(kind: str, n: int) -> np.ndarray:
    known = _POWERS[kind]
    if len(known) < n:
        step = np.full(max(n, 2 * len(known)), _BASE if kind == "base" else _INVERSE, np.uint64)
        step[0] = 1
        known = _POWERS[kind] = np.cumprod(step, dtype=np.uint64)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: bytes) -> np.ndarray:
    """The hash of every word of one text."""
    raw = np.frombuffer(data.translate(_LOWER), np.uint8)
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64)
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # stretches end at words, so that no power grows with the text
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH, side="right")))
        a, b = int(starts[at]), int(ends[stop - 1])
        m = b - a
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(_VALUES[raw[a:b]] * _powers("base", m), dtype=np.uint64, out=sums[1:])
        s, e = starts[at:stop] - a, ends[at:stop] - a
        out[at:stop] = mix((sums[e] - sums[s]) * _powers("inverse", m)[s] + (e - s).astype(np.uint64) * np.uint64(_STEP))
        at = stop
    return out


def shingle_set(data: bytes, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of k words in a row; of fewer words, one hash of all."""
    words = word_hashes(data)
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    h = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        h = h * np.uint64(_STEP) + words[i : n - size + 1 + i]
    return np.unique(mix(h + np.uint64(size)))
