"""External suffix sorting by induction: tuples with their common prefixes wait in queues on disk.

A suffix whose first different symbol to the right is larger is rising (S), else falling (L); an S*
suffix is a rising one behind a falling one. The S* suffixes of a symbol are put in order first. From
them all falling suffixes follow in sorted order, and from those all rising ones: the suffix one
symbol to the left of a sorted suffix goes to the queue of its own first symbol, behind what is
there. Each tuple carries the length of the prefix that it has in common with the one before it in
its queue. That length follows from the sources: one more than the least common prefix between them.
So no suffix is compared with its neighbour after the sort.

Queues hold position and common prefix. What exceeds ``allowance`` goes to an unnamed temporary file
and is read back part by part; the types of the suffixes and other arrays of the text's length are mapped
files beyond ``MAPPED`` bytes, as the text is. So a sort needs memory for these, one part of a queue
and the S* suffixes of one symbol, whatever the length of the text.

The order is exact to ``depth`` symbols, and common prefixes are capped there. S* suffixes are named
by their first eight symbols; the order of those with equal names recurs on the symbols behind.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that the queues of one direction hold in memory, and the size from which arrays as long as the text are mapped files.
ALLOWANCE, MAPPED = 6 << 20, 64 << 20
#: Suffixes that one step handles, and symbols that are typed at once.
STEP, STRETCH = 1 << 19, 1 << 20
_Tuples = tuple[np.ndarray, np.ndarray]


def large_array(n: int, dtype: type, mapped: int = MAPPED) -> np.ndarray:
    """Zeros in memory, or in an unnamed file where they would exceed ``mapped`` bytes."""
    if n * np.dtype(dtype).itemsize <= mapped:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype, "r+", shape=(n,))


class TupleQueues:
    """A monotone priority queue: first-in first-out queues of tuples by first symbol, on disk beyond ``allowance`` bytes."""

    def __init__(self, allowance: int, longest: int = 1 << 62):
        """``longest``: an upper bound of the positions."""
        self.parts: list[list[_Tuples | tuple[int, int]]] = [[] for _ in range(256)]
        self.kind = np.dtype(np.uint32 if longest < 1 << 32 else np.int64)
        self.width = self.kind.itemsize + 1
        self.allowance, self.held, self.file, self.spilled = allowance, 0, None, 0

    def put(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.parts[symbol].append((positions.astype(self.kind), common.astype(np.uint8)))
        self.held += self.width * len(positions)
        if self.held > self.allowance:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts:
            if waiting := [p for p in parts if isinstance(p[0], np.ndarray)]:  # they are behind all that is on disk
                positions, common = (np.concatenate(x) for x in zip(*waiting, strict=True))
                del parts[len(parts) - len(waiting) :]
                parts.append((self.file.tell(), len(positions)))
                self.file.write(positions.tobytes() + common.tobytes())
                self.spilled += len(positions)
        self.held = 0

    def _load(self, part: _Tuples | tuple[int, int]) -> _Tuples:
        if isinstance(part[0], np.ndarray):
            self.held -= self.width * len(part[0])
            return part[0].astype(np.int64), part[1]
        self.file.seek(part[0])
        raw = self.file.read(self.width * part[1])
        return np.frombuffer(raw, self.kind, part[1]).astype(np.int64), np.frombuffer(raw, np.uint8, part[1], self.kind.itemsize * part[1])

    def take(self, symbol: int) -> Iterator[_Tuples]:
        """What waits for ``symbol``, in order, until nothing is left; the caller may put more meanwhile."""
        while parts := self.parts[symbol]:
            self.parts[symbol] = []
            memory: list[_Tuples] = []
            for part in parts:
                loaded = self._load(part)
                if isinstance(part[0], np.ndarray):
                    memory.append(loaded)
                else:
                    yield loaded
            if memory:
                yield tuple(np.concatenate(x) for x in zip(*memory, strict=True))

    def all(self, symbol: int) -> _Tuples:
        found = list(self.take(symbol))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint8))


class RangeLeast:
    """The least of any stretch of a small array, from those of stretches of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = np.empty((max(1, len(values).bit_length()), len(values)), values.dtype)
        self.levels[0] = values
        for k in range(1, len(self.levels)):
            half, m = 1 << (k - 1), len(values) - (1 << k) + 1
            np.minimum(self.levels[k - 1, :m], self.levels[k - 1, half : half + m], out=self.levels[k, :m])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        power = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        return np.minimum(self.levels[power, first], self.levels[power, last + 1 - (1 << power)])


class Induction:
    """One direction of the induction: sources come in sorted order, their left neighbours of one type go to the queues."""

    def __init__(self, text: np.ndarray, rising: np.ndarray, wanted: bool, cap: int, allowance: int):
        self.text, self.rising, self.wanted, self.cap = text, rising, wanted, cap
        self.queues = TupleQueues(allowance, len(text))
        #: The least common prefix among the sources since the last tuple of each queue; -1 where there is none.
        self.since = np.full(256, -1, np.int16)

    def follow(self, positions: np.ndarray, common: np.ndarray) -> None:
        """``common``: what each source shares with the one before it."""
        for a in range(0, len(positions), STEP):
            self._follow(positions[a : a + STEP], common[a : a + STEP])

    def _follow(self, positions: np.ndarray, common: np.ndarray) -> None:
        left = positions - 1
        at = np.flatnonzero(self.rising[np.maximum(left, 0)] == self.wanted)
        if len(at) and left[at[0]] < 0 or np.any(left[at] < 0):
            at = at[left[at] >= 0]
        symbols = self.text[left[at]]
        order = np.argsort(symbols, kind="stable")
        at, symbols = at[order], symbols[order]
        starts = np.flatnonzero(np.diff(symbols.astype(np.int16), prepend=-1))
        if len(at):
            own = np.empty(len(at), np.int16)
            inner = np.ones(len(at), bool)
            inner[starts] = False
            inner = np.flatnonzero(inner)
            own[inner] = RangeLeast(common)(at[inner - 1] + 1, at[inner])
            own[starts] = np.minimum(np.minimum.accumulate(common)[at[starts]], self.since[symbols[starts]])
            shared = np.minimum(own + 1, self.cap).astype(np.uint8)
            ends = np.append(starts[1:], len(at))
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                self.queues.put(int(symbols[a]), left[at[a:b]], shared[a:b])
        self.since = np.minimum(self.since, common.min())
        if len(at):
            tail = np.append(np.minimum.accumulate(common[::-1])[::-1], self.cap).astype(np.int16)
            self.since[symbols[starts]] = tail[at[ends - 1] + 1]


def _blocks(text: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The eight symbols at each position as one number; zeros follow the end."""
    n = len(text)
    tail = np.append(text[max(0, n - 8) :], np.zeros(16, np.uint8))
    late = positions + 8 > n
    out = np.empty(len(positions), np.uint64)
    if n >= 8:
        everywhere = np.ndarray((n - 7,), ">u8", text, strides=(1,))
        out[:] = everywhere[np.where(late, 0, positions)]
    at = np.minimum(positions[late] - max(0, n - 8), 16)
    out[late] = np.ndarray((len(tail) - 7,), ">u8", tail, strides=(1,))[at]
    return out


def _equal_symbols(different: np.ndarray) -> np.ndarray:
    """How many leading symbols two blocks share, from their bits that differ (not all equal)."""
    return sum((different < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))


def sorted_starred(text: np.ndarray, positions: np.ndarray, depth: int) -> _Tuples:
    """Positions in the order of their suffixes to ``depth`` symbols, with what each has in common with the one before."""
    common = np.full(len(positions), depth, np.int64)

    def recur(places: np.ndarray, group: np.ndarray, at: int) -> None:
        """Orders the positions at ``places``, of which those of a group have ``at`` symbols in common."""
        key = _blocks(text, positions[places] + at)
        together = group[1:] == group[:-1]
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[1:][together & (key[1:] != key[:-1])]] = True  # all other groups are in order as they are
        moved = np.flatnonzero(mixed[group])
        inner = np.lexsort((key[moved], group[moved])) if at else np.argsort(key[moved], kind="stable")
        positions[places[moved]] = positions[places[moved]][inner]
        key[moved] = key[moved][inner]
        differ = np.flatnonzero(together & (key[1:] != key[:-1]))
        common[places[differ + 1]] = np.minimum(at + _equal_symbols(key[differ + 1] ^ key[differ]), depth)
        same = np.append(False, together & (key[1:] == key[:-1]))
        waiting = np.flatnonzero(same | np.append(same[1:], False))
        if len(waiting) and at + 8 < depth:
            recur(places[waiting], np.cumsum(~same)[waiting], at + 8)

    if len(positions):
        positions = positions.copy()
        recur(np.arange(len(positions)), np.zeros(len(positions), np.int64), 0)
        common[0] = 0
    return positions, common.astype(np.uint8)


def suffix_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is rising, from the right, a stretch at a time; the end counts as smallest."""
    rising = large_array(len(text), bool)
    after, after_rising = -1, False
    for b in range(len(text), 0, -STRETCH):
        a = max(0, b - STRETCH)
        own = np.append(text[a:b].astype(np.int16), after)
        step = own[:-1] != own[1:]
        at = np.where(step, np.arange(b - a), b - a)
        first = np.minimum.accumulate(at[::-1])[::-1]
        larger = np.append(own[:-1] < own[1:], after_rising)
        rising[a:b] = larger[first]
        after, after_rising = int(own[0]), bool(rising[a])
    return rising


def _run(text: np.ndarray, position: int, cap: int) -> int:
    """How often a suffix repeats its first symbol at its start."""
    own = text[position : position + cap]
    other = np.flatnonzero(own != own[0])
    return int(other[0]) if len(other) else len(own)


def sorted_suffixes(text: np.ndarray, depth: int = 50, allowance: int = ALLOWANCE) -> Iterator[_Tuples]:
    """For each first symbol, the largest first: the positions of its suffixes in order, and what each has in common with the one before (0 for the first)."""
    n = len(text)
    if n == 0:
        return
    rising = suffix_types(text)
    starred = TupleQueues(allowance, n)
    for a in range(0, n, STRETCH):
        b = min(n, a + STRETCH)
        before = np.append(rising[a - 1] if a else True, rising[a : b - 1])
        at = np.flatnonzero(rising[a:b] & ~before) + a
        symbols = text[at]
        order = np.argsort(symbols, kind="stable")
        at, symbols = at[order], symbols[order]
        starts = np.flatnonzero(np.diff(symbols.astype(np.int16), prepend=-1)).tolist()
        for i, j in zip(starts, [*starts[1:], len(at)], strict=False):
            starred.put(int(symbols[i]), at[i:j], np.zeros(j - i))
    # What falls, from the smallest symbol up.
    falling, settled = Induction(text, rising, False, depth, allowance), TupleQueues(allowance, n)
    falling.queues.put(int(text[-1]), np.array([n - 1]), np.zeros(1))  # the end itself is the smallest source
    falling.since[text[-1]] = 0
    for c in range(256):
        last = None
        for positions, common in falling.queues.take(c):
            settled.put(c, positions, common)
            falling.follow(positions, common)
            last = int(positions[-1])
        stars, common = sorted_starred(text, starred.all(c)[0], depth)
        if len(stars):
            if last is not None:
                common[0] = min(_run(text, last, depth), _run(text, int(stars[0]), depth))
            falling.follow(stars, common)
    # What rises, from the largest symbol down.
    up = Induction(text, rising, True, depth, allowance)
    for c in range(255, -1, -1):
        parts = []
        for positions, common in up.queues.take(c):
            up.follow(positions, common)
            parts.append((positions, common))
        risen, shared = (np.concatenate(x)[::-1] for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        shared = np.append(np.uint8(0), shared[:-1]) if len(shared) else shared  # with the one before in rising order
        fallen, common = settled.all(c)
        if len(fallen):
            joint = np.uint8(min(_run(text, int(fallen[-1]), depth), _run(text, int(risen[0]), depth))) if len(risen) else np.uint8(0)
            up.follow(fallen[::-1], np.append(joint, common[:0:-1]))
            if len(risen):
                shared[0] = joint
        if len(fallen) or len(risen):
            yield np.append(fallen, risen), np.append(common, shared)
