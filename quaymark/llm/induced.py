"""External induced sorting: suffix order and capped common-prefix values of a text of small alphabet kept in a file.

A suffix is of type S if smaller than the next, else L; an S suffix after an L suffix is a seed. Sorted seeds give the order
of all L suffixes by one ascending sweep, and that gives the order of all S suffixes by one descending sweep: each suffix
visited puts the one before it into the queue. The queue's priority is the first symbol and then arrival, so it is a
bucket a symbol, in arrays that go to disk when ``held`` tuples are in memory; a block of tuples is visited at once.

Tuples are (position, value): the symbols that the suffix shares with the tuple before it in its bucket. That is one more
than what the two suffixes that brought them in share, the least value of all visited between them; each bucket keeps the
least value since its last tuple from block to block. Where a bucket's L suffixes meet its S suffixes or seeds, the shorter
of their leading runs of that symbol is shared.

Seeds are sorted by the same sweeps from text order, with values of 1 for "equal so far" and 0: those of value 1 have equal
substrings up to the next seed and get the same name. If names repeat, they are ordered by recursion: in memory if they are at
most ``8 * held``, else by ``queued``. Sorted seeds' own values are compared directly, up to the cap; all others are carried.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

from . import queued

_BLOCK = 1 << 16
#: Low bits of a tuple hold its value, the others its position.
_BITS = 16
_MASK = (1 << _BITS) - 1


class File:
    """Integers appended to a file, then mapped."""

    def __init__(self, folder: str, kind: type = np.int64):
        self.kind, self.size = np.dtype(kind), 0
        fd, self.name = tempfile.mkstemp(dir=folder)
        self.out = os.fdopen(fd, "wb")

    def append(self, values: np.ndarray) -> None:
        values.astype(self.kind, copy=False).tofile(self.out)
        self.size += len(values)

    def done(self) -> np.ndarray:
        self.out.close()
        return np.asarray(np.memmap(self.name, self.kind, "r", shape=(self.size,))) if self.size else np.zeros(0, self.kind)

    def filled(self, n: int, value: int) -> np.ndarray:
        """n times value, to be written to at any place."""
        for lo in range(0, n, _BLOCK):
            self.append(np.full(min(_BLOCK, n - lo), value, self.kind))
        self.out.close()
        return np.asarray(np.memmap(self.name, self.kind, "r+", shape=(n,))) if n else np.zeros(0, self.kind)

    def drop(self) -> None:
        self.out.close()
        os.remove(self.name)


class Rank:
    """Numbers ascending positions below n: by their bit map, with a count a word."""

    def __init__(self, places: np.ndarray, n: int):
        self.words = np.zeros((n >> 6) + 1, np.uint64)
        for lo in range(0, len(places), _BLOCK):
            own = places[lo : lo + _BLOCK]
            np.bitwise_or.at(self.words, own >> 6, np.uint64(1) << (own & 63).astype(np.uint64))
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    def __call__(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the positions are less, and whether it is one of them."""
        word, bit = self.words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
        return self.before[at >> 6] + np.bitwise_count(word & (bit - np.uint64(1))), (word & bit) != 0


class Buckets:
    """The queue: tuples by symbol, in order of arrival. At most ``held`` are in memory, besides a block that is visited."""

    def __init__(self, folder: str, symbols: int, held: int):
        self.folder, self.held, self.count = folder, held, 0
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.files: dict[int, str] = {}

    def push(self, symbol: np.ndarray, tuples: np.ndarray) -> None:
        """symbol is ascending."""
        if not len(symbol):
            return
        first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        for s, a, b in zip(symbol[first].tolist(), first.tolist(), [*first[1:].tolist(), len(symbol)], strict=True):
            self.parts[s].append(tuples[a:b])
        self.count += len(symbol)
        if self.count > self.held:
            self._spill()

    def _spill(self) -> None:
        for s, parts in enumerate(self.parts):
            if parts:
                if s not in self.files:
                    fd, self.files[s] = tempfile.mkstemp(dir=self.folder)
                    os.close(fd)
                with open(self.files[s], "ab") as f:
                    np.concatenate(parts).tofile(f)
                self.parts[s] = []
        self.count = 0

    def blocks(self, symbol: int) -> Iterator[np.ndarray]:
        """The tuples of a symbol, those that arrive meanwhile too."""
        while symbol in self.files or self.parts[symbol]:
            name, parts = self.files.pop(symbol, None), self.parts[symbol]
            self.parts[symbol] = []
            self.count -= sum(map(len, parts))
            if name is not None:
                with open(name, "rb") as f:
                    while len(block := np.fromfile(f, np.int64, _BLOCK)):
                        yield block
                os.remove(name)
            if parts:
                got = np.concatenate(parts)
                for lo in range(0, len(got), _BLOCK):
                    yield got[lo : lo + _BLOCK]


#: Floor of the binary logarithm of the numbers up to a block's length.
_LOG = (np.frexp(np.arange((1 << 16) + 2).astype(np.float64))[1] - 1).astype(np.int8)


class Carry:
    """Least values between tuples of a bucket. Values of which the cap is 1 are counted; others that fit are taken as bytes."""

    def __init__(self, symbols: int, cap: int, step: int):
        self.cap, self.step, self.least = cap, step, np.zeros(symbols, np.int64)
        self.kind = np.uint8 if cap < 256 else np.int64

    def __call__(self, value: np.ndarray, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Values of the tuples that those at places ``at`` of a block of visited values bring in; symbol is theirs, ascending."""
        if not len(at):
            np.minimum(self.least, value.min(), out=self.least)
            return value[:0]
        first = np.append(True, symbol[1:] != symbol[:-1])
        return np.minimum((self._ones if self.cap == 1 else self._least)(value, symbol, at, first, np.append(first[1:], True)) + self.step, self.cap)

    def _ones(self, value: np.ndarray, symbol: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        zeros = np.cumsum(value == 0, dtype=np.int32)
        here = zeros[at]
        before = np.append(0, here[:-1])
        before[first] = 0
        got = (here == before).astype(np.int64)
        got[first] &= self.least[symbol[first]]
        if zeros[-1]:
            self.least[:] = 0
        self.least[symbol[last]] = here[last] == zeros[-1]
        return got

    def _least(self, value: np.ndarray, symbol: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        value = value.astype(self.kind)
        got = np.empty(len(at), np.int64)
        start = at[first]
        # of what was visited before each symbol's first, and after its last
        got[first] = np.minimum(np.minimum.accumulate(value)[start], self.least[symbol[first]])
        later = np.flatnonzero(~first)
        if len(later):
            lo, hi = at[later - 1] + 1, at[later] + 1
            level = _LOG[hi - lo] if len(value) < len(_LOG) else (np.frexp((hi - lo).astype(np.float64))[1] - 1).astype(np.int8)
            table = np.empty((int(level.max()) + 1, len(value)), self.kind)
            table[0] = value
            for k in range(1, len(table)):
                half = 1 << (k - 1)
                np.minimum(table[k - 1, :-half], table[k - 1, half:], out=table[k, :-half])
            flat, row = table.reshape(-1), level * np.int64(len(value))
            got[later] = np.minimum(flat[row + lo], flat[row + hi - (np.int64(1) << level)])
        since = np.append(np.minimum.accumulate(value[::-1])[::-1], self.kind(min(self.cap, np.iinfo(self.kind).max)))
        np.minimum(self.least, since[0], out=self.least)
        self.least[symbol[last]] = since[at[last] + 1]
        return got


class Sweeps:
    """Both sweeps over sorted seeds. ``low`` has the L suffixes ascending and ``high`` the S suffixes descending, as tuples,
    with the place of each symbol's first and the number of its tuples."""

    def __init__(self, text: np.ndarray, symbols: int, seeds: Callable[[int], Iterator[np.ndarray]], folder: str, held: int, cap: int, step: int):
        self.text, self.symbols, self.cap, self.step, self.folder, self.held = text, symbols, cap, step, folder, held
        self.low_count, self.high_count = np.zeros(symbols, np.int64), np.zeros(symbols, np.int64)
        self._low, self._high = File(folder), File(folder)
        self._up(seeds)
        self.low = self._low.done()
        self.low_at = np.append(0, np.cumsum(self.low_count))
        self._down()
        self.high = self._high.done()
        self.high_at = np.append(0, np.cumsum(self.high_count[::-1]))[symbols - 1 :: -1]

    def close(self) -> None:
        self._low.drop()
        self._high.drop()

    def border(self, i: int, j: int) -> int:
        """Symbols shared by an L suffix and an S suffix of the same first symbol."""
        if not self.step:
            return 0
        return min(self._run(i), self._run(j), self.cap)

    def _run(self, i: int) -> int:
        head = self.text[i : i + self.cap]
        other = np.flatnonzero(head != head[0])
        return int(other[0]) if len(other) else len(head)

    def _visit(self, queue: Buckets, carry: Carry, at: np.ndarray, value: np.ndarray, symbol: int, wanted: Callable) -> None:
        before = self.text[np.maximum(at - 1, 0)]
        some = np.flatnonzero((at > 0) & wanted(before, symbol))
        some = some[np.argsort(before[some], kind="stable")]
        to = before[some]
        queue.push(to, (at[some] - 1) << _BITS | carry(value, to, some))

    def _up(self, seeds: Callable[[int], Iterator[np.ndarray]]) -> None:
        queue, carry = Buckets(self.folder, self.symbols, self.held), Carry(self.symbols, self.cap, self.step)
        n = len(self.text)
        if n:  # the end of the text is smaller than all
            queue.push(self.text[n - 1 :], np.array([(n - 1) << _BITS]))
        for symbol in range(self.symbols):
            last = None
            for block in queue.blocks(symbol):
                at, value = block >> _BITS, block & _MASK
                if last is None:
                    value[0] = 0
                last = int(at[-1])
                self._low.append(at << _BITS | value)
                self.low_count[symbol] += len(at)
                self._visit(queue, carry, at, value, symbol, np.greater_equal)
            fresh = True
            for block in seeds(symbol):
                at, value = block >> _BITS, block & _MASK
                if fresh:
                    value[0] = 0 if last is None else self.border(last, int(at[0]))
                fresh = False
                self._visit(queue, carry, at, value, symbol, np.greater)

    def _down(self) -> None:
        queue, carry = Buckets(self.folder, self.symbols, self.held), Carry(self.symbols, self.cap, self.step)
        for symbol in range(self.symbols - 1, -1, -1):
            last = None
            for block in queue.blocks(symbol):
                at, value = block >> _BITS, block & _MASK
                if last is None:
                    value[0] = 0
                last = int(at[-1])
                self._high.append(at << _BITS | value)
                self.high_count[symbol] += len(at)
                self._visit(queue, carry, at, value, symbol, np.less_equal)
            begin, end = int(self.low_at[symbol]), int(self.low_at[symbol + 1])
            # a value belongs to a suffix and the smaller one, so it is that of the visit after it
            ahead = 0 if last is None or begin == end else self.border(int(self.low[end - 1]) >> _BITS, last)
            for hi in range(end, begin, -_BLOCK):
                block = np.asarray(self.low[max(begin, hi - _BLOCK) : hi])[::-1]
                at, own = block >> _BITS, block & _MASK
                value = np.append(ahead, own[:-1])
                ahead = int(own[-1])
                self._visit(queue, carry, at, value, symbol, np.less)

    def ascending(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes in order, by blocks: positions, and symbols shared with the suffix before."""
        for symbol in range(self.symbols):
            begin, end = int(self.low_at[symbol]), int(self.low_at[symbol + 1])
            last = None
            for lo in range(begin, end, _BLOCK):
                block = np.asarray(self.low[lo : min(end, lo + _BLOCK)])
                last = int(block[-1]) >> _BITS
                yield block >> _BITS, block & _MASK
            begin = int(self.high_at[symbol])
            end = begin + int(self.high_count[symbol])
            ahead = 0 if last is None or begin == end else self.border(last, int(self.high[end - 1]) >> _BITS)
            for hi in range(end, begin, -_BLOCK):
                block = np.asarray(self.high[max(begin, hi - _BLOCK) : hi])[::-1]
                own = block & _MASK
                yield block >> _BITS, np.append(ahead, own[:-1])
                ahead = int(own[-1])


def _places(text: np.ndarray, folder: str) -> File:
    """The positions of seeds: runs of a symbol after a greater and before a greater one."""
    out = File(folder)
    start, symbol = np.zeros(0, np.int64), np.zeros(0, text.dtype)
    for lo in range(0, len(text), _BLOCK):
        part = np.asarray(text[max(lo - 1, 0) : lo + _BLOCK])
        new = np.flatnonzero(part[1:] != part[:-1]) + 1 + max(lo - 1, 0)
        new = np.append(0, new) if not lo else new
        start, symbol = np.append(start, new), np.append(symbol, np.asarray(text[new]))
        out.append(start[1:-1][(symbol[:-2] > symbol[1:-1]) & (symbol[1:-1] < symbol[2:])])
        start, symbol = start[-2:], symbol[-2:]
    return out


def _by_symbol(text: np.ndarray, symbols: int, order: Iterator[np.ndarray], folder: str, held: int) -> Buckets:
    """Tuples in buckets of their first symbols."""
    out = Buckets(folder, symbols, held)
    for block in order:
        first = text[block >> _BITS]
        turn = np.argsort(first, kind="stable")
        out.push(first[turn], block[turn])
    return out


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a text in memory, by prefix doubling of those that are still equal."""
    m, k = len(names), 1
    names = np.asarray(names).astype(np.int64) + 1
    base, key = int(names.max()) + 1, names
    while base ** (k + 1) < 1 << 63 and k < m:  # as many names as a key holds
        key = key * base
        key[: m - k] += names[k:]
        k += 1
    at, order, rank = np.arange(m), np.arange(m), np.empty(m, np.int64)
    while True:
        turn = np.argsort(key)
        i, key = order[at[turn]], key[turn]
        order[at] = i
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(head, len(at)))
        rank[i] = np.repeat(at[head], count)  # equal ones have the place of the first
        at = at[np.repeat(count > 1, count)]
        if not len(at) or k >= m:
            return order
        i = order[at]
        key = rank[i] * (m + 1)
        inside = np.flatnonzero(i + k < m)
        key[inside] += rank[i[inside] + k] + 1
        k = min(2 * k, m)


def _shared(text: np.ndarray, one: np.ndarray, other: np.ndarray, cap: int) -> np.ndarray:
    """Leading symbols that pairs of suffixes share, up to cap."""
    n, out, live = len(text), np.zeros(len(one), np.int64), np.arange(len(one))
    some = 8 // text.itemsize
    if n >= some and text.flags.c_contiguous and text.dtype.kind == "u":  # eight bytes at a time
        wide, ends = np.ndarray((n - some + 1,), np.uint64, text, 0, (text.itemsize,)), []
        while len(live):
            i, j = one[live] + out[live], other[live] + out[live]
            near = np.maximum(i, j) > n - some
            if near.any():
                ends.append(live[near])
                live, i, j = live[~near], i[~near], j[~near]
            x = wide[i] ^ wide[j]
            out[live] += np.where(x == 0, some, np.bitwise_count((x & -x) - np.uint64(1)).astype(np.int64) // (8 * text.itemsize))
            live = live[(x == 0) & (out[live] < cap)]
        live = np.concatenate(ends) if ends else live
    while len(live):
        i, j = one[live] + out[live], other[live] + out[live]
        live = live[(np.maximum(i, j) < n) & (out[live] < cap)]
        live = live[text[one[live] + out[live]] == text[other[live] + out[live]]]
        out[live] += 1
    return np.minimum(out, cap)


def _sorted_seeds(text: np.ndarray, symbols: int, folder: str, held: int) -> Iterator[np.ndarray]:
    """The positions of the seeds in the order of their suffixes, by blocks."""
    file = _places(text, folder)
    places, m = file.done(), file.size
    if m:
        rough = _by_symbol(text, symbols, (places[lo : lo + _BLOCK] << _BITS | 1 for lo in range(0, m, _BLOCK)), folder, held)
        sweeps = Sweeps(text, symbols, rough.blocks, folder, held, 1, 0)
        named = File(folder)
        names, rank = named.filled(m, 0), Rank(places, len(text))
        name, tied = -1, 1  # tied: the least value since the last seed
        for at, value in sweeps.ascending():
            before = np.asarray(text[np.maximum(at - 1, 0)])
            k = np.flatnonzero(before > text[at])  # seeds, and some L suffixes
            where, real = rank(at[k])
            k = k[real]
            if not len(k):
                tied = min(tied, int(value.min()))
                continue
            least = np.minimum.reduceat(value[: k[-1] + 1], np.append(0, k[:-1] + 1))
            least[0] = min(int(least[0]), tied)
            number = name + np.cumsum(least == 0)
            names[where[real]] = number
            name = int(number[-1])
            rest = value[k[-1] + 1 :]
            tied = int(rest.min()) if len(rest) else 1
        sweeps.close()
        if name + 1 == m:
            ranked = File(folder)
            order = ranked.filled(m, 0)
            for lo in range(0, m, _BLOCK):
                own = names[lo : lo + _BLOCK]
                order[own] = np.arange(lo, lo + len(own))
            done = ranked.drop
        elif m <= 8 * held:
            order, done = _doubled(names), named.out.close
        else:
            inner = queued.suffix_order(memoryview(names).cast("B").cast("q"), m, folder, held)
            order, done = np.frombuffer(inner.view, np.int64), inner.close
        for lo in range(0, m, _BLOCK):
            yield places[order[lo : lo + _BLOCK]]
        del order, rank
        done()
        named.drop()
    file.drop()


def suffixes(text: np.ndarray, cap: int, folder: str, held: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, symbols shared with the suffix before, up to cap) in suffix order; symbols are small integers."""
    if not 0 < cap <= _MASK:
        raise ValueError(f"a cap is from 1 to {_MASK}")
    if not len(text):
        return
    symbols = max(int(text[lo : lo + _BLOCK].max()) for lo in range(0, len(text), _BLOCK)) + 1

    def valued() -> Iterator[np.ndarray]:
        last = None
        for at in _sorted_seeds(text, symbols, folder, held):
            value = _shared(text, np.append(at[0] if last is None else last, at[:-1]), at, cap)
            last = at[-1]
            yield at << _BITS | value

    seeds = _by_symbol(text, symbols, valued(), folder, held)
    sweeps = Sweeps(text, symbols, seeds.blocks, folder, held, cap, 1)
    yield from sweeps.ascending()
    sweeps.close()
