"""Suffix order of a text of any alphabet kept in files, by induced sorting with priority queues.

It orders the names of ``induced`` where they are more than fit in memory. Suffixes are of type S if smaller than the next,
else L; an S suffix after an L suffix is a seed. Sorted seeds give the order of all L suffixes by one ascending sweep and
from them that of all S suffixes by one descending sweep: each suffix taken from the queue puts the one before it, as a
tuple (first symbol, rank, position), back in. Seeds are sorted the same way from any order of theirs, named by the
substrings up to the next seed, and, if names repeat, ordered by recursion on the text of names.

The text, the types and every order are memory-mapped files; queues hold ``held`` tuples and spill sorted runs to disk.
"""

from __future__ import annotations

import heapq
import mmap
import os
import tempfile
from array import array
from collections.abc import Iterable, Iterator

_BLOCK = 4096


class DiskQueue:
    """A priority queue of integer pairs, the smallest first. At most ``held`` are in memory, besides a block a run."""

    def __init__(self, folder: str, held: int):
        self.folder, self.held = folder, held
        self.heap: list[tuple[int, int]] = []
        self.runs: list[list] = []  # head, block, place in block, file, name

    def push(self, key: int, value: int) -> None:
        heapq.heappush(self.heap, (key, value))
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        keep = self.held // 8
        self.heap.sort()
        out, self.heap = self.heap[keep:], self.heap[:keep]
        fd, name = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(fd, "wb") as f:
            for lo in range(0, len(out), _BLOCK):
                array("q", [x for pair in out[lo : lo + _BLOCK] for x in pair]).tofile(f)
        self._load([None, array("q"), 0, open(name, "rb"), name])  # noqa: SIM115

    def _load(self, run: list) -> None:
        if run[2] >= len(run[1]):
            run[1], run[2] = array("q", run[3].read(16 * _BLOCK)), 0
            if not run[1]:
                run[3].close()
                os.remove(run[4])
                return
        run[0] = (run[1][run[2]], run[1][run[2] + 1])
        run[2] += 2
        self.runs.append(run)
        self.runs.sort(key=lambda r: r[0], reverse=True)

    def peek(self) -> tuple[int, int] | None:
        own = self.heap[0] if self.heap else None
        if self.runs and (own is None or self.runs[-1][0] < own):
            return self.runs[-1][0]
        return own

    def pop(self) -> tuple[int, int]:
        if self.runs and (not self.heap or self.runs[-1][0] < self.heap[0]):
            run = self.runs.pop()
            got = run[0]
            self._load(run)
            return got
        return heapq.heappop(self.heap)


class Disk:
    """An array of integers in a mapped file."""

    def __init__(self, folder: str, kind: str, values: Iterable[int]):
        fd, self.name = tempfile.mkstemp(dir=folder)
        with os.fdopen(fd, "wb") as f:
            block = array(kind)
            for v in values:
                block.append(v)
                if len(block) >= 1 << 16:
                    block.tofile(f)
                    block = array(kind)
            block.tofile(f)
            self.size = f.tell() // block.itemsize
        self.file = open(self.name, "r+b")  # noqa: SIM115
        self.map = mmap.mmap(self.file.fileno(), 0) if self.size else None
        self.view = memoryview(self.map).cast(kind) if self.size else memoryview(b"")

    def close(self) -> None:
        self.view.release()
        if self.map is not None:
            self.map.close()
        self.file.close()
        os.remove(self.name)


def _sweeps(text: memoryview, small: memoryview, seeds: Iterable[int], n: int, folder: str, held: int) -> Iterator[tuple[str, int, int]]:
    """("L" or "S", position, position that brought it in) in ascending order of L suffixes, then descending of S suffixes.

    seeds: positions of seeds in ascending order of their first symbols and, within those, as sorted so far.
    """
    span = n + 1
    queue, count = DiskQueue(folder, held), 0
    order = Disk(folder, "q", _ascending(text, small, seeds, n, queue, count, span, folder))
    down, count = DiskQueue(folder, held), 0
    view, at = order.view, order.size - 2
    for k in range(0, order.size, 2):
        yield "L", view[k], view[k + 1]
    # descending: S suffixes of a symbol come before its L suffixes
    while at >= 0 or down.peek() is not None:
        top, head = text[view[at]] if at >= 0 else -1, down.peek()
        if head is not None and -(head[0] // span) >= top:
            key, packed = down.pop()
            i, source = divmod(packed, span)
            yield "S", i, source
        else:
            i = view[at]
            at -= 2
        if i and small[i - 1]:
            count += 1
            down.push(-text[i - 1] * span + count, (i - 1) * span + i)
    order.close()


def _ascending(text, small, seeds, n, queue, count, span, folder) -> Iterator[int]:
    """The L suffixes in ascending order, each followed by the position that brought it in (n for the text's last)."""
    seeds = iter(seeds)
    seed = next(seeds, None)
    if n and not small[n - 1]:  # the end of the text is smaller than all
        queue.push(text[n - 1] * span, (n - 1) * span + n)
    while seed is not None or queue.peek() is not None:
        head = queue.peek()
        if head is not None and (seed is None or head[0] // span <= text[seed]):
            _, packed = queue.pop()
            i, source = divmod(packed, span)
            yield i
            yield source
        else:
            i, seed = seed, next(seeds, None)
        if i and not small[i - 1]:
            count += 1
            queue.push(text[i - 1] * span + count, (i - 1) * span + i)


def _types(text: memoryview, n: int, folder: str) -> Disk:
    """1 where a suffix is smaller than the next; the last is larger, since nothing follows it."""
    out = Disk(folder, "B", bytes(n))
    for i in range(n - 2, -1, -1):
        out.view[i] = 1 if text[i] < text[i + 1] or text[i] == text[i + 1] and out.view[i + 1] else 0
    return out


def _is_seed(small: memoryview, i: int) -> bool:
    return i > 0 and bool(small[i]) and not small[i - 1]


def _sorted_seeds(text: memoryview, small: memoryview, n: int, folder: str, held: int) -> Disk:
    """The seeds in the order of their suffixes."""
    places = Disk(folder, "q", (i for i in range(1, n) if _is_seed(small, i)))
    m = places.size
    by_symbol = DiskQueue(folder, held)
    for i in places.view if m else ():
        by_symbol.push(text[i], i)

    def drain(q: DiskQueue) -> Iterator[int]:
        while q.peek() is not None:
            yield q.pop()[1]

    rough = Disk(folder, "q", (i for kind, i, _ in _sweeps(text, small, drain(by_symbol), n, folder, held) if kind == "S" and _is_seed(small, i)))
    # rough is descending; equal substrings get equal names

    def length(i: int) -> int:
        j = i + 1
        while j < n and not _is_seed(small, j):
            j += 1
        return j - i + 1 if j < n else n - i

    name, before, named = -1, None, DiskQueue(folder, held)
    for k in range(rough.size - 1, -1, -1):
        i = rough.view[k]
        own = length(i)
        same = before is not None and own == before[1] and all(text[i + d] == text[before[0] + d] for d in range(own))
        name += 0 if same else 1
        before = (i, own)
        named.push(i, name)
    rough.close()
    names = Disk(folder, "q", drain(named))
    if name + 1 == m:
        rank = Disk(folder, "q", [0] * m)
        for k in range(m):
            rank.view[names.view[k]] = places.view[k]
        names.close()
        places.close()
        return rank
    inner = suffix_order(names.view, m, folder, held)
    out = Disk(folder, "q", (places.view[k] for k in inner.view))
    inner.close()
    names.close()
    places.close()
    return out


def _merged(text: memoryview, small: memoryview, n: int, seeds: Disk, folder: str, held: int) -> tuple[Disk, Disk]:
    """L suffixes ascending and S suffixes descending, each followed by what brought it in."""
    sweeps = _sweeps(text, small, seeds.view if seeds.size else (), n, folder, held)
    first = next(sweeps, None)

    def take(kind: str) -> Iterator[int]:
        nonlocal first
        while first is not None and first[0] == kind:
            yield first[1]
            yield first[2]
            first = next(sweeps, None)

    return Disk(folder, "q", take("L")), Disk(folder, "q", take("S"))


def suffix_order(text: memoryview, n: int, folder: str, held: int = 1 << 18) -> Disk:
    """The positions of text in the order of their suffixes."""
    types = _types(text, n, folder)
    seeds = _sorted_seeds(text, types.view, n, folder, held)
    low, high = _merged(text, types.view, n, seeds, folder, held)

    def both() -> Iterator[int]:
        a, b = 0, high.size - 2
        while a < low.size or b >= 0:
            if b < 0 or a < low.size and text[low.view[a]] <= text[high.view[b]]:
                yield low.view[a]
                a += 2
            else:
                yield high.view[b]
                b -= 2

    out = Disk(folder, "q", both())
    for x in (types, seeds, low, high):
        x.close()
    return out
