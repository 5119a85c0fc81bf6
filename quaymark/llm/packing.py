"""Best-fit packing of tokenised documents into sequences by bin completion.

Documents longer than a sequence are cut into whole sequences and a rest; nothing else is cut. Pieces of equal length are
alike, so packing is planned on the histogram of lengths, which has at most ``capacity`` entries whatever the corpus.
Branch and bound: around the largest piece left, all undominated fillings are tried, enumerated as they are needed, the
fullest first, and each as often as the histogram lets it, then one time less, and so on; a branch is left when its waste
shows that it cannot beat the incumbent, which starts as the best-fit decreasing plan. The search ends when a plan meets
``lower_bound`` or after ``NODES`` steps, its only limit. The plan's slots are then dealt to the pieces by their rank among
those of their length, counted in parallel buckets.

Defined results: null and empty texts are one piece that holds the end token only; very long texts have any number of
pieces; repeated rows are pieces of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHash, chunks, cut, ship, table, text_view

CAPACITY, END = 4096, 1
#: Steps of the search before it returns its best plan, and words that a worker remembers.
NODES, REMEMBERED = 200_000, 200_000
_PLAIN = "".join(chr(c) for c in range(0x180) if c != 0x130) + "‘’“”–—…€•"
_SPACES = " \t\n\v\f\r\x85\xa0"
_SPACE, _LETTER, _NUMBER, _SIGN, _OTHER = range(5)
#: Characters from here on are left to the tokenizer, with their texts.
_KNOWN = 0x2100
_KIND, _LOWER = np.full(_KNOWN + 1, _OTHER, np.uint8), np.arange(_KNOWN + 1, dtype=np.uint32)
for _c in _PLAIN:
    _KIND[ord(_c)] = _SPACE if _c in _SPACES else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(_c)[0], _SIGN)
    _LOWER[ord(_c)] = ord(_c.lower())
_CHAR = np.random.default_rng(20240301).integers(1, 1 << 63, _KNOWN + 1, dtype=np.uint64) | np.uint64(1)
#: How byte-level vocabularies write bytes: printable ones as they are, the others as characters from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder(dict):
    """Token ids as little-endian 32-bit numbers. Remembers those of words: this vocabulary's words are encoded one by one.

    Texts of Latin letters and common signs are split here by the tokenizer's own rule ('s, 't, 're, 've, 'm, 'll, 'd, runs
    of letters, single numbers, runs of other signs), many at a time, and the vocabulary's merges applied to each distinct
    word; all others are left to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        signs = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_SIGNS)
        got = self[word] = np.array([t.id for t in self.model.tokenize(signs)], "<u4").tobytes()
        return got

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].tobytes()

    def encode_all(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, each with ``end`` after it, and the len+1 offsets."""
        data, off = text_view(column)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        off, own = lead[off], [data[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        code = np.minimum(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), _KNOWN)
        kind, last = _KIND[code], 0 if end is None else 1
        marks = np.flatnonzero(kind == _OTHER), np.flatnonzero((code[:-1] == ord("<")) & (code[1:] == ord("|")))
        odd = np.unique(np.searchsorted(off, np.concatenate(marks), "right") - 1)
        for d in odd.tolist():
            kind[off[d] : off[d + 1]] = _SPACE
        low = _LOWER[code]
        start, stop = self._words(low, kind, off)
        codes, seen = pd.factorize(SpanHash(low, _CHAR)(start, stop)) if len(start) else (np.zeros(0, np.int64), ())
        first = np.empty(len(seen), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        text = low.tobytes().decode("utf-32-le")
        parts = [self[text[a:b]] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
        size = np.array([len(p) // 4 for p in parts], np.int64)
        n, at = size[codes], (np.cumsum(size) - size)[codes]
        doc = np.searchsorted(off, start, "right") - 1
        count = np.bincount(doc, n, len(own)).astype(np.int64)
        before, whole = np.cumsum(count) - count, {d: np.frombuffer(self._plain(own[d].tobytes().decode()), "<u4") for d in odd.tolist()}
        sizes = count + last
        for d, ids in whole.items():
            sizes[d] += len(ids)
        out_off = np.concatenate([[0], np.cumsum(sizes)])
        out, place = np.full(out_off[-1], end or 0, "<u4"), np.arange(int(n.sum()))
        if len(place):
            ids = np.frombuffer(b"".join(parts), "<u4")[place + np.repeat(at - (np.cumsum(n) - n), n)]
            out[place + np.repeat(out_off[:-1] - before, count)] = ids
        for d, ids in whole.items():
            out[out_off[d] : out_off[d] + len(ids)] = ids
        return out, out_off

    def _words(self, low: np.ndarray, kind: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(low)
        edge = np.ones(n + 1, bool)
        edge[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        edge[off] = True
        at = np.flatnonzero(edge)
        start, stop = at[:-1], at[1:]
        sel = kind[start] != _SPACE
        start, stop = start[sel], stop[sel]
        short = np.flatnonzero((low[start[:-1]] == ord("'")) & (stop[:-1] == start[:-1] + 1) & (start[1:] == stop[:-1]) & (kind[start[1:]] == _LETTER)) if len(start) else np.zeros(0, np.int64)
        short = short[~np.isin(start[short + 1], off)] if len(short) else short
        if len(short):
            a, more = low[start[short + 1]], stop[short + 1] - start[short + 1] > 1
            b = np.where(more, low[np.minimum(start[short + 1] + 1, n - 1)], 0)
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            take = np.where(np.isin(a, [ord(x) for x in "stmd"]), 1, np.where(two, 2, 0))
            start, stop = start.copy(), stop.copy()
            stop[short] += take
            start[short + 1] += take
            full = start < stop
            start, stop = start[full], stop[full]
        return start, stop


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """A worker's own, kept from task to task."""
    return Encoder(path)


#: Text bytes that are encoded at a time, at some 100 bytes of memory each.
TEXT_BYTES = 1 << 18


def tokenise(docs: DataFrame, path: str | Callable[[], str], capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and with ids their 32-bit bytes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path() if callable(path) else path)
        for chunk in chunks(batches, 1, TEXT_BYTES):
            cols: list[list] = [[], [], [], [], [], []]
            found, off = own.encode_all(chunk.column(1), end)
            for doc_id, a, b in zip(chunk.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                for p, lo in enumerate(range(a, b, capacity)):
                    part = found[lo : min(lo + capacity, b)]
                    for c, v in zip(cols, (doc_id, p, lo - a, len(part), zlib.crc32(part), part.tobytes() if ids else None), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if ids else out.drop("ids")


Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: np.ndarray) -> Plan:
    """Best-fit decreasing on a histogram: (lengths, times) with equal bins taken together. counts[x]: pieces of length x."""
    capacity = len(counts) - 1
    open_: dict[int, list[list]] = {}
    free = np.zeros(capacity + 1, bool)

    def put(room: int, items: tuple, times: int) -> None:
        open_.setdefault(room, []).append([items, times])
        free[room] = True

    for x in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[x])
        while left:
            fits = np.flatnonzero(free[x:])
            room = x + int(fits[0]) if len(fits) else capacity
            items, times = open_[room].pop() if len(fits) else ((), -(-left // (capacity // x)))
            if len(fits) and not open_[room]:
                free[room] = False
            each = room // x
            full = min(times, left // each)
            if full:
                put(room - each * x, (*items, *[x] * each), full)
                left -= full * each
                times -= full
            if left and times and left < each:
                put(room - left * x, (*items, *[x] * left), 1)
                left, times = 0, times - 1
            if times and items:
                put(room, items, times)
    return [(items, times) for room in open_ for items, times in open_[room]]


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing needs: for every size, the pieces too large to share one with it, and the room of the rest."""
    capacity = len(counts) - 1
    counts, half = np.asarray(counts, np.int64), capacity // 2
    number, weight = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    a = np.arange(1, half + 1)
    alone, large = number[-1] - number[capacity - a], number[capacity - a] - number[half]
    rest = weight[half] - weight[a - 1] - (large * capacity - (weight[capacity - a] - weight[half]))
    return max(-(-int(weight[-1]) // capacity), int((alone + large + np.maximum(0, -(-rest // capacity))).max(initial=0)))


def _bits(values: Iterator[int]) -> int:
    out = 0
    for x in values:
        out |= 1 << x
    return out


def _spread(bits: int, width: int) -> int:
    """Every bit also at up to ``width`` places above."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


class Search:
    """Branch and bound over a histogram: n[x] pieces of length x are left, and bit x of ``left`` is set if there are any."""

    def __init__(self, counts: np.ndarray, nodes: int):
        self.capacity, self.n = len(counts) - 1, [int(c) for c in counts]
        self.left = _bits(x for x, c in enumerate(self.n) if c)
        self.total = self.rest = sum(x * c for x, c in enumerate(self.n))
        self.full, self.steps, self.nodes = self._sums(), 0, nodes
        self.waste, self.best = 0, 0

    def _lengths(self) -> Iterator[int]:
        bits = self.left
        while bits:
            x = bits.bit_length() - 1
            bits ^= 1 << x
            yield x

    def _sums(self) -> int:
        """Bit capacity - s is set if some of the pieces left sum to s."""
        out, most = 1, (1 << (self.capacity + 1)) - 1
        for x in self._lengths():
            c, k = min(self.n[x], self.capacity // x), 1
            while c:
                k = min(k, c)
                out = (out | out << x * k) & most
                c, k = c - k, k * 2
        return int(f"{out:0{self.capacity + 1}b}"[::-1], 2)

    def take(self, items: Counter, times: int) -> None:
        for x, k in items.items():
            self.n[x] -= k * times
            self.rest -= x * k * times
            self.left = self.left | 1 << x if self.n[x] else self.left & ~(1 << x)

    def room(self) -> int:
        """Waste that a better plan may still have."""
        return (self.best - 1) * self.capacity - self.total - self.waste

    def _exact(self, sum_: int, sums: int) -> Iterator[tuple[int, ...]]:
        """All multisets of pieces left with this sum, the greatest pieces first."""
        items: list[int] = []
        used: Counter = Counter()
        rest, top = sum_, sum_
        while self.steps < self.nodes:
            self.steps += 1
            if not rest:
                yield tuple(items)
            fit = (self.left & sums >> (self.capacity - rest) & ((1 << (min(top, rest) + 1)) - 1)) if rest else 0
            while fit:
                x = fit.bit_length() - 1
                if used[x] < self.n[x]:
                    break
                fit ^= 1 << x
            if fit:
                items.append(x)
                used[x] += 1
                rest, top = rest - x, x
            elif items:
                x = items.pop()
                used[x] -= 1
                rest, top = rest + x, x - 1
            else:
                return

    def dominated(self, items: tuple[int, ...], slack: int) -> bool:
        """Whether one piece left could stand for some of items, a longer one for one of them, or any for none, and still fit."""
        one = two = 0
        for x in items:
            two |= two << x | one << x
            one |= 1 << x
        free = self.left & ~_bits(x for x, k in Counter(items).items() if self.n[x] == k)
        return bool(free & _spread(two, slack)) or slack > 0 and bool(free & _spread(one << 1 | 2, slack - 1))

    def fillings(self, room: int, after: tuple | None) -> Iterator[tuple[int, ...]]:
        """All undominated fillings of room from the pieces left that come after ``after``, by waste and then by pieces."""
        if self.rest <= room:
            yield tuple(x for x in self._lengths() for _ in range(self.n[x]))
            return
        sums, waste = self._sums() if self.left.bit_count() <= 128 else self.full, 0 if after is None else after[0]
        while waste <= min(room, self.room()) and self.steps < self.nodes:
            self.steps += 1
            for items in self._exact(room - waste, sums):
                if (after is None or (waste, tuple(-x for x in items)) > after) and not self.dominated(items, waste):
                    yield items
            waste += 1


def complete(counts: np.ndarray, nodes: int = NODES) -> Plan:
    """The fewest bins found for a histogram of lengths up to its capacity; fewest of all if the search wasn't ended by nodes."""
    incumbent, need = best_fit(counts), lower_bound(counts)
    search = Search(counts, nodes)
    search.best = sum(t for _, t in incumbent)
    path: list[list] = []  # largest piece, fillings, filling of now, its times
    bins = 0

    while search.best > need and search.steps < nodes:
        search.steps += 1
        if search.left and search.room() >= 0:
            top = search.left.bit_length() - 1
            after = path[-1][5] if path and path[-1][0] == top else None
            search.take(Counter([top]), 1)
            path.append([top, search.fillings(search.capacity - top, after), None, 0, 0, None])
            search.take(Counter([top]), -1)
        elif not search.left and bins < search.best:
            incumbent, search.best = [(tuple(f[2].elements()), f[3]) for f in path], bins
        while path:  # another number of times, another filling, or back
            frame = path[-1]
            times = frame[3]
            if times:
                search.take(frame[2], -times)
                bins, search.waste = bins - times, search.waste - times * (search.capacity - frame[4])
            if times > 1:
                frame[3] = times - 1
            else:
                search.take(Counter([frame[0]]), 1)
                items = next(frame[1], None)
                search.take(Counter([frame[0]]), -1)
                if items is None:
                    path.pop()
                    continue
                frame[2], frame[4] = Counter((frame[0], *items)), frame[0] + sum(items)
                slack = search.capacity - frame[4]
                frame[5] = (slack, tuple(-x for x in items))
                frame[3] = min(search.n[x] // k for x, k in frame[2].items())
                if slack:
                    frame[3] = min(frame[3], search.room() // slack)
                if frame[3] <= 0:
                    frame[3] = 0
                    continue
            search.take(frame[2], frame[3])
            bins, search.waste = bins + frame[3], search.waste + frame[3] * (search.capacity - frame[4])
            break
        if not path:
            break
    return incumbent


class Slots:
    """A plan as slots: for each length, which ranks go to which sequences at which offset."""

    def __init__(self, plan: Plan):
        rows, base = [], 0
        for items, times in plan:
            at = 0
            for x in items:
                rows.append((x, times, base, at))
                at += x
            base += times
        rows.sort()
        got = np.array(rows, np.int64).reshape(-1, 4)
        self.length, times, self.base, self.offset = got.T
        before = np.cumsum(times) - times
        first = np.searchsorted(self.length, self.length, "left")
        self.low = before - before[first] if len(got) else before
        self.key = self.length << 40 | self.low

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, length << 40 | rank, "right") - 1
        return self.base[i] + rank - self.low[i], self.offset[i]


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """pieces with sequence_id and offset added; length must be from 1 to capacity."""
    names = pieces.columns
    rows = cut(pieces.withColumn("pk_row", F.monotonically_increasing_id()))
    total = rows.count()
    buckets = max(64, total // 100_000)
    rows = rows.withColumn("pk_bucket", F.pmod(F.xxhash64("pk_row"), F.lit(buckets)))
    counts = cut(rows.groupBy("length", "pk_bucket").agg(F.count("*").alias("n")))
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        hist[r["length"]] = r["n"]
    shared = pieces.sparkSession.sparkContext.broadcast(Slots(complete(hist, nodes)))
    before = counts.withColumn("pk_before", F.sum("n").over(Window.partitionBy("length").orderBy("pk_bucket")) - F.col("n")).drop("n")
    ranked = rows.withColumn("pk_rank", F.row_number().over(Window.partitionBy("length", "pk_bucket").orderBy("pk_row")) - 1)
    ranked = ranked.join(before, ["length", "pk_bucket"]).select(*names, (F.col("pk_before") + F.col("pk_rank")).alias("pk_rank"))
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.of(batch.column(at).to_numpy(), batch.column(len(names)).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ranked.drop("pk_rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(run, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    return pack(tokenise(table(spark, sf_dir, "documents"), vocabulary))
