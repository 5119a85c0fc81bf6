"""Suffix-array dedup: bytes of repeated strings go from all documents but the first that has them.

Windows of ``size`` bytes are dealt to shards by their minimizer, the least hash of their ``k``-byte pieces, so equal
windows meet. Minimizers that occur once are left out, and equal runs of windows are one row, by two hashes of 64 bits, with the
least and greatest document that has it: once in each task, then in buckets of minimizers. A run that very many documents share is
met by these and by splittable joins only. A run that shares neither side of its minimizer (``_sides``) with another shares no
window with any, and its smallest document keeps it whole. The others' bytes, from their smallest documents, go to shards, whose runs are written to a file and put in suffix order by external
induced sorting (``induced``); neighbours that share ``size`` bytes are one window, and its smallest document keeps it. Runs are
found again in each pass over the texts, by bit maps of those that still matter, rather than kept: they are more bytes than the texts.

Defined results: null texts are empty; texts shorter than ``size`` stay whole; long texts are taken whole; documents with
equal ids, and those with none (which come after all others), take nothing from each other; repeated rows each get their
row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap, induced
from .bitmap import BitMap
from .common import SpanHash, chunks, mix, settled, ship, table, text_view

SIZE, PIECE = 50, 20
#: Bytes of distinct runs that a task sorts: some 40 bytes of files and, at most, of memory each.
SHARD_BYTES = 2 << 20
#: Shards at least: of few bytes they are small, as all that tasks sort at once is on disk.
SHARDS = 24
_LAST = (1 << 63) - 1
_BLOCK = 1 << 16
#: Low bits of a span hold its length, the others its start.
_LENGTH = 31
#: Bytes of text in a step of a pass: its arrays, of eight bytes each, stay in a core's cache.
_PASS = 1 << 17
#: Minimizers that a task holds before they are shuffled, and bytes of text for each bucket that they are dealt to.
_HELD, _BUCKET = 1 << 21, 2 << 20
#: Bytes of text for each minimizer that occurs twice, as seen on the given tables; it sizes a bit map.
_RARE = 220


def _order(spans: SpanHash, k: int) -> np.ndarray:
    """The hashes of all k-byte pieces by which the least is chosen: finished in place, as a chunk's arrays are to stay in cache."""
    with np.errstate(over="ignore"):
        h = spans.raw(k)
        half = h >> np.uint64(32)
        h ^= half
        h *= np.uint64(0xBF58476D1CE4E5B9)
        np.right_shift(h, np.uint64(29), out=half)
        h ^= half
    return h


def runs(data: np.ndarray, off: np.ndarray, size: int, k: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first window, number of windows and minimizer of each maximal run of windows with one minimizer; order has the
    hashes of all pieces, if they are at hand."""
    none = np.zeros(0, np.int64)
    own = np.flatnonzero(np.diff(off) >= size)
    if not len(own):
        return none, none, none, none
    least, have = _order(SpanHash(data), k) if order is None else order, 1
    width = size - k + 1
    while have * 2 <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    rest = width - have
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    # where the minimizer changes within a document's windows, and each document's first window
    new = np.empty(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[off[own]] = True
    first = np.flatnonzero(new[off[own[0]] :]) + off[own[0]]
    d = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(first, off)))
    inside = first + size <= off[d + 1]
    first, d = first[inside], d[inside]
    end = off[d + 1] - size + 1
    end[:-1] = np.minimum(end[:-1], first[1:])
    return d, first, end - first, least[first].view(np.int64)


def _turned(m: np.ndarray) -> np.ndarray:
    """Halves exchanged, unsigned: a least hash has its chance in the low bits, and buckets and bit maps take the high ones."""
    m = m.view(np.uint64)
    return (m << np.uint64(32)) | (m >> np.uint64(32))


def _hash(t: np.ndarray, key: np.ndarray, bits: int, doc: np.ndarray | int = 0) -> np.ndarray:
    """A hash of a key, and a document, for bit maps: the bucket of t is in its highest bits."""
    return (t >> np.uint64(64 - bits) << np.uint64(64 - bits)) | ((key.view(np.int64) ^ (doc << 40)).view(np.uint64) >> np.uint64(bits))


def _piece(t: np.ndarray, key: np.ndarray, bits: int, places: int, doc: np.ndarray | int = 0) -> bytes:
    """A bucket's part of the bit map of keys, each of which has two places."""
    return bitmap.piece(np.append(_hash(t, key, bits, doc), _hash(t, _turned(key), bits, doc)), places, bits)


def _among(known: BitMap, t: np.ndarray, key: np.ndarray, bits: int, doc: np.ndarray | None = None) -> np.ndarray:
    """The numbers of the keys that a bit map may have."""
    some = np.flatnonzero(known(_hash(t, key, bits, 0 if doc is None else doc)))
    return some[known(_hash(t[some], _turned(key[some]), bits, 0 if doc is None else doc[some]))]


def _own(t: np.ndarray) -> np.ndarray:
    """The key of a minimizer itself."""
    return t * np.uint64(0x9E3779B97F4A7C15)


def _dealt(bucket: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A row (bucket, packed) for each bucket with the bytes of its values; bucket is ascending."""
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    offsets = np.append(first, len(values)) * (values.nbytes // len(values))
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), packed], names=["bucket", "packed"])


def _gathered(rows: pa.Table, kind: type) -> np.ndarray:
    """The values of a bucket."""
    return np.frombuffer(b"".join(x for c in rows["packed"].chunks for x in c.to_pylist()), kind)


def _shared(docs: DataFrame, size: int, k: int, bits: int, places: int) -> BitMap:
    """Of the (turned) minimizers that occur twice: a superset of those that two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def packed() -> pa.RecordBatch:
            t = np.sort(np.concatenate(held))
            t = t[np.append([True, True], t[2:] != t[:-2])[: len(t)]]  # two of a kind tell as much as more
            return _dealt(t >> np.uint64(64 - bits), t)

        for chunk in chunks(batches, 0, _PASS):
            data, off = text_view(chunk.column(0))
            m = runs(data, off, size, k)[3]
            if len(m):
                held.append(_turned(m))
                count += len(m)
            if count >= _HELD:
                yield packed()
                held, count = [], 0
        if count:
            yield packed()

    def twice(rows: pa.Table) -> pa.Table:
        t = np.sort(_gathered(rows, np.uint64))
        again = t[1:][t[1:] == t[:-1]]
        return pa.table({"bucket": rows["bucket"][:1], "bits": pa.array([_piece(again, _own(again), bits, places)], pa.binary())})

    packed = docs.select("text").mapInArrow(run, "bucket int, packed binary")
    return BitMap.of_pieces(docs.sparkSession, packed.groupBy("bucket").applyInArrow(twice, "bucket int, bits binary").toArrow(), places)


def _grouped(rows: np.ndarray) -> np.ndarray:
    """Rows of turned minimizer, hash, least and greatest document, and what follows: one for each minimizer and hash."""
    turn = np.argsort(rows[:, 1])
    t, sh = rows[turn, 0], rows[turn, 1]
    first = np.flatnonzero(np.append(True, (sh[1:] != sh[:-1]) | (t[1:] != t[:-1])))
    lo, hi = np.minimum.reduceat(rows[turn, 2], first), np.maximum.reduceat(rows[turn, 3], first)
    return np.column_stack([t[first], sh[first], lo, hi, rows[turn[first], 4:]])


#: Of a run in which the minimizer's piece is more than once.
_SEVERAL = -1


def _sides(spans: SpanHash, order: np.ndarray, size: int, k: int, start: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Two hashes of 32 bits of the minimizer's piece in each run with half of the rest of a window to its left, and to its right;
    0 where the run does not reach as far. A window has one of them whole, so runs with an equal window have an equal one."""
    width, half = size - k + 1, (size - k) // 2
    pieces, least = np.lib.stride_tricks.sliding_window_view(order, width), m.view(np.uint64)[:, None]
    head, tail = pieces[start] == least, pieces[start + n - 1] == least
    at = start + head.argmax(axis=1)
    one = (n <= width) & (head.sum(axis=1) == 1) & (tail.sum(axis=1) == 1) & (start + n - 1 + tail.argmax(axis=1) == at)
    left, right = (at - half >= start), (at + k + half <= start + n + size - 1)
    low, high = np.where(left, at - half, at), np.where(right, at + k + half, at + k)
    sides = (np.where(left, spans(low, at + k) >> np.uint64(32) | np.uint64(1), 0) << np.uint64(32)) | np.where(right, spans(at, high) >> np.uint64(32) | np.uint64(1), 0)
    return np.where(one, sides.view(np.int64), _SEVERAL)


def _meet(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Whether runs of turned minimizers, ascending, may have a window of another run, of another document."""
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    of = np.diff(np.append(first, len(t)))

    def over(ufunc: np.ufunc, x: np.ndarray) -> np.ndarray:
        return np.repeat(ufunc.reduceat(x, first), of)

    others = np.repeat(of > 1, of) & (over(np.minimum, lo) < over(np.maximum, hi))
    out = others & over(np.logical_or, sides == _SEVERAL)
    some = np.flatnonzero(others & ~out)
    if len(some):
        both = sides[some].view(np.uint64)
        side = np.append(both >> np.uint64(32) << np.uint64(1), (both & np.uint64(0xFFFFFFFF)) << np.uint64(1) | np.uint64(1))
        row = np.append(some, some)[side > 1]
        key = mix(t[row].view(np.uint64) + mix(side[side > 1]))
        turn = np.argsort(key)
        row, key = row[turn], key[turn]
        if len(row):
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(head, len(row)))
            met = (count > 1) & (np.minimum.reduceat(lo[row], head) < np.maximum.reduceat(hi[row], head))
            out[row[np.repeat(met, count)]] = True
    return out


def _kinds(docs: DataFrame, size: int, k: int, bits: int, places: int, minimizers: BitMap) -> DataFrame:
    """(m, sh, lo, n, many) of the distinct runs that documents may lose bytes of: many if another may have some of their windows,
    else all documents but the least lose them whole. Equal runs are one row before they are shuffled. A row of each bucket has
    the bits of those that are not many, of those that are in their least document, and of those that several documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def packed() -> pa.RecordBatch:
            rows = _grouped(np.concatenate(held))
            bucket = (rows[:, 0].view(np.uint64) >> np.uint64(64 - bits)).astype(np.uint16)
            turn = np.argsort(bucket, kind="stable")
            return _dealt(bucket[turn], rows[turn])

        for chunk in chunks(batches, 1, _PASS):
            data, off = text_view(chunk.column(1))
            spans = SpanHash(data)
            order = _order(spans, k)
            d, start, n, m = runs(data, off, size, k, order)
            t = _turned(m)
            some = _among(minimizers, t, _own(t), bits) if len(t) else d
            if len(some):
                d, start, n = d[some], start[some], n[some]
                doc = chunk.column(0).to_numpy()[d]
                sides = _sides(spans, order, size, k, start, n, m[some])
                held.append(np.stack([t[some].view(np.int64), spans(start, start + n + size - 1).view(np.int64), doc, doc, n, sides], axis=1))
                count += len(some)
            if count >= _HELD // 4:
                yield packed()
                held, count = [], 0
        if count:
            yield packed()

    def settle(rows: pa.Table) -> pa.Table:
        all_ = _grouped(_gathered(rows, np.int64).reshape(-1, 6))
        all_ = all_[np.argsort(all_[:, 0])]
        t, sh, lo, hi, n, sides = np.ascontiguousarray(all_.T)
        many = _meet(t, lo, hi, sides)
        t, sh, lo, hi, n, many = (c[many | (lo < hi)] for c in (t, sh, lo, hi, n, many))
        t = t.view(np.uint64)
        more = many & (lo < hi)
        parts = _piece(t[~many], sh[~many], bits, places), _piece(t[many], sh[many], bits, places, lo[many]), _piece(t[more], sh[more], bits, places)
        own = [b"".join(parts)] if len(t) else []
        maps = pa.concat_arrays([pa.array(own, pa.binary()), pa.nulls(len(t) - len(own), pa.binary())])
        return pa.table([pa.array(np.full(len(t), rows["bucket"][0].as_py(), np.int32)), _turned(t).view(np.int64), sh, lo, n, many, maps], names=["bucket", "m", "sh", "lo", "n", "many", "bits"])

    packed = docs.select("doc", "text").mapInArrow(run, "bucket int, packed binary")
    return packed.groupBy("bucket").applyInArrow(settle, "bucket int, m long, sh long, lo long, n long, many boolean, bits binary")


def _found(docs: DataFrame, size: int, k: int, columns: Callable[..., list[pa.Array]], schema: str) -> DataFrame:
    """Columns made of the runs of each chunk: columns gets its text, offsets, documents and texts' hashes, and its runs' documents,
    first windows, windows, minimizers and hashes."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 2, _PASS):
            data, off = text_view(chunk.column(2))
            spans = SpanHash(data)
            d, start, n, m = runs(data, off, size, k, _order(spans, k))
            if len(d):
                sh = spans(start, start + n + size - 1).view(np.int64)
                yield pa.RecordBatch.from_arrays(columns(data, off, chunk.column(0), chunk.column(1), d, start, n, m, sh), names=names)

    return docs.select("doc", "th", "text").mapInArrow(run, schema)


def _segments(docs: DataFrame, size: int, k: int, bits: int, first: BitMap, more: BitMap) -> DataFrame:
    """(m, sh, seg, lo, hi) of the runs that are to be sorted: their bytes, the least document, and whether a greater one has them.
    Other runs that bit maps let pass do no harm: they share no window with any of them, or are there already."""

    def columns(data, off, doc, th, d, start, n, m, sh) -> list[pa.Array]:
        t, own, raw = _turned(m), doc.to_numpy()[d], data.tobytes()
        some = _among(first, t, sh, bits, own)
        t, own, start, end, m, sh = t[some], own[some], start[some], (start + n + size - 1)[some], m[some], sh[some]
        high, others = own.copy(), _among(more, t, sh, bits)
        high[others] += own[others] < _LAST
        return [pa.array(m), pa.array(sh), pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()), pa.array(own), pa.array(high)]

    return _found(docs, size, k, columns, "m long, sh long, seg binary, lo long, hi long")


def _places(docs: DataFrame, size: int, k: int, bits: int, alone: BitMap, ordered: BitMap) -> DataFrame:
    """(m, sh, doc, th, start, n) of the runs that may be among those of two bit maps: where each starts, and its windows."""

    def columns(data, off, doc, th, d, start, n, m, sh) -> list[pa.Array]:
        some = ordered(sh)
        some[_among(alone, _turned(m), sh, bits)] = True
        some = np.flatnonzero(some)
        own = pa.array(d[some])
        return [pa.array(m[some]), pa.array(sh[some]), doc.take(own), th.take(own), pa.array((start - off[d])[some].astype(np.int32)), pa.array(n[some].astype(np.int32))]

    return _found(docs, size, k, columns, "m long, sh long, doc long, th long, start int, n int")


class Shard:
    """Segments of one shard on disk, as 16-bit symbols with a zero after each."""

    def __init__(self, folder: str, size: int, held: int):
        self.folder, self.size, self.held = folder, size, held
        self.file = induced.File(folder, np.uint16)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.known: dict[tuple[int, int], int] = {}
        self.documents: list[tuple[np.ndarray, ...]] = []

    def add(self, m: pa.Array, sh: pa.Array, seg: pa.Array, low: pa.Array, high: pa.Array) -> None:
        known = len(self.known)
        own = np.array([self.known.setdefault(x, len(self.known)) for x in zip(m.to_pylist(), sh.to_pylist(), strict=True)])
        self.documents.append((own, low.to_numpy(), high.to_numpy()))
        new = pa.array(own > np.maximum.accumulate(np.append(known - 1, own[:-1])))
        m, sh, seg = m.filter(new), sh.filter(new), seg.filter(new)
        if not len(seg):
            return
        _, offsets, data = seg.buffers()
        off = np.frombuffer(offsets, np.int32, len(seg) + 1, seg.offset * 4).astype(np.int64)
        n = np.diff(off)
        symbols = np.zeros(int(n.sum()) + len(seg), np.uint16)
        symbols[np.arange(int(n.sum())) + np.repeat(np.arange(len(seg)), n)] = np.frombuffer(data, np.uint8)[off[0] : off[-1]].astype(np.uint16) + 1
        begin = self.file.size + off[:-1] - off[0] + np.arange(len(seg))
        self.file.append(symbols)
        self.parts.append((begin, m.to_numpy(), sh.to_numpy()))

    def results(self) -> Iterator[pa.RecordBatch]:
        """Each segment's minimizer and hash with its windows that some of its documents lose: offset, count, smallest document."""
        begin, m, sh = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        low, high = np.full(len(m), _LAST), np.zeros(len(m), np.int64) - _LAST
        for own, lo, hi in self.documents:
            np.minimum.at(low, own, lo)
            np.maximum.at(high, own, hi)
        symbols, n = self.file.done(), self.file.size
        end, rank = np.append(begin[1:], n), induced.Rank(begin, n)

        def owner(at: np.ndarray) -> np.ndarray:
            less, first = rank(at)
            return less + first - 1

        # places of windows in suffix order, numbered by groups of equal ones, and the least document of each group
        places, groups, least = (induced.File(self.folder) for _ in range(3))
        group, pending = -1, _LAST
        for at, shared in induced.suffixes(symbols, self.size, self.folder, self.held):
            new = shared < self.size
            own = group + np.cumsum(new)
            s = owner(at)
            window = at + self.size < end[s]
            first = np.flatnonzero(np.append(True, new[1:]))
            found = np.minimum.reduceat(np.where(window, low[s], _LAST), first)
            if not new[0]:
                found[0] = min(int(found[0]), pending)
            elif group >= 0:
                least.append(np.array([pending]))
            least.append(found[:-1])
            group, pending = int(own[-1]), int(found[-1])
            places.append(at[window])
            groups.append(own[window])
        least.append(np.array([pending]))
        at, own, by_group = places.done(), groups.done(), least.done()
        lost = induced.File(self.folder)
        marks = lost.filled(n, _LAST)
        for lo in range(0, len(at), _BLOCK):
            here, doc = at[lo : lo + _BLOCK], by_group[own[lo : lo + _BLOCK]]
            some = high[owner(here)] > doc
            marks[here[some]] = doc[some]
        s = 0
        while s < len(begin):
            e = max(s + 1, int(np.searchsorted(end, begin[s] + _BLOCK, "right")))
            yield self._spans(marks[begin[s] : end[e - 1]], begin[s:e] - begin[s], m[s:e], sh[s:e])
            s = e
        for f in (self.file, places, groups, least, lost):
            f.drop()

    @staticmethod
    def _spans(mark: np.ndarray, begin: np.ndarray, m: np.ndarray, sh: np.ndarray) -> pa.RecordBatch:
        """Rows of the segments that have marks; no mark is next to another segment's."""
        edge = np.flatnonzero(mark[1:] != mark[:-1]) + 1
        start, stop = np.append(0, edge), np.append(edge, len(mark))
        lo = mark[start]
        some = lo != _LAST
        start, stop, lo = start[some], stop[some], np.asarray(lo[some])
        s = np.searchsorted(begin, start, "right") - 1
        own, count = np.unique(s, return_counts=True)
        spans = pa.StructArray.from_arrays([pa.array((start - begin[s]).astype(np.int32)), pa.array((stop - start).astype(np.int32)), pa.array(lo)], fields=list(_SPAN))
        lost = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), spans)
        return pa.RecordBatch.from_arrays([pa.array(m[own]), pa.array(sh[own]), lost], names=["m", "sh", "lost"])


_LOST = "lost array<struct<o:int,n:int,lo:long>>"
_SPAN = pa.struct([("o", pa.int32()), ("n", pa.int32()), ("lo", pa.int64())])


def _sorted(distinct: DataFrame, shards: int, size: int, held: int) -> DataFrame:
    """(m, sh, lost) of segments (m, sh, seg, lo, hi), each taken once; a partition is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            shard = Shard(folder, size, held)
            for batch in batches:
                if batch.num_rows:
                    shard.add(*batch.columns)
            if shard.parts:
                yield from shard.results()

    return distinct.select("m", "sh", "seg", "lo", "hi").repartition(shards, "m").mapInArrow(run, f"m long, sh long, {_LOST}")


def _drop(*tables: DataFrame) -> None:
    """Deletes tables of ``settled`` that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            home = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            home.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(home, True)


def _by_text(spans: DataFrame) -> DataFrame:
    """(doc, th, spans) of rows (doc, th, span), ascending."""

    def lists(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows:
            doc, th, span = (c.combine_chunks() for c in pa.Table.from_batches(rows).columns)
            first = np.append(0, _changes(doc, th))
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(first)), th.take(pa.array(first)), pa.ListArray.from_arrays(pa.array(np.append(first, len(span)).astype(np.int32)), span)], names=["doc", "th", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last text, whose rows may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            change = _changes(batch["doc"], batch["th"])
            if held and (held[-1]["doc"][-1], held[-1]["th"][-1]) != (batch["doc"][0], batch["th"][0]):
                yield from lists(held)
                held = []
            if len(change):
                yield from lists([*held, batch.slice(0, int(change[-1]))])
                held, batch = [], batch.slice(int(change[-1]))
            held.append(batch)
        yield from lists(held)

    return spans.repartition("doc", "th").sortWithinPartitions("doc", "th", "span").mapInArrow(run, "doc long, th long, spans array<long>")


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where rows differ from those before them."""
    values = [c.to_numpy() for c in columns]
    return np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the maximal runs that ascending spans cover."""
    if not len(spans):
        return []
    start = spans >> _LENGTH
    end = np.maximum.accumulate(start + (spans & ((1 << _LENGTH) - 1)))
    first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return list(zip(start[first].tolist(), end[np.append(first[1:], len(start)) - 1].tolist(), strict=True))


def dedup(docs: DataFrame, size: int = SIZE, piece: int = PIECE, shard_bytes: int = SHARD_BYTES, held: int = 1 << 18, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the bytes that stay."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark, bits, places = docs.sparkSession, min(14, max(4, (total // _BUCKET).bit_length())), bitmap.places(total // _RARE)
    shared = _shared(rows, size, piece, bits, bitmap.places(total // _RARE, 1))
    spark.sparkContext._jvm.System.gc()  # the minimizers' shuffle goes before that of the runs comes
    kinds = settled(_kinds(rows, size, piece, bits, places, shared))
    shared.drop()
    total = kinds.where("many").agg(F.sum(F.col("n") + size - 1)).first()[0] or 0
    pieces = kinds.where("bits IS NOT NULL").select("bucket", "bits").toArrow()
    alone, first, more = (BitMap.of_pieces(spark, pieces, places, part, 3) for part in range(3))
    distinct = _segments(rows, size, piece, bits, first, more)
    ordered = settled(_sorted(distinct, max(SHARDS, -(-total // shard_bytes)), size, held))
    first.drop()
    more.drop()
    # a run that shares no window with another is lost whole
    lost = kinds.where("NOT many").select("m", "sh", "lo", F.lit(None).cast(_LOST.split(" ", 1)[1]).alias("lost"))
    lost = lost.unionAll(ordered.select("m", "sh", F.lit(None).cast("long").alias("lo"), "lost"))
    ranked = BitMap(ordered, F.col("sh"), bitmap.places(ordered.count()))
    losing = _places(rows, size, piece, bits, alone, ranked).join(lost, ["m", "sh"])
    whole = F.array(F.struct(F.lit(0).alias("o"), "n", "lo"))
    each = losing.select("doc", "th", "start", F.explode(F.coalesce("lost", whole)).alias("x")).where("x.lo < doc")
    # start and length in one number: a text has less than 2 ** 31 bytes
    spans = each.select("doc", "th", F.shiftleft((F.col("start") + F.col("x.o")).cast("long"), _LENGTH).bitwiseOR((F.col("x.n") - 1 + size).cast("long")).alias("span"))
    spans = settled(_by_text(spans))
    alone.drop()
    ranked.drop()
    del losing, each, lost, distinct
    _drop(kinds, ordered)
    spark.sparkContext._jvm.System.gc()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 1):
            data, off = text_view(chunk.column(1))
            raw, out = data.tobytes(), [[], [], [], [], []]
            for a, b, own in zip(off[:-1].tolist(), off[1:].tolist(), chunk.column(2).to_pylist(), strict=True):
                at, kept = 0, []
                for lo, hi in merged(np.array(own or (), np.int64)):
                    kept.append(raw[a + at : a + lo])
                    at = hi
                gone = len(kept)
                kept.append(raw[a + at : b])
                text = b"".join(kept)
                for col, v in zip(out, (b - a, b - a - len(text), gone, hashlib.sha256(text).hexdigest(), text), strict=True):
                    col.append(v)
            cols = [chunk.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), *[pa.array(out[4], pa.binary())] * keep_text]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    whole = rows.join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def query(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS k FROM (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS p FROM d)),
f AS (SELECT r, p, coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY k) AS again FROM w),
c AS (SELECT r, p, sum(CASE WHEN p - q <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT r, p, lag(p, 1, -100) OVER (PARTITION BY r ORDER BY p) AS q FROM f WHERE again)),
s AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM c GROUP BY r, g),
j AS (SELECT s.*, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM s),
t AS (SELECT r, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM j JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
