"""Benchmark decontamination: a broadcast hash set of benchmark word windows scanned over whole documents.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``n`` consecutive words
of an item; an item of fewer words, but not none, is one window. A hash hit counts only once its words are compared.

Defined results: null and empty texts have no words and no hits; very long texts are scanned whole; repeated rows and
repeated doc_ids each give their own row; items with equal ids count once; items without an id mark words but are not
listed; an empty benchmark marks nothing; empty documents give no rows; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHash, chunks, cut, fresh, lower_table, ship, table, text_view, word_spans

#: Text bytes of benchmark items that one pass broadcasts, about nine times that with their windows; more items are scanned
#: in further passes.
BLOCK_BYTES = 8 << 20
_LOWER = lower_table()
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_Q = np.uint64(0xD6E8FEB86659FD93)


def _window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Of every n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:m].copy()
        for j in range(1, n):
            out = out * _Q + words[j : j + m]
    return out


class WindowSet:
    """The windows of some benchmark items (id, text), by length: sorted hashes, a bit map of them, and for each its item and
    its place in one buffer of the items' words, a space between any two, to verify hits. Some 50 bytes a window."""

    def __init__(self, items: pa.Table, n: int):
        self.ids = [str(x) if x is not None else None for x in items.column(0).to_pylist()]
        self.by_length: dict[int, dict] = {}
        words, found, rows, place = [], {}, 0, 0
        for chunk in chunks(iter(items.to_batches()), 1):
            data, off = text_view(chunk.column(1))
            data = _LOWER[data]
            start, end, doc = word_spans(data, off, _WORD)
            count = np.bincount(doc, minlength=chunk.num_rows)
            raw, hashes = data.tobytes(), SpanHash(data)(start, end) if len(start) else np.zeros(0, np.uint64)
            words += [b" ".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])]
            at = place + np.cumsum(end - start + 1) - (end - start + 1)  # of each word in the buffer
            for size in np.unique(np.minimum(count[count > 0], n)).tolist():
                w = _window_hashes(hashes, size)
                i = np.arange(len(w))
                i = i[(doc[i] == doc[i + size - 1]) & (count[doc[i]] >= n if size == n else count[doc[i]] == size)]
                last = i + size - 1
                found.setdefault(size, []).append((w[i], (rows + doc[i]).astype(np.int32), at[i], (at[last] + end[last] - start[last] - at[i]).astype(np.int32)))
            place += len(words[-1]) + 1
            rows += chunk.num_rows
        self.words = b" ".join(words)
        for size, parts in found.items():
            hashes, item, at, long = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((item, hashes))
            hashes, item, at, long = hashes[order], item[order], at[order], long[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])
            bits = min(24, max(16, int(len(hashes)).bit_length() + 3))
            known = np.zeros(1 << bits, bool)
            known[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.by_length[size] = {"hash": hashes[new], "item": item[new], "at": at[new], "long": long[new], "bits": bits, "known": known}


def _scan(chunk: pa.RecordBatch, text: int, windows: WindowSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set]]:
    """Of a chunk: each word's start, end, document and whether it is hit; the items of each document."""
    data, off = text_view(chunk.column(text))
    data = _LOWER[data]
    start, end, doc = word_spans(data, off, _WORD)
    hits = np.zeros(len(start) + 1, np.int64)
    items: list[set] = [set() for _ in range(chunk.num_rows)]
    if len(start):
        hashes = SpanHash(data)(start, end)
        for size, known in windows.by_length.items():
            w = _window_hashes(hashes, size)
            if not len(w):
                continue
            maybe = np.flatnonzero(known["known"][(w >> np.uint64(64 - known["bits"])).astype(np.int64)])
            maybe = maybe[doc[maybe] == doc[maybe + size - 1]]
            left = np.searchsorted(known["hash"], w[maybe], "left")
            right = np.searchsorted(known["hash"], w[maybe], "right")
            for i, lo, hi in zip(maybe.tolist(), left.tolist(), right.tolist(), strict=True):
                if lo == hi:
                    continue
                own, hit = b" ".join(data[start[k] : end[k]].tobytes() for k in range(i, i + size)), False
                for k in range(lo, hi):
                    a = int(known["at"][k])
                    if known["long"][k] == len(own) and windows.words[a : a + len(own)] == own:
                        hit = True
                        items[doc[i]].add(windows.ids[known["item"][k]])
                if hit:
                    hits[i] += 1
                    hits[i + size] -= 1
    return start, end, doc, np.cumsum(hits)[:-1] > 0, items


def _blocks(benchmark: DataFrame, n: int, id_col: str, text_col: str, block_bytes: int) -> list[Callable[[], WindowSet]]:
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = -(-total // block_bytes) or 1
    part = lambda b: rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == b) if count > 1 else rows
    return [lambda b=b: WindowSet(part(b).toArrow(), n) for b in range(count)]


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def mark(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, last: Callable | None = None) -> DataFrame:
    """docs with ``dc_words`` (long), ``dc_spans`` (hit words: start and end byte) and ``dc_items`` (strings) added, with
    underscores after these names where docs has such columns.

    A benchmark of over ``block_bytes`` is broadcast and scanned block by block, each pass written to shared storage.
    ``last`` may turn (columns, spans) of the last pass into the columns of docs to return, within the same pass.
    """
    spark = docs.sparkSession
    ship(spark)
    at, given = docs.columns.index(text_col), docs.columns
    docs = docs.toDF(*[f"c{k}" for k in range(len(given))])  # dots in names don't pass
    out, own_names, names = docs, docs.columns, [*docs.columns, "dc_words", "dc_spans", "dc_items"]
    schema = T.StructType([*docs.schema.fields, T.StructField("dc_words", T.LongType()), T.StructField("dc_spans", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))), T.StructField("dc_items", T.ArrayType(T.StringType()))])
    blocks = _blocks(benchmark, n, item_col, item_text, block_bytes)
    for k, windows in enumerate(blocks):
        shared, finish = spark.sparkContext.broadcast(windows()), last if k == len(blocks) - 1 else None

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, k=k, finish=finish) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches, at):
                _, off = text_view(chunk.column(at))
                start, end, doc, hit, items = _scan(chunk, at, shared.value)
                words = np.bincount(doc, minlength=chunk.num_rows)
                where = np.flatnonzero(hit)
                spans = [[] for _ in items]
                for i, d in zip(where.tolist(), doc[where].tolist(), strict=True):
                    spans[d].append({"s": int(start[i] - off[d]), "e": int(end[i] - off[d])})
                own = [sorted(x - {None}) for x in items]
                base = chunk.columns
                if k:
                    base, (old_s, old_i) = base[:-3], (chunk.column(chunk.num_columns - 2).to_pylist(), chunk.column(chunk.num_columns - 1).to_pylist())
                    spans = [sorted({(x["s"], x["e"]) for x in (*a, *b)}) for a, b in zip(spans, old_s, strict=True)]
                    spans = [[{"s": s, "e": e} for s, e in x] for x in spans]
                    own = [sorted({*a, *b}) for a, b in zip(own, old_i, strict=True)]
                if finish:
                    yield pa.RecordBatch.from_arrays(finish(base, spans), names=own_names)
                else:
                    yield pa.RecordBatch.from_arrays([*base, pa.array(words, pa.int64()), pa.array(spans, _SPANS), pa.array(own, pa.list_(pa.string()))], names=names)

        if k:
            out = cut(out)
        out = out.mapInArrow(scan, docs.schema if finish else schema)
    return out.toDF(*given) if last else out.toDF(*given, *(fresh(c, given) for c in ("dc_words", "dc_spans", "dc_items")))


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = mark(docs.select("doc_id", "text"), benchmark, n)
    return marked.select(
        "doc_id", F.col("dc_words").alias("n_words"), F.size("dc_spans").cast("long").alias("n_hit"), F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ","), 256).alias("items_sha256"), (F.size("dc_spans") > 0).alias("contaminated"),
    )


def _strip(text: str, spans: list[dict]) -> str:
    """Without the hit words and what stands between two of them."""
    raw, out, at = text.encode("utf-8"), [], 0
    for s in spans:
        gap = raw[at : s["s"]]
        if not at or _WORD[_LOWER[np.frombuffer(gap, np.uint8)]].any():
            out.append(gap)
        at = s["e"]
    return b"".join([*out, raw[at:]]).decode("utf-8")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "span") -> DataFrame:
    """docs without benchmark text: ``span`` cuts the hit words (with what separates them), ``document`` drops the rows."""
    at = docs.columns.index("text")

    def drop(columns: list, spans: list) -> list:
        clean = pa.array([not x for x in spans], pa.bool_())
        return [c.filter(clean) for c in columns]

    def strip(columns: list, spans: list) -> list:
        hit = [i for i, x in enumerate(spans) if x]
        if not hit:
            return columns
        texts = columns[at].to_pylist()
        for i in hit:
            texts[i] = _strip(texts[i], spans[i])
        return [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(columns)]

    return mark(docs, benchmark, n, last={"document": drop, "span": strip}[mode])


def query(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = """
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM bw)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM documents),
dw AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win))),
h AS (SELECT r, i, dw.size, item_id FROM dw JOIN win ON dw.size = win.size AND dw.k = win.k),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
