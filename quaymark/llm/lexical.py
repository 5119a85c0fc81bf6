"""Ranked lexical search by Fagin's threshold algorithm: the best documents of each item, with exact integer scores.

Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. One pass over the texts writes the
forward index to the shared folder: a row a document with its length and its counts of the items' terms. From it come the
corpus statistics, as aggregates. The search reads the index in blocks of bounded size. In each block every term has its
list of documents by falling impact; an item's lists are read round-robin, a document met for the first time is scored at
once by looking it up in the forward index, and the item is done with the block as soon as the threshold, the sum of the
impacts last read, is strictly below its k-th score. A task carries its k best from block to block, so that later blocks
end early, often before the first entry; tasks' bests are merged by a window that limits groups before it shuffles.

Defined results: null and empty texts have no terms, are in no statistic and are never found; long texts are taken whole;
rows without doc_id or item_id are left out; documents with equal ids are ranked each for itself; benchmark rows with equal
ids make one item of all their terms; equal scores go by doc_id; items that nothing matches, empty tables and an empty
benchmark give no rows; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHash, chunks, lower_table, shared_dir, table, text_view, token_hashes, written

#: Text bytes of items that one pass over the documents looks for; more items take further passes, each with its own index.
ITEM_BYTES = 8 << 20
#: Entries of the forward index that a task holds at a time; a document's own are never divided.
BLOCK_ENTRIES = 1 << 21
#: Entries read from each list before the threshold is first looked at; then twice as many each time.
FIRST = 64
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = lower_table()
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


class Vocabulary:
    """Terms numbered from 0, found by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.long = np.array([len(x) for x in raw], np.int64)
        self.at = np.cumsum(self.long) - self.long
        hashes = SpanHash(self.data)(self.at, self.at + self.long) if raw else np.zeros(0, np.uint64)
        self.number = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.number]
        if len(np.unique(hashes)) < len(raw):
            raise ValueError("two terms have one hash")

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the spans are terms, and the terms' numbers."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        hit = np.flatnonzero(self.hashes[at] == hashes) if len(self.hashes) else np.zeros(0, np.int64)
        term = self.number[at[hit]] if len(hit) else hit
        same = self.long[term] == end[hit] - start[hit]
        hit, term = hit[same], term[same]
        if not len(hit):
            return hit, term
        long = self.long[term]
        first = np.cumsum(long) - long
        step = np.arange(int(long.sum())) - np.repeat(first, long)
        equal = data[np.repeat(start[hit], long) + step] == self.data[np.repeat(self.at[term], long) + step]
        right = np.logical_and.reduceat(equal, first)
        return hit[right], term[right]


def _terms(items: DataFrame) -> DataFrame:
    """item_id, term: an item's terms, once each."""
    found = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOW), F.lit(f"({_TERM})"))
    return items.where("item_id is not null").select("item_id", F.explode(found).alias("term")).distinct()


def forward_index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of those asked for that occur, ascending), counts: every document with a term."""
    known = docs.sparkSession.sparkContext.broadcast(Vocabulary(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, width = known.value, max(len(terms), 1)
        for chunk in chunks(batches, 1):
            data, off = text_view(chunk.column(1))
            data = _LOWER[data]
            start, end, doc, hashes = token_hashes(data, off, _WORD)
            n = np.bincount(doc, minlength=chunk.num_rows)
            hit, term = vocabulary.find(data, start, end, hashes)
            cell, tf = np.unique(doc[hit] * width + term, return_counts=True)
            ends = np.searchsorted(cell, (np.arange(chunk.num_rows + 1)) * width).astype(np.int32)
            some = pa.array(n > 0)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cell % width, tf)]
            yield pa.RecordBatch.from_arrays([c.filter(some) for c in (chunk.column(0), pa.array(n, pa.int64()), *lists)], ["doc_id", "n", "terms", "counts"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>"))


class Block:
    """Some documents of the forward index, and of each term the list of them by falling impact."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.sizes, self.term, self.impact = ids, sizes, term, impact
        self.first = np.cumsum(sizes) - sizes
        order = np.argsort((term.astype(np.int64) << 36) | ((1 << 36) - 1 - impact))
        self.list_row = np.repeat(np.arange(len(ids)), sizes)[order]
        self.list_impact = impact[order]
        self.list_at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Of documents, looked up in the forward index: the sum of the impacts of the wanted terms."""
        sizes = self.sizes[rows]
        begin = np.cumsum(sizes) - sizes
        at = np.repeat(self.first[rows] - begin, sizes) + np.arange(int(sizes.sum()))
        return np.add.reduceat(np.where(wanted[self.term[at]], self.impact[at], 0), begin)

    def search(self, terms: np.ndarray, wanted: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """The k best (ids, scores) of ``best`` and this block's documents for an item's terms, and how many were looked up."""
        ids, scores = best
        a, b = self.list_at[terms], self.list_at[terms + 1]
        seen, looked, depth, step = np.zeros(len(self.ids), bool), 0, 0, FIRST
        while True:
            live = a + depth < b
            if not live.any():
                break
            last = self.list_impact[a[live] + max(depth - 1, 0)]  # before the first entry: the heads, which bound as well
            if len(ids) == k and int(last.sum()) < scores[-1]:
                break
            stops = np.minimum(a[live] + depth + step, b[live])
            rows = np.unique(np.concatenate([self.list_row[x:y] for x, y in zip((a[live] + depth).tolist(), stops.tolist(), strict=True)]))
            rows = rows[~seen[rows]]
            if len(rows):
                seen[rows], looked = True, looked + len(rows)
                found = self.scores(rows, wanted)
                ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, found])
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
            depth, step = depth + step, step * 2
        return (ids, scores), looked


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, lengths, sizes, terms and counts of documents with about ``limit`` entries in all."""
    held, entries = [], 0
    join = lambda: tuple(np.concatenate(x) for x in zip(*held, strict=True))
    for batch in batches:
        ids, n = (batch.column(i).to_numpy() for i in (0, 1))
        sizes = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
        term, tf = (batch.column(i).flatten().to_numpy() for i in (2, 3))
        some = sizes > 0
        held.append((ids[some], n[some], sizes[some], term, tf))
        entries += len(term)
        if entries >= limit:
            yield join()
            held, entries = [], 0
    if entries:
        yield join()


def search(docs: DataFrame, benchmark: DataFrame, k: int = 50, item_bytes: int | None = None, block_entries: int | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents of the highest scores above 0."""
    spark, items = docs.sparkSession, benchmark.select("item_id", "text")
    shared_dir(spark)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-total // (item_bytes or ITEM_BYTES))
    out = None
    for p in range(passes):
        part = _search(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p), k, block_entries or BLOCK_ENTRIES)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else _empty(spark, items)


def _empty(spark, items: DataFrame) -> DataFrame:
    return items.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))


def _search(docs: DataFrame, items: DataFrame, k: int, block_entries: int) -> DataFrame:
    """One pass: items' terms come to the driver, at most ITEM_BYTES of them, and their counts of documents."""
    spark = docs.sparkSession
    got = _terms(items).toArrow().combine_chunks()
    if not got.num_rows:
        return _empty(spark, items)
    names, terms = got["item_id"].combine_chunks().dictionary_encode(), got["term"].combine_chunks().dictionary_encode()
    index = forward_index(docs, terms.dictionary.to_pylist())
    whole = index.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L"))
    size = whole.first()
    if not size["N"]:
        return _empty(spark, items)
    held = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(size["N"]) + 2) / (2 * F.col("df") + 1)))
    n_terms, weights = len(terms.dictionary), np.zeros(len(terms.dictionary), np.int64)
    for r in held.select("t", weight.alias("w")).toLocalIterator():  # at most a row a term
        weights[r["t"]] = r["w"]
    order = np.argsort(names.indices.to_numpy(), kind="stable")
    of = np.split(terms.indices.to_numpy()[order], np.cumsum(np.bincount(names.indices.to_numpy()))[:-1])
    asked = spark.sparkContext.broadcast(([t[weights[t] > 0] for t in of], weights, int(size["N"]), int(size["L"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, w, N, L = asked.value
        none, wanted = (np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(n_terms, bool)
        best = [none] * len(lists)
        for ids, n, sizes, term, tf in _blocks(batches, block_entries):
            m = 50 + 50 * n * N // L
            tf = tf.astype(np.int64)
            impact = w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes)))
            block = Block(ids, sizes, term, impact, n_terms)
            for i, own in enumerate(lists):
                wanted[own] = True
                best[i], _ = block.search(own, wanted, best[i], k)
                wanted[own] = False
        for i, (ids, scores) in enumerate(best):
            above = scores > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(above.sum()), i, np.int32)), pa.array(ids[above]), pa.array(scores[above])], ["item", "doc_id", "score"])

    found = index.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))
    first = found.withColumn("rank", place).where(F.col("rank") <= k)
    labels = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(of), dtype=np.int32)), "item_id": names.dictionary}))
    return first.join(F.broadcast(labels), "item").select("item_id", "rank", "doc_id", "score")  # as many as items of one pass


def query(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERM = "[^\\x{00}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+"
ORACLE = f"""
WITH b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOW}'), '{_SQL_TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOW}'), '{_SQL_TERM}') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT CAST(count(*) AS BIGINT) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, N),
m AS (SELECT r, doc_id, 50 + (50 * len(d.w) * N) // L AS m FROM d, s),
i AS (SELECT p.r, m.doc_id, term, t.w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS impact FROM p JOIN t USING (term) JOIN m ON m.r = p.r),
x AS (SELECT item_id, i.r, any_value(i.doc_id) AS doc_id, CAST(sum(impact) AS BIGINT) AS score FROM b JOIN i USING (term) GROUP BY item_id, i.r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 50
"""
