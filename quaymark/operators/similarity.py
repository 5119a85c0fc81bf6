"""Exact similarity joins with a reference corpus: pivots and the triangle inequality on angles skip what can't matter.

The corpus is taken in broadcast chunks of bounded size. A chunk's vectors are divided into cells by their nearest pivot, and
each cell knows the least and greatest angle of its members to its own pivot and to a few others. For a vector q and a cell,
angle(q, member) is at least angle(q, pivot) - greatest and least - angle(q, pivot) for each of these pivots: where that is
more than the angle sought, the whole cell is skipped. What isn't is compared in full, so results don't depend on the pivots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.sources.shared import written

#: Vectors of a broadcast chunk.
CHUNK = 1 << 15
#: Pivots, besides a cell's own, whose angles bound a cell.
ANCHORS = 8
#: Chunks that one job takes; what it found is written before the next.
PASSES = 8
#: Over the rounding of angles: cosines are good to 1e-15, so angles to 1e-7.
SLACK = 1e-6


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length 1, and which rows they are: null, zero and non-finite ones and those with null components aren't there."""
    rows = [None if x is None or any(v is None for v in x) else x for x in column.to_pylist()]
    long = max((len(x) for x in rows if x), default=0)
    keep = np.array([i for i, x in enumerate(rows) if x and len(x) == long], np.int64)
    vectors = np.array([rows[i] for i in keep], np.float64).reshape(len(keep), long)
    norm = np.sqrt((vectors**2).sum(1))
    fine = np.isfinite(norm) & (norm > 0)
    return vectors[fine] / norm[fine, None], keep[fine]


class Cells:
    """A chunk of the corpus by nearest pivot."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        n = len(vectors)
        step = max(1, n // max(1, min(256, round(n**0.5))))
        self.pivots = vectors[::step]  # members, so their cosines are found at once
        near = vectors @ self.pivots.T
        order = np.argsort(near.argmax(1), kind="stable")
        self.ids, self.vectors, cell = ids[order], vectors[order], near.argmax(1)[order]
        self.start = np.searchsorted(cell, np.arange(len(self.pivots) + 1))
        angle = np.arccos(np.clip(near[order], -1, 1))
        self.bound = []
        for c in range(len(self.pivots)):
            own = angle[self.start[c] : self.start[c + 1]]
            by = np.unique([c, *range(0, len(self.pivots), max(1, len(self.pivots) // ANCHORS))])
            self.bound.append((by, own[:, by].min(0), own[:, by].max(0)) if len(own) else None)

    def visit(self, q: np.ndarray, reach: Callable[[np.ndarray], np.ndarray], found: Callable[[np.ndarray, slice, np.ndarray], None]) -> np.ndarray:
        """Gives ``found`` (rows of q, members, cosines) of every cell that may hold members within ``reach`` (an angle for
        each of the given rows, asked anew for every cell); how many pairs each row of q was compared in."""
        near = q @ self.pivots.T
        angle, home = np.arccos(np.clip(near, -1, 1)), near.argmax(1)
        compared = np.full(len(q), len(self.pivots))

        def look(c: int, rows: np.ndarray) -> None:
            if len(rows):
                span = slice(self.start[c], self.start[c + 1])
                compared[rows] += span.stop - span.start
                found(rows, span, q[rows] @ self.vectors[span].T)

        for c, bound in enumerate(self.bound):  # first the cell that each row lies in, which makes reach small
            if bound:
                look(c, np.flatnonzero(home == c))
        for c, bound in enumerate(self.bound):
            if bound:
                by, low, high = bound
                least = np.maximum(angle[:, by] - high, low - angle[:, by]).max(1)
                rows = np.flatnonzero(home != c)
                look(c, rows[least[rows] <= reach(rows) + SLACK])
        return compared


def _chunks(corpus: DataFrame, chunk: int) -> Iterator[Cells]:
    """corpus (id, embedding) in chunks of about so many vectors, each small enough for the driver and every task."""
    n = -(-corpus.count() // chunk)
    for k in range(n):
        got = corpus.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).select("id", "embedding").toArrow()
        vectors, keep = units(got["embedding"].combine_chunks())
        if len(keep):
            yield Cells(got["id"].to_numpy()[keep], vectors)


def best_match(df: DataFrame, corpus: DataFrame, chunk: int | None = None) -> DataFrame:
    """vec_id, best, compared: of each row of df (vec_id, embedding) the greatest cosine with any vector of corpus (id,
    embedding), null for vectors that have none, and the number of pairs that were looked at."""
    spark, out = df.sparkSession, df.select("vec_id", "embedding", F.lit(None).cast("double").alias("best"), F.lit(0).cast("long").alias("compared"))
    for k, cells in enumerate(_chunks(corpus, chunk or CHUNK)):
        known = spark.sparkContext.broadcast(cells)
        if k and k % PASSES == 0:
            out = written(out)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, keep = units(batch.column(1))
                before = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                best = np.fmax(before[keep], (q @ known.value.pivots.T).max(1)) if len(keep) and q.shape[1] == known.value.pivots.shape[1] else before[keep]
                compared = batch.column(3).to_numpy().copy()
                if len(keep) and q.shape[1] == known.value.pivots.shape[1]:

                    def found(rows: np.ndarray, _: slice, cosines: np.ndarray, best=best) -> None:
                        best[rows] = np.maximum(best[rows], cosines.max(1))

                    compared[keep] += known.value.visit(q, lambda rows, best=best: np.arccos(np.clip(best[rows], -1, 1)), found)
                after = before.copy()
                after[keep] = best
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(after, mask=np.isnan(after)), pa.array(compared, pa.int64())], ["vec_id", "embedding", "best", "compared"])

        out = out.mapInArrow(run, out.schema)
    return out.select("vec_id", "best", "compared")


def similar(df: DataFrame, corpus: DataFrame, threshold: float, chunk: int | None = None) -> DataFrame:
    """vec_id, id, cosine: all pairs of df (vec_id, embedding) and corpus (id, embedding) with a cosine of threshold or more."""
    spark, schema, out = df.sparkSession, f"vec_id {dict(df.dtypes)['vec_id']}, id {dict(corpus.dtypes)['id']}, cosine double", None
    for cells in _chunks(corpus, chunk or CHUNK):
        known = spark.sparkContext.broadcast(cells)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            angle = np.arccos(np.clip(threshold, -1, 1))
            for batch in batches:
                q, keep = units(batch.column(1))
                if not len(keep) or q.shape[1] != known.value.pivots.shape[1]:
                    continue
                pairs: list[tuple[np.ndarray, ...]] = []

                def found(rows: np.ndarray, span: slice, cosines: np.ndarray, pairs=pairs) -> None:
                    a, b = np.nonzero(cosines >= threshold)
                    pairs.append((rows[a], span.start + b, cosines[a, b]))

                known.value.visit(q, lambda rows: np.full(len(rows), angle), found)
                a, b, x = (np.concatenate(p) for p in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep[a])), pa.array(known.value.ids[b]), pa.array(x)], ["vec_id", "id", "cosine"])

        part = df.select("vec_id", "embedding").mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)
