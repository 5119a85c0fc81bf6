"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text gives a vector of statistics (shares of byte classes, word and line repetition, lengths), moved to a
log scale. Class means and covariances come from sums over every labelled training row; a covariance is shrunk towards the
pooled one and then towards its own diagonal. The score is the logistic of the difference of the classes' log densities,
each from a Mahalanobis distance under a Cholesky factor computed once.

Defined results: null and empty texts have all statistics zero and are scored like any other; long texts count whole; a
document with several label rows learns from each, with a null label from none; repeated rows each get a row; with only
one class, or none, known the score is that class, or 0.5; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, fold, ship, table, text_view, token_hashes

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASSES = {
    "lower": range(97, 123), "upper": [*range(65, 91)], "high": range(128, 256), "high_upper": range(0x80, 0x9F), "digit": range(48, 58), "stop": b".,;:?", "shout": b"!", "bar": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "quote": b"\"'()-", "space": b" \t\r", "line": b"\n",
}
_MATRIX = np.zeros((256, len(_CLASSES)))
for _k, _v in enumerate(_CLASSES.values()):
    _MATRIX[list(_v), _k] = 1
NAMES = [*_CLASSES, "size", "entropy", "word_mean", "word_sd", "word_long", "word_short", "word_repeat", "word_top", "line_repeat", "line_mean", "capital", "mixed"]


def _per(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=n).astype(float)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, len(NAMES)) transformed statistics of the texts that off cuts data into."""
    n, size = len(off) - 1, np.diff(off)
    of_byte = np.repeat(np.arange(n, dtype=np.int64), size)
    hist = np.bincount(of_byte * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    share = hist @ _MATRIX / (size + 50.0)[:, None]  # what is added to a divisor keeps short texts near zero
    p = hist / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    start, end, doc, h = token_hashes(data, off, ~_SPACE)
    length = (end - start).astype(float)
    words = np.maximum(_per(doc, n), 1)
    mean = _per(doc, n, length) / words
    sd = np.sqrt(np.maximum(_per(doc, n, length**2) / words - mean**2, 0))
    more = words + 20
    long, short = _per(doc, n, length > 15) / more, _per(doc, n, length <= 2) / more
    first = data[start] if len(start) else np.zeros(0, np.uint8)
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    capital = _per(doc, n, (first >= 65) & (first <= 90)) / more
    mixed = _per(doc, n, ~(((last >= 97) & (last <= 122)) | (last >= 128) | ((last >= 65) & (last <= 90)) | ((last >= 48) & (last <= 57)))) / more
    repeat, top = np.zeros(n), np.zeros(n)
    if len(h):
        order = np.lexsort((h, doc))
        d, x = doc[order], h[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])
        runs = np.diff(np.append(np.flatnonzero(new), len(x)))
        repeat = 1 - np.log1p(_per(d[new], n)) / np.log1p(words)
        np.maximum.at(top, d[new], runs)
    ls, le, ldoc, lh = token_hashes(data, off, np.arange(256) != 10)
    lines = np.maximum(_per(ldoc, n), 1)
    line_repeat = np.zeros(n)
    if len(lh):
        order = np.lexsort((lh, ldoc))
        d, x = ldoc[order], lh[order]
        again = np.concatenate([[False], (d[1:] == d[:-1]) & (x[1:] == x[:-1])])
        line_repeat = _per(d, n, again) / (lines + 4)
    line_mean = _per(ldoc, n, (le - ls).astype(float)) / lines
    ratio = np.column_stack([share, long, short, repeat, top / more, line_repeat, capital, mixed])
    ratio = np.log1p(50 * np.maximum(ratio, 0))
    k = len(_CLASSES)
    rest = np.column_stack([np.log1p(size), entropy, np.log1p(mean), np.log1p(sd)])
    return np.column_stack([ratio[:, :k], rest, ratio[:, k : k + 5], np.log1p(line_mean), ratio[:, k + 5 :]])


def featurise(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 1):
            x = statistics(*text_view(chunk.column(1))).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([chunk.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), len(NAMES))


class Quadratic:
    """Two Gaussian classes. pooled and diagonal are the shares of the shrinkage targets; floor is added to variances."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.6, diagonal: float = 0.3, floor: float = 1e-2):
        self.known = sorted(c for c, m in moments.items() if m[0] >= 2)
        self.parts = {}
        count = sum(moments[c][0] for c in self.known)
        cov = {c: moments[c][2] / moments[c][0] - np.outer(m := moments[c][1] / moments[c][0], m) for c in self.known}
        both = sum((moments[c][0] * cov[c] for c in self.known), np.zeros((len(NAMES),) * 2)) / max(count, 1)
        for c in self.known:
            n, s, _ = moments[c]
            lam = pooled + (1 - pooled) * len(NAMES) / (len(NAMES) + n)  # small classes lean on the pooled covariance
            own = (1 - lam) * cov[c] + lam * both
            own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + floor * np.eye(len(NAMES))
            root = np.linalg.cholesky(own)
            self.parts[c] = (s / n, np.linalg.inv(root), np.log(np.diag(root)).sum() - np.log(n / count))

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.known) < 2:
            return np.full(len(x), float(self.known[0]) if self.known else 0.5)
        density = []
        for c in self.known:
            mean, inverse, constant = self.parts[c]
            density.append(-0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) - constant)
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))


def fit(features: DataFrame, labels: DataFrame, label: str = "quality") -> Quadratic:
    """Learns from every row of features whose doc_id has a label of 0 or 1."""
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1]), pa.int32()), pa.array(np.tile(np.arange(total.shape[1]), 2), pa.int32()), pa.array(total.ravel())], names=["y", "i", "v"])

    sums = features.join(truth, "doc_id").select("y", "x").mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    table = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():  # 2 (1 + d + d d) numbers, whatever the input
        table[r["y"], r["i"]] = r["v"]
    return Quadratic({c: (t[0], t[1 : 1 + d], t[1 + d :].reshape(d, d)) for c, t in enumerate(table) if t[0]})


def score(features: DataFrame, model: Quadratic) -> DataFrame:
    """features with score (double) in place of x."""
    shared, names = features.sparkSession.sparkContext.broadcast(model), [c for c in features.columns if c != "x"]
    at = features.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(shared.value.score(_matrix(batch.column(at))))], names=[*names, "score"])

    return features.mapInArrow(run, features.drop("x").withColumn("score", F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted; learnt from labelled rows that are not held out."""
    features = cut(featurise(docs).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))))
    model = fit(features.where("not held_out"), labels)
    return score(features, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that a model fitted on all labelled ones scores 0.5 or more; columns as they are."""
    model = fit(featurise(docs), labels)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, at):
            x = statistics(*text_view(chunk.column(at))).astype(np.float32).astype(float)
            yield chunk.filter(pa.array(shared.value.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
