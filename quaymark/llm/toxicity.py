"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of ASCII letters and digits and of other bytes from 0x80, A-Z lower-cased) are embedded as the sum of hashed
vectors of the word and of its first 4, 5 and 6 bytes. Filters of widths 1, 2 and 3 slide over the whole text, zeros
standing after its end, are rectified and max-pooled; a logistic unit reads the pools. Training starts at random, with
filters that all speak for toxicity, and goes over every labelled row: rows are dealt into shards, each shard descends with
Adam from the nets that all share, and what the shards have changed is averaged before the next turn. For each language,
found in the text by partial matching, the threshold that separates all labelled rows best is moved to 0.3; for that each
row is scored by a net that has not learnt from its fold, and scores are counted by ``BINS`` bins.

Defined results: null, empty and wordless texts pool to zero and get the score of the bias; long texts are read whole; a
document with several label rows learns from each, with a null label from none; repeated rows each get a row; with one
class, or none, to learn from, the score is that class, or 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language
from .bitmap import BitMap
from .common import SpanHash, chunks, cut, fold, lower_table, ship, table, text_view, word_spans

THRESHOLD = 0.3
#: Folds of calibration; labelled rows of a shard; turns over all rows, and how many steps a small table gets at least.
FOLDS, SHARD, TURNS, STEPS, RATE = 2, 4096, 4, 600, 0.006
#: Shards that a task trains on at most, if a task a core makes it more.
RUN = 16
#: Bins of raw scores among which thresholds are chosen; what a parameter's moves are multiplied by before they are summed.
BINS, SCALE = 1 << 16, 1 << 16
BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 16, 8, 8, (1, 2, 3), (4, 5, 6)
_LOWER = lower_table()
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct word's buckets; which distinct word each word is; the document of each word."""
    data, off = text_view(column)
    data = _LOWER[data]
    start, end, doc = word_spans(data, off, _WORD)
    if not len(start):
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), np.zeros(0, np.int64), doc
    span = SpanHash(data)
    codes, seen = pd.factorize(span(start, end))
    first = np.empty(len(seen), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    s, e = start[first], end[first]
    kinds = [seen, *(span(s, np.minimum(s + k, e)) + np.uint64(k) for k in PREFIXES)]
    return np.column_stack([x % np.uint64(BUCKETS) for x in kinds]).astype(np.int64), codes, doc


#: Each document's distinct words' buckets, and which of these each word is.
Tokens = list[tuple[np.ndarray, np.ndarray]]


def joined(parts: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``tokens`` gives, of some documents."""
    base = np.cumsum([0, *(len(ids) for ids, _ in parts)])
    codes = np.concatenate([codes.astype(np.int64) + b for (_, codes), b in zip(parts, base, strict=False)])
    return np.concatenate([ids for ids, _ in parts]).astype(np.int64), codes, np.repeat(np.arange(len(parts)), [len(c) for _, c in parts])


class Net:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"E": rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), "out": np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32), "bias": np.full(1, -2, np.float32)}
        for w in WIDTHS:
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
            for k in range(w):
                self.p[f"W{w}{k}"] = rng.normal(0, 0.3, (DIM, FILTERS)).astype(np.float32)
        self.cut: dict[str, float] = {}
        self.constant: float | None = None

    def pool(self, ids: np.ndarray, codes: np.ndarray, doc: np.ndarray, n: int, where: bool = False):
        """(n, filters) pools, and with where each pool's word position, -1 if rectified away."""
        pools, at = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), np.full((n, FILTERS * len(WIDTHS)), -1)
        if not len(codes):
            return pools, at
        e = sum(self.p["E"][ids[:, k]] for k in range(ids.shape[1]))
        some, starts = np.unique(doc, return_index=True)
        each = (e @ np.hstack([self.p[f"W{w}{k}"] for w in WIDTHS for k in range(w)]))[codes]
        act, col = np.empty((len(codes), pools.shape[1]), each.dtype), 0
        for j, w in enumerate(WIDTHS):
            own = act[:, j * FILTERS : (j + 1) * FILTERS]
            for k in range(w):
                if not k:
                    own[:] = each[:, col : col + FILTERS]
                else:
                    own[:-k] += each[k:, col : col + FILTERS] * (doc[k:] == doc[:-k])[:, None]
                col += FILTERS
        bias = np.concatenate([self.p[f"b{w}"] for w in WIDTHS])
        if where:
            for d, lo, hi in zip(some.tolist(), starts.tolist(), [*starts[1:].tolist(), len(doc)], strict=True):
                at[d] = lo + act[lo:hi].argmax(0)
            top = act[at[some], np.arange(act.shape[1])]
        else:
            top = np.maximum.reduceat(act, starts, axis=0)
        pools[some] = np.maximum(top + bias, 0)
        at[pools <= 0] = -1
        return pools, at

    def raw(self, column: pa.Array) -> np.ndarray:
        return self.scores(*tokens(column), len(column))

    def scores(self, ids: np.ndarray, codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        pools, _ = self.pool(ids, codes, doc, n)
        return 1 / (1 + np.exp(-np.clip(pools.astype(float) @ self.p["out"] + self.p["bias"], -60, 60)))

    def gradients(self, ids: np.ndarray, codes: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of the weighed mean log-loss of some documents: for each parameter, and for the embeddings the rows touched and theirs."""
        n = len(y)
        pools, at = self.pool(ids, codes, doc, n, where=True)
        p = 1 / (1 + np.exp(-np.clip(pools @ self.p["out"] + self.p["bias"], -60, 60)))
        err = ((p - y) * weight / n).astype(self.p["out"].dtype)
        grads = {"out": pools.T @ err, "bias": np.array([err.sum()], err.dtype)}
        back = err[:, None] * self.p["out"] * (at >= 0)
        touched, parts = [], []
        for j, w in enumerate(WIDTHS):
            own = slice(j * FILTERS, (j + 1) * FILTERS)
            g, pos = back[:, own], at[:, own]
            grads[f"b{w}"] = g.sum(0)
            for k in range(w):
                to = np.clip(pos + k, 0, max(len(doc) - 1, 0))
                live = g * ((pos >= 0) & (pos + k < len(doc)) & (doc[to] == np.arange(n)[:, None])) if len(doc) else g * 0
                b = ids[codes[to]] if len(doc) else np.zeros((*to.shape, 1), int)
                e = self.p["E"][b].sum(2)
                grads[f"W{w}{k}"] = np.einsum("bfd,bf->df", e, live)
                touched.append(b.reshape(-1, b.shape[-1]))
                parts.append((live[:, :, None] * self.p[f"W{w}{k}"].T[None]).reshape(-1, DIM))
        flat = np.concatenate(touched)
        rows, to = np.unique(flat, return_inverse=True)
        ge = np.zeros((len(rows), DIM), self.p["E"].dtype)
        np.add.at(ge, to.reshape(flat.shape), np.concatenate(parts)[:, None, :])
        return grads, rows, ge

    def train(self, parts: Tokens, y: np.ndarray, weight: np.ndarray, epochs: int, batch: int, seed: list[int], rate: float = RATE) -> None:
        """Adam from zero moments over the rows of one shard."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                rows = order[lo : lo + batch]
                grads, rows_e, ge = self.gradients(*joined([parts[r] for r in rows]), y[rows], weight[rows])
                grads["out"] = grads["out"] + 1e-4 * self.p["out"]
                step += 1
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= (rate * fix * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(np.float32)
                m["E"][rows_e] += 0.1 * (ge - m["E"][rows_e])  # moments of rows that a batch doesn't touch stand still
                v["E"][rows_e] += 0.001 * (ge * ge - v["E"][rows_e])
                self.p["E"][rows_e] -= rate * fix * m["E"][rows_e] / (np.sqrt(v["E"][rows_e]) + 1e-7)

    def blocks(self) -> np.ndarray:
        """All parameters in rows of DIM: the embeddings, then the others in the order of their names, zeros last."""
        rest = np.concatenate([self.p[k].ravel() for k in sorted(self.p) if k != "E"])
        return np.concatenate([self.p["E"], np.append(rest, np.zeros(-len(rest) % DIM, np.float32)).reshape(-1, DIM)])

    def moved(self, blocks: np.ndarray) -> Net:
        """A net with these parameters."""
        out, at, rest = Net(), 0, blocks[BUCKETS:].ravel()
        out.p["E"] = blocks[:BUCKETS].astype(np.float32)
        for k in sorted(self.p):
            if k != "E":
                out.p[k] = rest[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
                at += self.p[k].size
        return out

    def calibrate(self, bins: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], least: int = 10) -> None:
        """A threshold for every language with ``least`` rows of either class, and one for all others. bins: by language the
        occupied bins of raw scores, their rows and how many of those are toxic."""
        both = [np.concatenate(x) for x in zip(*bins.values(), strict=True)]
        place, at = np.unique(both[0], return_inverse=True)
        self.cut = {"": _threshold(place, *(np.bincount(at, x, minlength=len(place)) for x in both[1:]))}
        for name, (place, n, hit) in bins.items():
            if min(hit.sum(), (n - hit).sum()) >= least:
                self.cut[name] = _threshold(place, n, hit)

    def calibrated(self, raw: np.ndarray, lang: list[str]) -> np.ndarray:
        t = np.array([self.cut.get(x, self.cut[""]) for x in lang])
        low, high = THRESHOLD * raw / t, THRESHOLD + (1 - THRESHOLD) * (raw - t) / (1 - t)
        return np.clip(np.where(raw < t, low, high), 0, 1)


def _threshold(place: np.ndarray, n: np.ndarray, hit: np.ndarray) -> float:
    """The middle of the gap between bins with the greatest F1; of equal ones the widest."""
    order = np.argsort(-place)
    place, n, hit = place[order], np.cumsum(n[order]), np.cumsum(hit[order])
    f1 = 2 * hit / (n + max(hit[-1], 1))
    low, high = (np.append(place[1:], -1) + 1) / BINS, place / BINS
    best = max(range(len(place)), key=lambda i: (round(f1[i], 9), high[i] - low[i]))
    return float(np.clip((low[best] + high[best]) / 2, 1e-4, 1 - 1e-4))


def shards(docs: DataFrame, truth: DataFrame, languages: language.Languages, n: int) -> DataFrame:
    """(shard, doc_id, y, fold, lang, words) of every row of docs for each of its labels, tokenised, packed and written once; a
    shard has some SHARD of ``n`` rows, a document's rows together. A bit map keeps most rows without a label out of the
    shuffle; it moves packed texts, which take half the room of their words, and the join finds both sides dealt already."""
    count = max(1, -(-n // SHARD))
    known = BitMap(truth, F.xxhash64("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 0):
            chunk = chunk.filter(pa.array(known(chunk.column(2).to_numpy())))
            data, off = text_view(chunk.column(0))
            text = [zlib.compress(data[lo:hi].tobytes(), 1) for lo, hi in pairwise(off.tolist())]
            yield pa.RecordBatch.from_arrays([chunk.column(1), pa.array(text, pa.binary())], names=["doc_id", "text"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                own = batch.slice(lo, 64)
                text = pa.array([zlib.decompress(x) for x in own["text"].to_pylist()], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([text, own["shard"], own["doc_id"], own["y"]], names=["text", "shard", "doc_id", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(unpacked(batches), 0):
            text, words = chunk.column(0), []
            for i in range(len(text)):
                ids, codes, _ = tokens(text.slice(i, 1))
                codes = codes.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
                words.append(zlib.compress(np.array([len(ids)], np.int64).tobytes() + ids.astype(np.uint16).tobytes() + codes.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*chunk.columns[1:], pa.array(shared.value.predict(text)[0], pa.string()), pa.array(words, pa.binary())], names=["shard", "doc_id", "y", "lang", "words"])

    part = lambda name, n: F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(n)).cast("int")
    dealt = lambda df: df.withColumn("shard", part("shard", count)).repartitionById(count, "shard")
    some = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).withColumn("h", F.xxhash64("doc_id"))
    found = dealt(some.mapInArrow(pack, "doc_id long, text binary")).join(dealt(truth), ["shard", "doc_id"]).select("shard", "doc_id", "y", "text")
    rows = found.mapInArrow(run, "shard int, doc_id long, y int, lang string, words binary").withColumn("fold", part("part", FOLDS))
    return cut(rows.sortWithinPartitions("shard", "doc_id", "y", "words"))  # keeps the partitions


def _read(batches: list[pa.RecordBatch]) -> tuple[Tokens, pa.Table]:
    """Each row's buckets and words, and all other columns."""
    got, parts = pa.Table.from_batches(batches), []
    for words in got["words"].to_pylist():
        raw = zlib.decompress(words)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        to = 8 + 2 * n * (1 + len(PREFIXES))
        parts.append((np.frombuffer(raw[8:to], np.uint16).reshape(n, 1 + len(PREFIXES)), np.frombuffer(raw[to:], np.uint16 if n <= 1 << 16 else np.uint32)))
    return parts, got.drop_columns(["words"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tokens, pa.Table]]:
    """``_read`` of one shard after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch["shard"].to_numpy()
        for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else []):
            if held and held[-1]["shard"][0].as_py() != shard[lo]:
                yield _read(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield _read(held)


def advance(rows: DataFrame, nets: dict[int, Net], turn: int, epochs: int, batch: int, share: float, tasks: int) -> dict[int, Net]:
    """The nets after one more turn: each shard trains each net on its own rows but those of the net's fold, and the parameters
    that a shard has used move by the mean, weighed by rows, of how far its users moved them. Sums are of whole numbers, so
    their order changes nothing; a task adds up those of all its shards, so what is shuffled grows with ``tasks`` only."""
    shared = rows.sparkSession.sparkContext.broadcast({k: net.blocks() for k, net in nets.items()})
    kind = Net()
    names = [f"d{j}" for j in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        users = {k: np.zeros(len(old), np.int64) for k, old in shared.value.items()}
        moves = {k: np.zeros(old.shape, np.int64) for k, old in shared.value.items()}
        for parts, cols in _whole(batches):
            y, fold_of, first = cols["y"].to_numpy().astype(np.float32), cols["fold"].to_numpy(), int(cols["doc_id"][0].as_py()) % (1 << 32)
            for k, old in shared.value.items():
                own = np.flatnonzero(fold_of != k)
                if not len(own):
                    continue
                net = kind.moved(old)
                net.train([parts[i] for i in own], y[own], np.where(y[own] == 1, 0.5 / share, 0.5 / (1 - share)), epochs, batch, [turn, k, first])
                used = np.zeros(len(old), bool)
                used[BUCKETS:] = True
                for i in own:
                    used[parts[i][0].ravel()] = True
                users[k][used] += len(own)
                moves[k][used] += np.rint((net.blocks()[used].astype(float) - old[used]) * len(own) * SCALE).astype(np.int64)
        for k, n in users.items():
            at = np.flatnonzero(n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n[at]), *(pa.array(moves[k][at, j]) for j in range(DIM))], names=["net", "block", "n", *names])

    moves = rows.coalesce(tasks).mapInArrow(run, "net int, block int, n long, " + ", ".join(f"{c} long" for c in names))
    got = moves.groupBy("net", "block").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).toArrow()  # at most all nets' parameters
    out, net_of, at, n = {}, got["net"].to_numpy(), got["block"].to_numpy(), got["n"].to_numpy()
    move = np.column_stack([got[c].to_numpy() for c in names]) / SCALE / n[:, None]
    for k, net in nets.items():
        blocks, own = net.blocks().astype(float), net_of == k
        blocks[at[own]] += move[own]
        out[k] = net.moved(blocks)
    shared.unpersist()
    return out


def fit(docs: DataFrame, labels: DataFrame, languages: language.Languages, label: str = "toxic") -> Net:
    """Learns from every labelled row of docs; thresholds come from all of them too, each scored by the net that has not
    learnt from its fold."""
    ship(docs.sparkSession)
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(truth, "doc_id")
    counts = {r["y"]: r["n"] for r in each.groupBy("y").agg(F.count("*").alias("n")).collect()}
    net, n = Net(), sum(counts.values())
    if len(counts) < 2:
        net.constant = float(next(iter(counts), 0))
        return net
    rows = shards(docs, truth, languages, n)
    seen = {(r["fold"], r["y"]) for r in rows.select("fold", "y").distinct().collect()}
    apart = [k for k in range(FOLDS) if {y for f, y in seen if f != k} == {0, 1} and any(f == k for f, _ in seen)]
    nets = {k: net for k in [*apart, FOLDS]}
    batch = min(64, max(16, n // 8))
    epochs = max(TURNS, -(-STEPS * batch // n))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // (RUN * SHARD)))
    for turn in range(TURNS):
        gc.collect()  # Python's dead frames hold the driver's
        docs.sparkSession.sparkContext._jvm.System.gc()  # shuffles that nothing refers to any more go
        nets = advance(rows, nets, turn, -(-epochs // TURNS), batch, counts[1] / n, tasks)
    net = nets[FOLDS]
    shared = docs.sparkSession.sparkContext.broadcast(nets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                parts, cols = _read([batch.slice(lo, 64)])
                fold_of, place = cols["fold"].to_numpy(), np.full(len(parts), -1)
                for k in set(fold_of.tolist()):
                    if k in shared.value or not apart:  # too few rows to hold any back
                        own = np.flatnonzero(fold_of == k)
                        raw = shared.value[k if apart else FOLDS].scores(*joined([parts[i] for i in own]), len(own))
                        place[own] = np.minimum(raw * BINS, BINS - 1)
                yield pa.RecordBatch.from_arrays([cols["lang"].combine_chunks(), pa.array(place), pa.array(cols["y"].to_numpy())], names=["lang", "place", "y"])

    scored = rows.mapInArrow(run, "lang string, place long, y int").where("place >= 0").groupBy("lang", "place").agg(F.count("*").alias("n"), F.sum("y").alias("hit"))
    bins = {str(k): (x["place"].to_numpy(), x["n"].to_numpy(), x["hit"].to_numpy()) for k, x in scored.toArrow().to_pandas().sort_values(["lang", "place"]).groupby("lang")}  # at most BINS a language
    net.calibrate(bins)
    return net


def score(docs: DataFrame, net: Net, languages: language.Languages) -> DataFrame:
    """(doc_id, score) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((net, languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = shared.value
        for chunk in chunks(batches, 1):
            text = chunk.column(1)
            value = np.full(len(text), own.constant) if own.constant is not None else own.calibrated(own.raw(text), names.predict(text)[0])
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(value, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = fold(F.col("doc_id"), 4) == 2
    known = docs.where(~out)
    languages = language.fit(known)
    net = fit(known, labels, languages)
    return score(docs, net, languages).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
