"""Language identification by partial matching: per-language byte context trees of variable order.

A tree of order ``order`` holds, for each language, how often each byte followed each context of 0 to ``order`` bytes in
all training texts. A byte costs -log2 of c/(n+q) at the longest context that has it, where n counts the context, q
its different followers and c this one; each context passed over costs -log2 of q/(n+q) (escape method C), unseen contexts
cost nothing, and a byte that no context has costs 8 bits more. Statistics are frozen and symbols aren't excluded, so a
text's exact code length is a sum over its byte grams. The language with the least code length wins.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is all when nothing could be
learnt; long texts are scored whole; ties go to the first language by name; repeated rows each get a row; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, ship, table, text_view

ORDER = 3
#: Counts of a language's grams that a task holds before it merges them, and twice those that it holds after.
HELD = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def grams(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` before it in its text, zeros before its start, as one integer."""
    kind = np.uint32 if order <= 3 else np.uint64
    out, n = data.astype(kind), len(data)
    starts = off[:-1][np.diff(off) > 0]
    for k in range(1, order + 1):
        back = np.zeros(n, kind)
        back[k:] = data[: n - k] if k < n else 0
        for j in range(k):  # these would reach into the text before
            at = starts + j
            back[at[at < np.minimum(n, _ends(off, starts))]] = 0
        out |= back << kind(8 * k)
    return out


def _ends(off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return off[np.searchsorted(off, starts, "right")]


class ContextTree:
    """Frozen statistics of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        """keys, counts: the (order + 1)-byte grams; those of lower orders are their sums."""
        self.levels = []
        keys, counts = keys.astype(np.uint64), counts.astype(float)
        for k in range(order, -1, -1):
            keys, at = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.bincount(at, counts, minlength=len(keys))
            context, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(of, counts), np.bincount(of)
            self.levels.append((keys, np.log2((total + kinds)[of] / counts), context, np.log2((total + kinds) / kinds)))
        self.order = order

    def cost(self, seen: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after the others."""
        seen, bits = seen.astype(np.uint64), np.zeros(len(seen))
        left = np.arange(len(seen))
        for k, (keys, own, contexts, escape) in zip(range(self.order, -1, -1), self.levels, strict=True):
            if not len(keys) or not len(left):
                continue
            key = seen[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            bits[left[hit]] += own[at[hit]]
            left, key = left[~hit], key[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(contexts, key), len(contexts) - 1)
            known = contexts[at] == key
            bits[left[known]] += escape[at[known]]
        bits[left] += 8
        return bits


class Languages:
    def __init__(self, trees: dict[str, ContextTree], order: int):
        self.names, self.order = sorted(trees), order
        self.trees = [trees[x] for x in self.names]

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, languages) code lengths in bits."""
        out = np.zeros((len(off) - 1, len(self.names)))
        some = np.flatnonzero(np.diff(off))
        if len(some):
            codes, seen = pd.factorize(grams(data, off, self.order))
            for j, tree in enumerate(self.trees):
                out[some, j] = np.add.reduceat(tree.cost(seen)[codes], off[some])
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Each text's language and the share it would have if code lengths were log-likelihoods."""
        data, off = text_view(column)
        if not self.names:
            return ["und"] * len(column), np.zeros(len(column))
        bits = self.lengths(data, off)
        best = bits.argmin(1)
        with np.errstate(under="ignore"):
            share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
        ascii_at = np.concatenate([[0], np.cumsum(_ASCII[data])])
        letters = ascii_at[off[1:]] > ascii_at[off[:-1]]
        for i in np.flatnonzero(~letters).tolist():
            letters[i] = bool(_LETTER.search(column[i].as_py() or ""))
        return [self.names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, share, 0.0)


def fit(docs: DataFrame, order: int = ORDER) -> Languages:
    """Trees from all rows of each non-null lang."""
    ship(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def out(lang: str, own: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, n = _merged(own)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for chunk in chunks(batches, 1):
            lang = np.array(chunk.column(0).to_pylist(), object)
            for own in sorted(set(lang.tolist())):
                data, off = text_view(chunk.column(1).filter(pa.array(lang == own)))
                found.setdefault(own, []).append(np.unique(grams(data, off, order), return_counts=True))
                if sum(len(k) for k, _ in found[own]) > HELD:
                    found[own] = [_merged(found[own])]
                    if len(found[own][0][0]) > HELD // 2:
                        yield out(own, found.pop(own))
        for own in sorted(found):
            yield out(own, found[own])

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got, trees = counts.toArrow(), {}  # at most the kinds of (order + 1)-byte runs
    for lang in pc.unique(got["lang"]).to_pylist():
        own = got.filter(pc.equal(got["lang"], lang))
        trees[lang] = ContextTree(own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy(), order)
    return Languages(trees, order)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.concatenate([n for _, n in found]))
    return keys, n


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 1):
            lang, share = shared.value.predict(chunk.column(1))
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(lang, pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = fold(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~out))
    return identify(docs, model).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")
