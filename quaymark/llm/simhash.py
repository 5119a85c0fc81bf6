"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distance.

Texts are lower-cased (A-Z) and split on ``[\\x20\\x09-\\x0D]+``; each run of ``shingle`` words, space-joined, is hashed
by XXH64 (seed 42). A fingerprint bit is set where over half the hashes have it. Fingerprints are cut into ``blocks``
blocks: two at distance at most ``distance`` agree on some ``blocks - distance`` of them, so one table per choice finds
every such pair.

Defined results: a text with fewer words is one shingle; null, empty and wordless texts have fingerprint zero and link
like any other; long texts are hashed whole; equal fingerprints collapse to one node before any join; repeated rows each
keep their row; a null doc_id never names a component unless the component has no other; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, ship, table, text_view
from .components import components

#: A block group of more fingerprints is linked through shared midpoints instead of pairs; both ways are exact.
CROWD = 48


def _hashes(raw: bytes, shingle: int) -> list[int]:
    words = raw.lower().split()
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [h(b" ".join(words), 42)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    return [h(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each row's whole text, as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 1, 1 << 20):
            data, off = text_view(chunk.column(1))
            raw, flat, sizes = data.tobytes(), [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                got = _hashes(raw[a:b], shingle)
                flat += got
                sizes.append(len(got))
            size = np.array(sizes, np.int64)
            fp = np.zeros(len(size), np.uint64)
            some = size > 0
            if some.any():
                bits = np.unpackbits(np.array(flat, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                start = (np.cumsum(size) - size)[some]
                over = np.add.reduceat(bits, start, axis=0, dtype=np.int32) * 2 > size[some][:, None]
                fp[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    one = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(one, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, distance: int = 2, blocks: int = 5, crowd: int = CROWD) -> DataFrame:
    """(u, v) edges among distinct fingerprints ``fp`` whose components are those of all pairs within ``distance``.

    Groups of at most ``crowd`` fingerprints on a block key are paired and verified. In larger groups, which agree on
    the key's bits, two fingerprints are within 2 exactly if they share one that differs from each by at most one free bit;
    at most 65 share one, so such groups are linked without pairs. That way needs distance 2; for any other distance all
    groups are paired.
    """
    masks = _masks(blocks, distance)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k")
    groups = rows.groupBy("t", "k").agg(F.count("*").alias("c")).where("c > 1")
    rows = cut(rows.join(groups, ["t", "k"]))
    few = rows.where(F.col("c") <= crowd) if distance == 2 else rows
    a, b = few.select("t", "k", F.col("fp").alias("u")), few.select("t", "k", F.col("fp").alias("v"))
    near = a.join(b, ["t", "k"]).where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select("u", "v")
    if distance != 2:
        return near.distinct()
    free = [[_signed(1 << i) for i in range(64) if not m >> i & 1] for m in masks]
    flips = F.element_at(F.array(*[F.array(*[F.lit(x) for x in [0, *f]]) for f in free]), F.col("t") + 1)
    mids = rows.where(F.col("c") > crowd).select("fp", F.explode(flips).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("m")).distinct()
    stars = mids.groupBy("m").agg(F.collect_set("fp").alias("f"), F.min("fp").alias("v")).where(F.size("f") > 1)
    return near.unionAll(stars.select(F.explode("f").alias("u"), "v").where("u != v")).distinct()


def group(docs: DataFrame, shingle: int = 3, distance: int = 2, blocks: int = 5) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (smallest doc_id of its component)."""
    prints = cut(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), distance, blocks))
    named = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "least", "root")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = named.join(best, "root").select("fp", "component_id")
    of = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir):
    return group(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
