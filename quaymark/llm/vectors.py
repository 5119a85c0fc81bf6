"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

A sample of the vectors fits a mean, principal axes and rotations that bring the rotated axes nearest to their signs. All
vectors get sign bits, cut into substrings of as many bits as the number of vectors has, 16 at least, so that buckets don't
fill up as the table grows; longer substrings meet less often, so there are more of them (``tables``). Two vectors meet where
a substring differs in one bit at most (the one whose substring has the bit visits the other's bucket); those close enough
in the first 128 bits go on to have their cosine taken from the original vectors in double precision.

How often signs differ at the threshold depends on the vectors: where all share a mean direction, as text embeddings do, two
at a cosine of 0.9 are much further apart once the mean is off. So it is measured: vectors of the sample get partners at
the threshold itself, and substrings are added until ``RECALL`` of these pairs meet; the distance let past is one that all
but a thousandth of them keep.

Exact copies are one class. Classes that share 32 bits with one of smaller number and lie within 4 degrees of it are put
in a ball around it: all of a ball are linked to one another, and two balls are linked altogether if the angle of their
centres and both radii stay under the threshold's angle, so neither copies nor crowds of near copies are paired. Only where
that is undecided are the members of two balls compared.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or have another length than most
of the sample link with nothing; repeated rows count as vectors linked to each other; a null vec_id names no component
unless it is alone; an empty table gives no rows; other columns are not read. Pairs that share no bucket are missed:
recall is measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, table
from .components import components

SAMPLE, ROUNDS, SUBSTRING, TABLES, RADIUS, BALL = 20000, 30, 16, 8, 40, np.deg2rad(4.0)
#: Chance that a sign differs between vectors at the threshold, and share of pairs that meet in 8 tables of 16 bits.
FLIP, MET = 0.1436, 0.95
#: Share of made pairs at the threshold that must meet, how many are made, and substrings at most.
RECALL, PAIRS, MOST = 0.94, 2000, 1024
_CODE = "c0 long, c1 long"


def tables(count: int) -> tuple[int, int]:
    """Bits of a substring for so many vectors, and how many substrings keep the recall of 8 of 16 bits."""
    bits = min(48, max(SUBSTRING, int(count).bit_length()))
    meet = (1 - FLIP) ** bits + bits * FLIP * (1 - FLIP) ** (bits - 1)
    return bits, TABLES if bits == SUBSTRING else int(np.ceil(np.log(1 - MET) / np.log(1 - meet)))


class Quantiser:
    """A fitted mean, axes and rotations, at least ``count`` substrings and as many more as the pairs at ``threshold`` need;
    codes are two signed longs and the numbers of the buckets."""

    def __init__(self, sample: np.ndarray, substring: int = SUBSTRING, count: int = TABLES, rounds: int = ROUNDS, seed: int = 11, threshold: float | None = None):
        rng, self.substring, self.count = np.random.default_rng(seed), substring, count
        self.size = sample.shape[1]
        self.mean = sample.mean(0) if len(sample) else np.zeros(self.size)
        centred = sample - self.mean
        _, vectors = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(self.size))
        axes = vectors[:, ::-1][:, : min(64, self.size)]
        v, turned = centred @ axes, []

        def turn(rows: np.ndarray) -> None:
            r = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
            for _ in range(rounds):
                left, _, right = np.linalg.svd(np.sign(rows @ r).T @ rows)
                r = (left @ right).T
            turned.append(axes @ r)

        while sum(t.shape[1] for t in turned) < max(128, substring * count):
            turn(v)
        self.radius = RADIUS
        if threshold is not None and len(sample) and self.size > 1:
            a, b = _partners(sample[:: max(1, len(sample) // PAIRS)], threshold, np.random.default_rng(seed + 1))
            while True:
                self.project = np.hstack(turned)
                most = min(MOST, self.project.shape[1] // substring)
                x, y = ((z - self.mean) @ self.project > 0 for z in (a, b))
                off = (x[:, : most * substring] != y[:, : most * substring]).reshape(len(a), most, substring).sum(2)
                met = np.logical_or.accumulate(off <= 1, axis=1).mean(0)  # after so many substrings
                if met[-1] >= RECALL or most == MOST:
                    break
                turn(v[:4096])
            self.count = max(count, int(np.argmax(met >= RECALL)) + 1 if met[-1] >= RECALL else most)
            self.radius = max(RADIUS, int(np.quantile((x[:, :128] != y[:, :128]).sum(1), 0.999)) + 1)
        self.project = np.hstack(turned)[:, : max(128, substring * self.count)]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = (x - self.mean) @ self.project > 0
        own = bits[:, : self.substring * self.count].reshape(len(x), self.count, self.substring)
        buckets = own @ (1 << np.arange(self.substring, dtype=np.int64)) | np.arange(self.count, dtype=np.int64) << 48
        return np.packbits(bits[:, :128], axis=1, bitorder="little").view("<i8"), buckets


def _partners(base: np.ndarray, cosine: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """base, and for each of its unit vectors one at the cosine, in any direction."""
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(1)[:, None] * base
    other /= np.maximum(np.linalg.norm(other, axis=1)[:, None], 1e-12)
    return base, cosine * base + np.sqrt(1 - cosine**2) * other


def _list(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)


def _cosines(df: DataFrame, a: str, b: str, keep: str) -> DataFrame:
    """The keep columns (DDL, longs and doubles) with the cosine of unit vectors a and b."""
    names = [x.split()[0] for x in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            own = (x * y).reshape(batch.num_rows, -1).sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2, batch.num_columns)), pa.array(own)], names=[*names, "cos"])

    return df.select(a, b, *names).mapInArrow(run, f"{keep}, cos double")


def _unit(classes: DataFrame, quantiser: Quantiser) -> DataFrame:
    """cid, mult, unit vector and code of each class."""
    shared = classes.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = shared.value
            x = _list(batch.column(2), q.size)
            x /= np.abs(x).max(1)[:, None]
            x /= np.linalg.norm(x, axis=1)[:, None]
            c, buckets = q.code(x)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * q.count), pa.array(buckets.ravel()))
            unit = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * q.size), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), unit, pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), keys], names=["cid", "mult", "v", "c0", "c1", "keys"])

    return classes.select("cid", "mult", "embedding").mapInArrow(run, f"cid long, mult long, v array<double>, {_CODE}, keys array<long>")


def _balls(units: DataFrame) -> DataFrame:
    """(cid, ball, angle): each class's ball, named by the class at its centre."""
    quarters = F.array(*[F.struct(F.lit(i).alias("t"), F.shiftrightunsigned(F.col(f"c{i // 2}"), 32 * (i % 2)).bitwiseAND(F.lit((1 << 32) - 1)).alias("k")) for i in range(4)])
    keys = units.select("cid", F.explode(quarters).alias("x")).select("cid", "x.t", "x.k")
    pivots = keys.groupBy("t", "k").agg(F.min("cid").alias("p"), F.count("*").alias("n")).where("n > 1").select("t", "k", "p")
    tries = keys.join(pivots, ["t", "k"]).where("p < cid").select("cid", "p").distinct()
    both = tries.join(units.select("cid", F.col("v").alias("a")), "cid").join(units.select(F.col("cid").alias("p"), F.col("v").alias("b")), "p")
    near = _cosines(both, "a", "b", "cid long, p long").where(F.col("cos") >= float(np.cos(BALL)))
    best = near.groupBy("cid").agg(F.min(F.struct("p", "cos")).alias("x")).select("cid", F.col("x.p").alias("p"), F.acos(F.least(F.col("x.cos"), F.lit(1.0))).alias("angle"))
    return units.select("cid").join(best, "cid", "left").select("cid", F.coalesce("p", "cid").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle"))


def _rows(members: DataFrame, substring: int, count: int) -> DataFrame:
    """(key, home, ball, c0, c1): the buckets that each class lives in or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ball, c0, c1 = (batch.column(i).to_numpy() for i in range(3))
            parts = batch.column(3).flatten().to_numpy().reshape(len(ball), count)
            for t in range(count):
                k = parts[:, t]
                who, to = [np.arange(len(k))], [k]
                for b in range(substring):
                    has = np.flatnonzero(k >> b & 1)
                    who.append(has)
                    to.append(k[has] ^ (1 << b))
                row, home = np.concatenate(who), np.zeros(sum(map(len, who)), bool)
                home[: len(k)] = True
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), pa.array(home), pa.array(ball[row]), pa.array(c0[row]), pa.array(c1[row])], names=["key", "home", "ball", "c0", "c1"])

    return members.select("ball", "c0", "c1", "keys").mapInArrow(run, f"key long, home boolean, ball long, {_CODE}")


def link(vectors: DataFrame, threshold: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = cut(rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult")).withColumn("cid", F.monotonically_increasing_id()))
    count = classes.count()
    share = min(1.0, sample / max(count, 1))
    some = classes.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < share * (1 << 30)).select("embedding").toArrow()["embedding"].combine_chunks()  # about sample rows
    sizes = np.array([len(x) for x in some]) if len(some) else np.zeros(0, int)
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not len(sizes):
        return alone
    size = int(np.bincount(sizes).argmax())
    flat = np.array([x.as_py() for x, n in zip(some, sizes, strict=True) if n == size], float)
    flat /= np.abs(flat).max(1)[:, None]
    substring, tabled = tables(count)
    quantiser = Quantiser(flat / np.linalg.norm(flat, axis=1)[:, None], substring, tabled, threshold=threshold)
    tabled = quantiser.count
    units = cut(_unit(classes.where(F.size("embedding") == size), quantiser))
    members = cut(units.join(_balls(units), "cid"))
    balls = members.groupBy("ball").agg(F.sum("mult").alias("n"), F.max("angle").alias("r"))
    balls = cut(balls.join(units.select(F.col("cid").alias("ball"), "v"), "ball"))

    met = _rows(members, substring, tabled).groupBy("key", "home", "ball").agg(F.min(F.struct("c0", "c1")).alias("c"))
    met = met.select("key", "home", "ball", "c.c0", "c.c1")
    here, there = met.where("home").select("key", *[F.col(c).alias(f"h_{c}") for c in ("ball", "c0", "c1")]), met
    apart = F.bit_count(F.col("h_c0").bitwiseXOR(F.col("c0"))) + F.bit_count(F.col("h_c1").bitwiseXOR(F.col("c1")))
    pairs = here.join(there, "key").where(((F.col("h_ball") < F.col("ball")) | (~F.col("home") & (F.col("h_ball") != F.col("ball")))) & (apart <= quantiser.radius))
    pairs = pairs.select(F.least("h_ball", "ball").alias("a"), F.greatest("h_ball", "ball").alias("b")).distinct()
    side = lambda s: balls.select(F.col("ball").alias(s), F.col("v").alias(f"v{s}"), F.col("n").alias(f"n{s}"), F.col("r").alias(f"r{s}"))
    seen = _cosines(pairs.join(side("a"), "a").join(side("b"), "b"), "va", "vb", "a long, b long, na long, nb long, ra double, rb double")
    angle, most = F.acos(F.greatest(F.least(F.col("cos"), F.lit(1.0)), F.lit(-1.0))), float(np.arccos(threshold))
    single = (F.col("ra") == 0) & (F.col("rb") == 0)
    seen = cut(seen.withColumn("all", F.when(single, F.col("cos") >= threshold).otherwise(angle + F.col("ra") + F.col("rb") < most - 1e-7)).where(F.col("all") | (~single & (angle - F.col("ra") - F.col("rb") <= most + 1e-7))))
    whole = seen.where("all")
    of = lambda s: members.select(F.col("ball").alias(s), F.col("cid").alias(f"x{s}"), F.col("mult").alias(f"m{s}"), F.col("v").alias(f"v{s}"))
    some = _cosines(seen.where("not all").select("a", "b").join(of("a"), "a").join(of("b"), "b"), "va", "vb", "a long, b long, xa long, xb long, ma long, mb long").where(F.col("cos") >= threshold)
    some = cut(some.select("a", "b", "xa", "xb", "ma", "mb"))

    edges = whole.select("a", "b").unionAll(some.select("a", "b"))
    by_ball = whole.select(F.explode(F.array(F.struct(F.col("a").alias("ball"), F.col("nb").alias("k")), F.struct(F.col("b").alias("ball"), F.col("na").alias("k")))).alias("x")).select("x.*").groupBy("ball").agg(F.sum("k").alias("k"))
    by_class = some.select(F.explode(F.array(F.struct(F.col("xa").alias("cid"), F.col("mb").alias("j")), F.struct(F.col("xb").alias("cid"), F.col("ma").alias("j")))).alias("x")).select("x.*").groupBy("cid").agg(F.sum("j").alias("j"))
    roots = components(edges, "a", "b").select(F.col("node").alias("ball"), "root")
    own = members.select("cid", "ball").join(balls.select("ball", "n"), "ball").join(by_ball, "ball", "left").join(roots, "ball", "left").join(by_class, "cid", "left")
    own = own.join(classes.select("cid", "embedding", "least"), "cid").select("embedding", "least", F.coalesce("root", "ball").alias("root"), (F.col("n") - 1 + F.coalesce("k", F.lit(0)) + F.coalesce("j", F.lit(0))).alias("n_links"))
    own = cut(own)
    named = own.join(own.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("embedding", "n_links", "component_id")
    linked = rows.where(sound).join(named, "embedding", "left")
    out = linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).unionAll(rows.where(~sound).select("vec_id", F.lit(0).cast("long"), "vec_id", F.lit(True)))


def query(spark, sf_dir):
    return link(table(spark, sf_dir, "embeddings"))
