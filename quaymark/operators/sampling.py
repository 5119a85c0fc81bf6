"""Time repair, windows, splits, folds, oversampling and replays that give exact, repeatable counts.

Ranks within a key come from counts per range of the order and ranks inside a range, so no task sorts a whole class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ACCURACY, bucketed

#: Ranges of the order, unless the session has more partitions.
BUCKETS = 64


def ranked(df: DataFrame, order: str, *keys: str, name: str = "rank", unique: str | None = None) -> DataFrame:
    """df with the 0-based rank of each row among those of its keys by (order, unique)."""
    tie = [order, *([unique] if unique else [])]
    parts = max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)])).first()[0] or []  # so many numbers
    part = bucketed(df, order, cuts, "rk_part")
    sizes = part.groupBy(*keys, "rk_part").agg(F.count("*").alias("rk_n"))
    before = sizes.select(*keys, "rk_part", (F.sum("rk_n").over(Window.partitionBy(*keys).orderBy("rk_part")) - F.col("rk_n")).alias("rk_base"))
    inner = part.withColumn("rk_in", F.row_number().over(Window.partitionBy(*keys, "rk_part").orderBy(*tie)) - 1)
    return inner.join(F.broadcast(before) if not keys else before, [*keys, "rk_part"]).select(*df.columns, (F.col("rk_base") + F.col("rk_in")).alias(name))


def repair_timestamps(df: DataFrame, ts: str, order: str, start: str, end: str) -> DataFrame:
    """Missing times become evenly spaced instants of the window, in row order."""
    lost = ranked(df.where(F.col(ts).isNull()), order, name="rt_k")
    m = lost.count()
    a, b = (F.unix_micros(F.lit(x).cast("timestamp")) for x in (start, end))
    at = F.timestamp_micros((a + F.floor((b - a) * F.col("rt_k") / max(m - 1, 1))).cast("long"))
    return df.where(F.col(ts).isNotNull()).unionByName(lost.withColumn(ts, at).drop("rt_k"))


def in_window(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows within a window, both ends included."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def split_by_time(df: DataFrame, ts: str, bounds: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each split whose closed bounds hold it; rows in no split are dropped."""
    names = F.array_compact(F.array(*[F.when(F.col(ts).between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")), k) for k, (a, b) in bounds.items()]))
    return df.withColumn("split", F.explode(names))


def split_stratified(df: DataFrame, label: str, order: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """floor(n train) and floor(n val) of each of classes 0 and 1 by order; the rest is the test split."""
    rows = ranked(df.where(F.col(label).isin(0, 1)), order, label, name="sp_rank")
    size = F.broadcast(rows.groupBy(label).agg(F.count("*").alias("sp_n")))  # two rows
    cut_a, cut_b = F.floor(F.col("sp_n") * F.lit(train)), F.floor(F.col("sp_n") * F.lit(val))
    split = F.when(F.col("sp_rank") < cut_a, "train").when(F.col("sp_rank") < cut_a + cut_b, "val").otherwise("test")
    return rows.join(size, label).withColumn("split", split).drop("sp_rank", "sp_n")


def folds(df: DataFrame, label: str, order: str, k: int = 5) -> DataFrame:
    return ranked(df, order, label, name="fd_rank").withColumn("fold", F.pmod("fd_rank", F.lit(k)).cast("int")).drop("fd_rank")


def capped(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows with the least keys (a sampling operator: n is what is asked for).

    Rows beyond an approximate quantile that surely lies above the n-th key go first, so that few more than n are ranked, in
    ranges of the key rather than in one task.
    """
    rows = df.withColumn("cp_key", key)
    total = rows.count()
    if n >= total:
        return df
    share = min(1.0, n / total + 2 / ACCURACY)
    most = rows.agg(F.percentile_approx(F.col("cp_key").cast("double"), share, ACCURACY)).first()[0]
    near = rows.where(F.col("cp_key").isNull() | (F.col("cp_key").cast("double") <= most)) if most is not None else rows
    return ranked(near, "cp_key", name="cp_i").where(F.col("cp_i") < n).drop("cp_key", "cp_i")


def oversample(df: DataFrame, label: str, order: str, features: list[str]) -> DataFrame:
    """df with points between two minority rows until the classes are even; nothing if they are, or there is one class.

    Pairs and mixing weights are arithmetic on the number of the new row.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}  # a row a class
    base = df.select(label, *[F.col(f).cast("double").alias(f) for f in features])
    if len(counts) < 2 or len(set(counts.values())) == 1:
        return base
    few = min(counts, key=counts.get)
    n, deficit = counts[few], max(counts.values()) - counts[few]
    pool = ranked(df.where(F.col(label) == few), order, name="os_i").select("os_i", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    new = df.sparkSession.range(deficit).select(F.pmod(F.col("id") * 7919 + 13, F.lit(n)).alias("a"), F.pmod(F.col("id") * 104729 + 7, F.lit(n)).alias("b"), (F.pmod(F.col("id") * 31, F.lit(100)) / 100.0).alias("u"))
    both = new.join(pool.select(F.col("os_i").alias("a"), F.col("x").alias("xa")), "a").join(pool.select(F.col("os_i").alias("b"), F.col("x").alias("xb")), "b")
    x = F.zip_with("xa", "xb", lambda p, q: p + F.col("u") * (q - p))
    return base.unionByName(both.select(F.lit(few).alias(label), x.alias("x")).select(label, *[F.col("x")[i].alias(f) for i, f in enumerate(features)]))


def replay(df: DataFrame, order: str, total: int | None) -> DataFrame:
    """The first ``total`` rows by order, beginning again where there are fewer; all rows once for None or 0."""
    rows = ranked(df, order, name="rp_i")
    n = rows.count()
    if not n:
        return rows.withColumn("position", F.lit(0).cast("long")).drop("rp_i")
    return df.sparkSession.range(total or n).select(F.col("id").alias("position"), F.pmod("id", F.lit(n)).alias("rp_i")).join(rows, "rp_i").drop("rp_i")
