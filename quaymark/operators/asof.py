"""As-of joins: each row of one table with the latest row of another at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time slices that one task orders.
SLICE = "1 hour"


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], tie: str, tolerance: str | None = None, slice_width: str = SLICE, strict: bool = False) -> DataFrame:
    """left with right's ``values`` and its time (``<right_time>_found``), of the latest row of equal keys at or before left_time.

    Both tables are united by key and time and cut into slices; within a slice a window carries the last value on, and the
    last value of each slice, one row, is carried over the slices after it. So a key with very many rows is as many tasks
    as it has slices, and a slice without a right row costs nothing more.

    Defined results: a right row of the same time counts (not with ``strict``); of several right rows of one time the one with
    the greatest ``tie`` counts, then the greatest values; a right row further back than ``tolerance`` does not count, one
    exactly so far back does; left rows without a match, a key or a time stay, with nulls; right rows without a key or time
    are never found; repeated left rows stay repeated; other columns of left pass through whatever their names.
    """
    step = f"INTERVAL {slice_width}"
    width = left.sparkSession.sql(f"SELECT unix_micros(TIMESTAMP '1970-01-01 00:00:00 UTC' + {step})").first()[0]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    pack = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    full = lambda t: F.col(t).isNotNull() & F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x)
    found = F.struct(micros(right_time).alias("at"), F.col(tie).alias("tie"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    order = 1 if strict else 0  # of equal times: right rows after left ones, or before
    kind = right.select(found.alias("f")).schema["f"].dataType
    rows = left.select(pack.alias("k"), micros(left_time).alias("at"), F.lit(1 - order).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(kind).alias("f"), full(left_time).alias("ok"))
    known = right.where(full(right_time)).select(pack.alias("k"), micros(right_time).alias("at"), F.lit(order).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), found.alias("f"), F.lit(True).alias("ok"))
    both = rows.where("ok").unionByName(known).withColumn("slice", F.floor(F.col("at") / width))
    inner = Window.partitionBy("k", "slice").orderBy("at", "side", "f").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("f", F.last("f", ignorenulls=True).over(inner)).where("row is not null")
    ends = both.groupBy("k", "slice").agg(F.max("f").alias("f"))  # at comes first in f
    over = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("k", "slice", F.last("f", ignorenulls=True).over(over).alias("earlier"))
    joined = within.join(before, ["k", "slice"]).withColumn("f", F.coalesce("f", "earlier"))
    if tolerance:
        least = F.unix_micros(F.timestamp_micros("at") - F.expr(f"INTERVAL {tolerance}"))
        joined = joined.withColumn("f", F.when(F.col("f.at") >= least, F.col("f")))
    out = joined.select("row", "f").unionByName(rows.where("NOT ok").select("row", "f"))
    return out.select(*[F.col(f"row.`{c}`") for c in left.columns], F.timestamp_micros("f.at").alias(f"{right_time}_found"), *[F.col(f"f.v{i}").alias(v) for i, v in enumerate(values)])
