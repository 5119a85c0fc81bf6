"""Windows in time slices against windows over whole users."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaymark.operators import events


def rows(spark):
    """A user with most events, ties, events on the borders of slices and just before, null users and times before 1970."""
    rng = random.Random(3)
    at = [rng.choice([0, -7200, 86_400]) + rng.randrange(0, 9000) for _ in range(1500)] + [3600, 3600, 3599, 3300, 3301, 7200, 0, -1, -300]
    made = [(i, rng.choice([1, 1, 1, 1, 2, 3, None]), dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s), rng.choice("abc"), rng.random() * 100) for i, s in enumerate(at)]
    return spark.createDataFrame(made, "event_id long, user_id long, ts timestamp, event_type string, tokens double")


def test_rates(spark):
    df = rows(spark)
    at = F.unix_micros("ts")
    w = lambda m: Window.partitionBy("user_id").orderBy(at).rangeBetween(-m * 60_000_000, 0)
    want = df.select("event_id", F.count("*").over(w(1)).alias("a"), F.count("*").over(w(5)).alias("b"))
    assert sorted(events.rates(df).collect()) == sorted(want.collect())


def test_gaps(spark):
    df = rows(spark)
    w, at = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.unix_micros("ts")
    gap = at - F.lag(at).over(w)
    churn = (gap <= 600_000_000) & (F.lag("event_type").over(w) != F.col("event_type"))
    want = df.select("event_id", gap.alias("g"), F.coalesce(churn.cast("int"), F.lit(0)).alias("c"))
    assert {tuple(r) for r in events.gaps(df).collect()} == {tuple(r) for r in want.collect()} and events.gaps(df).count() == df.count()


def test_policy_counts_repeats_over_slices(spark):
    base = dt.datetime(2024, 1, 1, 0, 55)
    made = [(i, 7, base + dt.timedelta(minutes=i * 2), 100.0, 1.0, "x") for i in range(6)] + [(100 + i, 8, base + dt.timedelta(seconds=i), 1.0, 1.0, "x") for i in range(400)]
    df = spark.createDataFrame(made, "event_id long, user_id long, ts timestamp, tokens double, latency double, payload string")
    got = {r["event_id"]: r["category"] for r in events.policy(df).collect()}
    assert len(got) == len(made) and [got[i] for i in range(6)] == ["BENIGN"] * 3 + ["LLM09"] * 3  # the fourth within ten minutes and those after
