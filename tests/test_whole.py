"""Results that grow with the input stay off the driver and out of single tasks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quaymark.operators import metrics, sampling
from quaymark.streaming import jobs


def test_streams_are_written_to_the_shared_folder(spark, sf_dir):
    source = f"{sf_dir}/events.parquet"
    for stream, mode in ((jobs.distinct, "append"), (jobs.sessions, "append"), (jobs.sliding, "complete")):
        got = jobs.run(stream(jobs.events(spark, source)), mode)
        home, files = spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), got.inputFiles()
        assert files and all(f"{home}/stream-" in f for f in files) and got.count() > 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stream_")]


def test_quantiles_are_exact_and_sort_only_ranges(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.gauss(0, 50), rng.expovariate(0.01), float(rng.randrange(9)), -0.5])) for k in ("a", "b", None) for _ in range(3000)] + [("lone", 2.5), ("null", None), ("a", None)]
    df, shares = spark.createDataFrame(rows, "k string, v double"), [0.0, 0.05, 0.5, 0.975, 1.0]
    got = {r["k"]: r["p"] for r in metrics.quantiles(df, "v", shares, "k").collect()}
    want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect()}
    near = lambda a, b: a is b is None or all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
    assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)


def test_roc_neighbours_across_parts(spark):
    """Points on a straight line across parts of the score are left out, as are those within one."""
    df = spark.createDataFrame([(y, p / 40) for p in range(40) for y in (0, 1)], "y int, p double")
    assert {r["threshold"] for r in metrics.roc_points(df).collect()} == {None, 0.0}
    plan = metrics.roc_points(df)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(part#" in plan and "windowspecdefinition(p#" not in plan  # no order over all scores


NARROW = ["0.99 + id / 1e8", "id / 1e9", "1000 + pmod(id * 7919, 100003) / 1e4", "IF(id < 49000, 0.5, id)"]


@pytest.mark.parametrize("expr", NARROW)
def test_narrow_ranges_are_dealt_out(spark, expr):
    """Values that all lie close together: no range of scores, ranks or brackets holds over a tenth of the distinct ones."""
    df = spark.range(50_000).select("id", F.expr(f"CAST({expr} AS DOUBLE)").alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    distinct = df.select("p").distinct()
    n = distinct.count()
    assert metrics.score_parts(distinct).groupBy("part").count().agg(F.max("count")).first()[0] <= max(n / 10, 2)
    shares = [0.0, 0.05, 0.5, 0.975, 1.0]
    got = metrics.quantiles(df, "p", shares).first()["p"]
    values = sorted(r[0] for r in df.select("p").collect())
    for q, x in zip(shares, got, strict=True):
        s = q * (len(values) - 1)
        a, b = values[math.floor(s)], values[math.ceil(s)]
        assert abs(x - (a + (s - math.floor(s)) * (b - a))) < 1e-9 * max(1, abs(a))
        lo, hi = df.agg(F.percentile_approx("p", [max(q - 2e-4, 0.0), min(q + 2e-4, 1.0)], metrics.ACCURACY)).first()[0]
        assert distinct.where(F.col("p").between(lo, hi)).count() <= max(n / 10, 2)
    ranks = sampling.ranked(df, "p", unique="id", name="r")
    assert [r["id"] for r in ranks.orderBy("r").limit(50).collect()] == [r["id"] for r in df.orderBy("p", "id").limit(50).collect()]
    assert {r["id"] for r in sampling.capped(df, F.col("id") * 7919 % 50_021, 777).collect()} == {i for _, i in sorted((i * 7919 % 50_021, i) for i in range(50_000))[:777]}


def test_groups_of_few_values_nulls_and_nan(spark):
    rows = [("a", float(i)) for i in range(10)] + [("b", 1.0)] * 3 + [("c", None), (None, 2.0), (None, 3.0), ("d", float("nan")), ("d", 1.0)]
    got = {r["k"]: r["p"] for r in metrics.quantiles(spark.createDataFrame(rows, "k string, v double"), "v", [0.05, 0.5, 0.95], "k").collect()}
    assert got["a"] == pytest.approx([0.45, 4.5, 8.55]) and got["b"] == [1.0] * 3 and got["c"] is None and got[None] == pytest.approx([2.05, 2.5, 2.95])
    assert math.isnan(got["d"][2]) and sampling.ranked(spark.createDataFrame([(None,), (2.0,), (1.0,)], "x double"), "x").orderBy("rank").first()["x"] is None
    assert sampling.capped(spark.createDataFrame([(1,)], "x long"), F.col("x"), 5).count() == 1
