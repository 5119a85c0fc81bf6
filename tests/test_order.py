"""Rows numbered in file order, and stored distinct counts."""

import pytest
from pyspark.sql import functions as F

from quaymark.operators import distinct, preparation, sampling
from quaymark.sources import feeds


@pytest.fixture
def small_splits(spark):
    """Files in many splits, which Spark packs into partitions by size."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_first_lines_of_a_folder_in_name_order(spark, tmp_path, small_splits):
    lines, k = [], 0
    for name, n in (("b.csv", 900), ("a.csv", 20), ("c.csv", 1500), ("aa.csv", 0)):
        rows = [f"http://x/{name}/{i}{'y' * (i % 40)},2025-01-01" for i in range(n)]
        lines.append((name, rows))
        (tmp_path / name).write_text("# note\nurl,date\n" + "".join(f"{r}\n" + ("# in between\n\n" if i % 7 == 0 else "") for i, r in enumerate(rows)))
    want = [r.split(",")[0] for _, rows in sorted(lines) for r in rows]
    df = feeds.read_feed(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 5
    got = feeds.numbered(df).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(len(want))) and [r["url"] for r in got] == want
    for k in (0, 1, 25, 921, 5000):
        assert sorted(r["url"] for r in feeds.first(df, k).collect()) == sorted(want[:k])
    assert [r["url"] for r in feeds.read_feed(spark, str(tmp_path), limit=3).collect()] == want[:3]


def test_no_global_sort(spark, sf_dir):
    plan = feeds.numbered(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey"))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_a_new_day_rereads_nothing(spark, tmp_path):
    day = lambda d, a, b: spark.range(a, b).select(F.lit(d).alias("day"), F.col("id").alias("user"), F.lit(None).cast("string").alias("none"))
    home = f"{tmp_path}/sketches"
    distinct.store(day("2024-01-01", 0, 60_000).unionByName(day("2024-01-02", 30_000, 90_000)), "day", ["user", "none"], home)
    files = {f for f in spark.read.parquet(home).inputFiles()}
    distinct.store(day("2024-01-03", 80_000, 120_000), "day", ["user", "none"], home)
    assert files < set(spark.read.parquet(home).inputFiles())  # the first two days' files are as they were
    got = {r["day"]: (r["user"], r["none"]) for r in distinct.by_key(spark, home, "day").collect()}
    assert all(abs(got[d][0] - n) < 0.02 * n and got[d][1] == 0 for d, n in (("2024-01-01", 60_000), ("2024-01-02", 60_000), ("2024-01-03", 40_000)))
    assert abs(distinct.overall(spark, home).first()["user"] - 120_000) < 2400 and abs(distinct.overall(spark, home, "day <= '2024-01-02'").first()["user"] - 90_000) < 1800
    assert distinct.overall(spark, home, "false").first()["user"] == 0
    distinct.store(day("2024-01-03", 0, 10), "day", ["user", "none"], home)  # again: it takes the place of what was there
    assert {r["day"]: r["user"] for r in distinct.by_key(spark, home, "day").collect()}["2024-01-03"] == 10


def test_categories_and_tactics_are_drawn_by_themselves(spark):
    rows = spark.range(9000).select(F.col("id"), F.lit(1).alias("is_phishing"))
    n = preparation.assign_taxonomy(rows, F.col("id"), ["a", "b", "c"], ["x", "y", "z"]).groupBy("owasp_category", "atlas_tactic").count().collect()
    assert len(n) == 9 and all(850 < r["count"] < 1150 for r in n)


def test_endpoints_where_none_are_marked(spark):
    urls = {"https://a/v1/chat/completions": 1, "https://a/v1/completions": 1, "https://a/v1/embeddings": 1, "https://a/v1/models": 1, "https://a/inference": 1, "https://a/predict": 1, "https://a/generate": 0, "https://a/classify": 0, "https://a/api/v1": 0, "https://a/embeddings": 0, None: 0}
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("timestamp", F.lit(None).cast("timestamp")).withColumn("u", F.col("url"))
    got = preparation.feature_frame(df, "s").select("url_length", "is_ai_endpoint").collect()
    assert sorted((r[0], r[1]) for r in got) == sorted((len(u or ""), v) for u, v in urls.items())


def test_agreement_of_runs(spark):
    rows = [("r", i, i % 2, (i % 2 if i % 10 else 1 - i % 2) if i % 2 == 0 else None) for i in range(120)] + [("q", i, 1, None) for i in range(50)]
    got = {(r["reviewer"], r["check"]): r for r in preparation.agreement_checks(spark.createDataFrame(rows, "reviewer string, i long, first int, second int"), "i").collect()}
    assert set(got) == {("r", 0), ("r", 1), ("q", 0)} and got["q", 0]["pairs"] == 0 and got["q", 0]["kappa"] is None
    assert got["r", 0]["pairs"] == 25 and got["r", 0]["agreement"] == 0.8 and got["r", 0]["kappa"] == 0.0
    assert sampling.ranked(spark.createDataFrame([], "i long"), "i").count() == 0
