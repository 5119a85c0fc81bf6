"""The session store against sessions computed at once, with files in any order."""

import random

import pytest
from pyspark.sql import functions as F

from quaymark.streaming import store

ZERO = 1_700_000_000


def whole(rows, gap=1800):
    out, by = [], {}
    for u, s, i, k, v in rows:
        by.setdefault(u, []).append((s, i, k, v))
    for u, own in by.items():
        run = []
        for e in sorted(own):
            if run and e[0] - run[-1][0] >= gap:
                out.append((u, run))
                run = []
            run.append(e)
        out.append((u, run))
    return {(u, r[0][0]): (len(r), r[-1][0], round(sum(x[3] for x in r), 6), r[-1][2]) for u, r in out}


def stream(spark, folder, files, delay):
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, "user_id long, s long, event_id long, event_type string, value double")
        df.select("*", F.timestamp_seconds(F.lit(ZERO) + F.col("s")).alias("ts")).drop("s").coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    schema = "user_id long, event_id long, event_type string, value double, ts timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder).withWatermark("ts", delay)


def run(spark, tmp_path, events, **more):
    query = store.sessions(events, **more).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/rows")
    query.awaitTermination()
    return query, spark.read.schema(store.OUT).parquet(f"{tmp_path}/rows")


def test_equals_sessions_at_once_whatever_the_order(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(0, 400_000) // 60 * 60, i, rng.choice(["a", "b", None]), rng.random()) for i in range(600)]
    rows += [(4, 0, 9000, "a", 1.0), (4, 1800, 9001, "b", 1.0), (4, 3599, 9002, "c", 1.0)]  # a pause of exactly the gap ends a session
    end = [(99, 2_000_000, 99_999, "end", 0.0)]
    rng.shuffle(rows)
    files = [rows[i::5] for i in range(5)]
    query, found = run(spark, tmp_path / "a", stream(spark, f"{tmp_path}/a/in", files, "10 days"))
    assert found.where("closed").count() == 0 == store.late(query, found) and store.held(query) == 4  # the watermark hasn't come so far
    query, found = run(spark, tmp_path / "b", stream(spark, f"{tmp_path}/b/in", [*files, [(99, 2_000_000, 99_999, "end", 0.0)]], "10 days"))
    got = {(r["user_id"], int(r["start"].timestamp()) - ZERO): (r["n"], int(r["end"].timestamp()) - ZERO, round(r["total"], 6), r["last_type"]) for r in found.collect()}
    assert got == whole(rows)
    assert store.held(query) == 1  # only the last user's session is still open


def test_late_rows_are_counted_and_a_row_can_join_two_sessions(spark, tmp_path):
    files = [[(1, 0, 1, "a", 1.0), (1, 3000, 2, "b", 1.0)], [(1, 1500, 3, "c", 1.0)], [(2, 100_000, 4, "x", 1.0)], [(1, 10, 5, "late", 1.0), (2, 100_010, 6, "x", 1.0)], [(2, 300_000, 7, "end", 1.0)]]
    query, found = run(spark, tmp_path, stream(spark, f"{tmp_path}/in", files, "1 hour"), running=True)
    rows = [tuple(r) for r in found.where("user_id = 1 AND start is not null").select("n", "last_type", "closed").collect()]
    assert sorted(rows) == [(1, "a", False), (1, "b", False), (3, "b", False), (3, "b", True)] and store.late(query, found) == 1
    assert found.where("user_id = 2 AND closed").select("n", "per_minute").first() == (2, pytest.approx(12.0))


def test_merge_keeps_the_latest_context():
    new = lambda a, b, e, k: store.Session(a, b, 1, 0.5, e, k)
    (one,) = store.merge([new(20, 30, 7, "x"), new(0, 12, 9, "y"), new(11, 30, 8, "z")], 10)
    assert (one.start, one.end, one.n, one.total, one.event, one.type) == (0, 30, 3, 1.5, 8, "z")
