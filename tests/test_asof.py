"""As-of joins against a search row by row."""

import datetime as dt
import random

import pytest

from quaymark.operators import asof

ZERO = dt.datetime(2024, 5, 1)


def at(s):
    return None if s is None else ZERO + dt.timedelta(seconds=s)


def search(left, right, tolerance, strict):
    out = []
    for i, k, s in left:
        ok = [r for r in right if k is not None and s is not None and r[0] == k and r[1] is not None and (r[1] < s if strict else r[1] <= s) and (tolerance is None or s - r[1] <= tolerance)]
        best = max(ok, key=lambda r: (r[1], r[2]), default=(None, None, None))
        out.append((i, k, at(s), at(best[1]), best[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("tolerance", "strict", "width"), [(None, False, "1 hour"), (600, False, "7 minutes"), (600, True, "1 day"), (None, True, "30 seconds")])
def test_equals_a_search(spark, tolerance, strict, width):
    """Ties of time, rows on the borders of slices, keys of one table only, null keys and times, a key with most rows."""
    rng = random.Random(1)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "only-left", None])
    time = lambda: rng.choice([None, *[rng.randrange(0, 40_000) // 30 * 30] * 12])
    left = [(i, key(), time()) for i in range(400)] + [(0, "hot", 60), (0, "hot", 60), (900, "early", 10)]
    right = [(rng.choice(["hot"] * 5 + ["a", "b", "only-right", None]), time(), i) for i in range(300)] + [("early", 11, 7000), ("early", 4000, 7001)]
    l = spark.createDataFrame([(i, k, at(s), "x") for i, k, s in left], "i long, k string, t timestamp, f string")  # noqa: E741
    r = spark.createDataFrame([(k, at(s), i, 1) for k, s, i in right], "k string, u timestamp, v long, row int")
    got = asof.as_of(l, r, ["k"], "t", "u", ["v"], "v", f"{tolerance} seconds" if tolerance else None, width, strict)
    assert got.columns == ["i", "k", "t", "f", "u_found", "v"]
    assert sorted(((r["i"], r["k"], r["t"], r["u_found"], r["v"]) for r in got.collect()), key=str) == search(left, right, tolerance, strict)


def test_empty_sides_and_two_keys(spark):
    l = spark.createDataFrame([(1, "a", 2, at(5))], "i long, k string, m int, t timestamp")  # noqa: E741
    r = spark.createDataFrame([("a", 2, at(5), 9), ("a", 3, at(5), 8)], "k string, m int, u timestamp, v int")
    join = lambda x, y: [tuple(z) for z in asof.as_of(x, y, ["k", "m"], "t", "u", ["v"], "v").collect()]
    assert join(l, r) == [(1, "a", 2, at(5), at(5), 9)] and join(l, r.limit(0)) == [(1, "a", 2, at(5), None, None)] and join(l.limit(0), r) == []


def test_a_hot_key_is_many_groups(spark):
    l = spark.range(2000).selectExpr("id AS i", "'k' AS k", "timestamp_seconds(id * 60) AS t")  # noqa: E741
    plan = asof.as_of(l, l.selectExpr("k", "t AS u", "i AS v"), ["k"], "t", "u", ["v"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(k#" in plan and "slice#" in plan.split("windowspecdefinition(k#", 1)[1][:40]
