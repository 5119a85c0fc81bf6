"""Hand-sized fixtures with known answers."""

import pytest
from pyspark.sql import functions as F

from quaymark.functions import payloads, urls
from quaymark.operators import events, metrics, sampling
from quaymark.sources import feeds

URLS = {
    "https://api.example.com/v1/completions?a=1&b=2": (46, 15, 15, 2, 0, 0, 4, 0, 1, 0, 2), "http://10.0.0.7:8443/predict": (28, 13, 8, 3, 0, 0, 3, 1, 0, 1, 0), "https://h.com?x=1&y=2": (21, 13, 0, 1, 0, 0, 2, 0, 1, 0, 2),
    "https://h.com/p?a=1&": (20, 5, 2, 1, 0, 0, 3, 0, 1, 0, 2), "HTTPS://UP.example/": (19, 10, 1, 1, 0, 0, 3, 0, 0, 0, 0), "no-scheme.example/path_x-y": (26, 0, 0, 1, 2, 1, 1, 0, 0, 0, 0), "": (0,) * 11, None: (0,) * 11,
    "http://1.2.3.4.5/x": (18, 9, 2, 4, 0, 0, 3, 0, 0, 0, 0), "https://u@h.io:80#f": (19, 11, 0, 1, 0, 0, 2, 0, 1, 0, 0), "https://münchen.de/a?q#z": (24, 10, 2, 1, 0, 0, 3, 0, 1, 0, 1),
}


def test_url_features(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    for r in df.select("u", *[c.alias(k) for k, c in urls.features(F.col("u")).items()]).collect():
        assert tuple(r)[1:] == URLS[r["u"]], r["u"]


def test_homographs(spark):
    df = spark.createDataFrame([("g00gle.com",), ("goog1e.com",), ("google.com",)], "h string")
    assert [r[0] for r in df.select(urls.homograph(F.col("h"))).collect()] == [1, 1, 0]


@pytest.mark.parametrize(("t", "want"), [(0.03, (0, 3, 0, 3, 0.666667)), (0.35, (1, 2, 0, 3, 0.75)), (0.4, (1, 2, 1, 2, 0.571429)), (0.5, (2, 1, 2, 1, 0.4)), (0.9, (3, 0, 3, 0, 0.0))])
def test_metrics(spark, t, want):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1, 0], [0.1, 0.4, 0.35, 0.8, 0.4, 0.8], strict=True)), "y int, p double")
    r = metrics.rates(metrics.confusion(df, t)).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.f1) == want
    assert metrics.areas(df).first().roc_auc == 0.555556
    best = metrics.best_threshold(df).first()
    assert best.f1 == 0.75 and abs(best.threshold - 0.11) < 1e-9


def test_one_class_has_no_area(spark):
    assert metrics.areas(spark.createDataFrame([(1, 0.5)], "y int, p double")).first().roc_auc is None


@pytest.mark.parametrize(("cells", "kappa"), [((20, 5, 10, 15), 0.4), ((10, 0, 0, 10), 1.0)])
def test_kappa(spark, cells, kappa):
    rows = [(a, b) for (a, b), n in zip([(0, 0), (0, 1), (1, 0), (1, 1)], cells, strict=True) for _ in range(n)]
    assert metrics.kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").first().kappa == kappa


def test_repair_and_splits(spark):
    df = spark.createDataFrame([(i, None) for i in range(3)], "i long, ts timestamp")
    got = sampling.repair_timestamps(df, "ts", "i", "2025-09-01 00:00:00", "2025-09-02 00:00:00").orderBy("i").collect()
    assert [str(r.ts) for r in got] == ["2025-09-01 00:00:00", "2025-09-01 12:00:00", "2025-09-02 00:00:00"]
    seven = spark.createDataFrame([(i, 1) for i in range(7)] + [(9, 5)], "i long, y int")
    counts = {r["split"]: r["count"] for r in sampling.split_stratified(seven, "y", "i").groupBy("split").count().collect()}
    assert counts == {"train": 4, "val": 1, "test": 2}


@pytest.mark.parametrize(("total", "n"), [(None, 2), (0, 2), (1, 1), (5, 5)])
def test_replay(spark, total, n):
    got = sampling.replay(spark.createDataFrame([("a", 0), ("b", 1)], "x string, o long"), "o", total).orderBy("position").collect()
    assert [r.x for r in got] == list("ababa")[:n]


def test_oversample_levels_classes(spark):
    df = spark.createDataFrame([(i, int(i < 3), float(i)) for i in range(10)], "i long, y int, f double")
    got = sampling.oversample(df, "y", "i", ["f"]).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 7, 1: 7}
    assert sampling.oversample(df.where("y = 0"), "y", "i", ["f"]).count() == 7


def test_alerts_need_neighbours(spark):
    w = spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-01 10:05:00",), ("2024-01-01 10:15:00",), ("2024-01-01 23:50:00",), ("2024-01-01 23:55:00",), ("2024-01-02 00:00:00",)], "s string").select(F.col("s").cast("timestamp").alias("start"))
    got = events.consecutive(w, "true").collect()
    assert [(str(r.start), r.n) for r in got] == [("2024-01-01 23:50:00", 3)]


def test_payloads(spark):
    df = spark.createDataFrame([('{"a":{"b":{}}}',), ('{"a":"{{{"}',), ("{}",), (None,)], "p string")
    assert [r[0] for r in df.select(payloads.depth(F.col("p"))).collect()] == [2, 0, 0, 0]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in odd.select(payloads.finite(F.col("x"))).collect()] == [0, 0, 0, 2]


def test_feeds(spark, tmp_path):
    (tmp_path / "f.csv").write_text("# note\n URL ,DateAdded\nhttp://a/1,2025-09-01 10:00:00\nhttp://b/2,garbage\n")
    (tmp_path / "g.jsonl").write_text('{"domain": "c.example", "latency_ms": "x"}\n')
    csv = feeds.normalize(feeds.read_feed(spark, f"{tmp_path}/f.csv"), "my_feed", "2025-09-01 00:00:00").collect()
    assert [(r.url, str(r.timestamp), r.target, r.is_phishing) for r in csv] == [("http://a/1", "2025-09-01 10:00:00", "my feed", 1), ("http://b/2", "2025-09-01 00:00:00", "my feed", 1)]
    js = feeds.normalize(feeds.read_feed(spark, f"{tmp_path}/g.jsonl"), "x", "2025-09-01 00:00:00", 0, domain_column="domain", fill=False).first()
    assert (js.url, js.timestamp, js.latency_ms, js.is_phishing) == ("https://c.example/", None, 0.0, 0)
    with pytest.raises(ValueError):
        feeds.normalize(spark.range(1).withColumnRenamed("id", "n"), "x", "2025-09-01")
    feeds.write_splits(spark.createDataFrame([(1, "train")], "i int, split string"), f"{tmp_path}/s")
    feeds.write_document(spark.range(1), f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 1 and spark.read.json(f"{tmp_path}/d").first().id == 0
