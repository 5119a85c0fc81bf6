"""The detectors' jobs from trained models to reports."""

import json

import pytest
from pyspark.sql import functions as F

from quaymark.jobs import detect
from quaymark.operators import learning, metrics, preparation
from quaymark.plans import preparing, serving


@pytest.fixture(scope="module")
def home(spark, sf_dir, tmp_path_factory):
    """Splits with every seventh label or so turned, as prepare writes them."""
    folder = tmp_path_factory.mktemp("detect")
    rows = serving.mislabelled(preparing.hard_rows(preparing.Tables(spark, sf_dir)))
    split = F.when(F.col("split") == "train", "train").when(F.pmod("row", F.lit(2)) == 0, "validation").otherwise("test")
    rows.withColumns({"split": split, "is_phishing": F.col("y")}).drop("row", "y").write.partitionBy("split").parquet(f"{folder}/splits")
    return str(folder)


def documents(spark, path):
    return [json.loads(r["value"]) for r in spark.read.text(path).collect()]


def test_train_evaluate_and_replay(spark, home):
    rows = detect.split_rows(spark, f"{home}/splits").persist()
    n = rows.where("split = 'train'").count()
    got = {(r["model"], r["split"]): r for r in detect.train(rows, f"{home}/models", "v7", {"rf_trees": 10, "rf_depth": 5, "rf_max_train_rows": n // 2}).collect()}
    assert set(got) == {(m, s) for m in detect.MODELS for s in ("validation", "test")} and got["random_forest", "test"]["trained_on"] == n // 2 < got["logistic_l1", "test"]["trained_on"]
    models, version = detect.load(spark, f"{home}/models")
    assert version == "v7" and set(models) == set(detect.MODELS)
    bundle = documents(spark, f"{home}/models/bundle")[0]
    assert bundle["feature_columns"] == preparation.FEATURES and bundle["training"]["rf_max_train_rows"] == n // 2

    detect.main(["evaluate", "--splits", f"{home}/splits", "--model", f"{home}/models", "--out", f"{home}/eval"])
    table = {(r["model"], r["split"]): r for r in documents(spark, f"{home}/eval/evaluation_summary")}
    assert len(table) == 4
    for m in detect.MODELS:
        scores = {s: learning.probabilities(models[m], rows.where(F.col("split") == s)).select("y", "p").persist() for s in ("validation", "test")}
        best = metrics.best_threshold(scores["validation"]).first()
        assert table[m, "validation"]["threshold"] == table[m, "test"]["threshold"] == best["threshold"] and table[m, "validation"]["f1"] == best["f1"]
        hit = scores["test"].where(F.col("p") >= best["threshold"])
        assert table[m, "test"]["tp"] == hit.where("y = 1").count() and table[m, "test"]["fp"] == hit.where("y = 0").count()
    curve = spark.read.option("header", True).csv(f"{home}/eval/roc")
    assert {r["model"] for r in curve.select("model").distinct().collect()} == set(detect.MODELS) and curve.where("model = 'logistic_l1'").count() > 2
    (m,) = documents(spark, f"{home}/eval/mcnemar")
    assert 0 <= m["p_value"] <= 1 and m["b"] + m["c"] <= rows.where("split = 'test'").count()

    (burst,) = detect.burst_latency(rows.where("split = 'test'").drop("split"), models["logistic_l1"], 70, 32).collect()
    assert burst["count"] == 70 and 0 < burst["p50_ms"] <= burst["p95_ms"] <= burst["p99_ms"] <= burst["max_ms"]
    with pytest.raises(ValueError):
        detect.train(rows, f"{home}/x", settings={"logistic_penalty": "l3"})


def test_correlations_and_rejected_requests(spark, home):
    detect.main(["correlate", "--splits", f"{home}/splits", "--out", f"{home}/corr"])
    cells = {(r["f1"], r["f2"]): r.get("corr") for r in documents(spark, f"{home}/corr")}
    assert len(cells) == 225 and cells["prompt_tokens", "prompt_tokens"] == 1.0 and all(cells[a, b] == cells[b, a] for a, b in cells)
    rows = detect.split_rows(spark, f"{home}/splits")
    assert cells["prompt_tokens", "latency_ms"] == pytest.approx(rows.corr("prompt_tokens", "latency_ms"), abs=1e-5)
    learning.linear({"url_length": 0.1}, 0.0).write().overwrite().save(f"{home}/linear")
    asked = [{"record_id": "a", "features": [1.0] * 15, "context": {"category": "c", "tactic": None}}, {"record_id": "b", "features": [1.0] * 14}, {"record_id": "c"}]
    spark.createDataFrame([(json.dumps(r),) for r in asked], "value string").write.text(f"{home}/requests")
    detect.main(["score", "--requests", f"{home}/requests", "--model", f"{home}/linear", "--out", f"{home}/scores"])
    assert [r["record_id"] for r in spark.read.json(f"{home}/scores").collect()] == ["a"]
    assert {(r["record_id"], r["problem"]) for r in spark.read.json(f"{home}/scores-rejected").collect()} == {("b", "length"), ("c", "missing")}
