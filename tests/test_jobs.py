"""The batch jobs from end to end, and fitted models on rows that don't separate."""

import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from quaymark.jobs import detect, prepare
from quaymark.operators import preparation
from quaymark.plans import preparing


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    home = tmp_path_factory.mktemp("data")
    (home / "feed.csv").write_text("# a comment\nURL,DateAdded,tokens_prompt\n" + "".join(f"https://bad{i}.example/p?x={i},2025-09-{i % 28 + 1:02d} 10:00:00,{i}\n" for i in range(60)) + "https://old.example/,2024-01-01 00:00:00,1\nhttps://dateless.example/,,x\n")
    (home / "list.txt").write_text("".join(f"{i},site{i}.example\n" for i in range(1, 41)))
    config = {
        "sources": {
            "feed": {"snapshot_file": "feed.csv", "augment_ai_endpoints": False},
            "top": {"snapshot_file": "list.txt", "streaming": True, "column_names": ["rank", "domain"], "domain_column": "domain", "label": 0, "fill_timestamp": False, "augment_ai_endpoints": False},
            "prompts": {"type": "jailbreak_reference", "snapshot_file": "x.jsonl"}, "gone": {"type": "telemetry", "snapshot_file": "gone.csv", "augment_ai_endpoints": False},
        },
        "window": {"start": "2025-09-01 00:00:00", "end": "2025-11-30 23:59:59"}, "max_rows": 30, "label_policy": {"taxonomy": {"owasp": "LLM01, LLM05"}},
        "splits": {"train": {"start": "2025-09-01", "end": "2025-10-15 23:59:59"}, "validation": {"start": "2025-10-16", "end": "2025-10-31 23:59:59"}, "test": {"start": "2025-11-02", "end": "2025-11-30 23:59:59"}},
    }
    (home / "config.json").write_text(json.dumps(config))
    return home, config


def test_prepare(spark, config):
    home, _ = config
    prepare.main(["--config", str(home / "config.json"), "--data-dir", str(home)])
    rows = spark.read.parquet(str(home / "processed" / "splits"))
    assert {*preparation.FEATURES, *preparation.METADATA, "is_phishing", "split"} == set(rows.columns)
    n = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    assert n["feed"] >= 59 and 20 <= n["prompts"] + n["top"] <= 54 and n["gone"] > 100 and n["benign"] > 100
    assert rows.where("source = 'top' AND is_phishing = 1").count() == 0 == rows.where("timestamp < '2025-09-01'").count()
    assert rows.where("(is_phishing = 1) <> (owasp_category IN ('LLM01', 'LLM05'))").count() == 0
    stats = {r["split"]: r for r in (json.loads(x["value"]) for x in spark.read.text(str(home / "processed" / "dataset_stats")).collect())}
    assert set(stats) == {"train", "validation", "test"} and stats["train"]["n"] == rows.where("split = 'train'").count()
    assert stats["train"]["dropped_outside_window"] == 1 + 4 and stats["test"]["dropped_outside_splits"] > 0  # the old row; the fixed rows of augmentation


def test_random_splits_and_bad_settings(spark, config):
    home, settings = config
    rows, _ = prepare.prepare(spark, settings | {"split_mode": "random"}, str(home))
    n = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert abs(n["train"] / sum(n.values()) - 0.7) < 0.02 and abs(n["validation"] - n["test"]) <= 4
    for wrong in ({"split_mode": "odd"}, {"split_mode": "random", "split_ratios": {"train": 0.5, "test": 0.2}}):
        with pytest.raises(ValueError):
            prepare.split_mode(prepare.DEFAULTS | wrong)
    assert prepare.load_config(spark, str(home / "none.json")) == prepare.DEFAULTS
    assert prepare.resolve("a/b", "/c/") == "/c/a/b" and prepare.resolve("/a", "/c") == "/a"


def test_without_a_configuration(spark, tmp_path):
    """The default sources are mocked, the default window and splits hold; counters are those of a recount."""
    rows, stats = prepare.prepare(spark, prepare.load_config(spark, None), str(tmp_path))
    n = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    assert set(n) == {"phishtank", "openphish", "urlhaus", "benign"} and min(n.values()) >= 110
    assert {r["split"] for r in stats.collect()} == {"train", "validation", "test"}
    for r in stats.collect():
        own = rows.where(F.col("split") == r["split"])
        assert own.count() == r["n"] and abs(own.where("is_phishing = 1").count() / r["n"] - r["phishing_ratio"]) < 1e-12
        assert own.agg(F.min("timestamp") >= F.lit(prepare.DEFAULTS["splits"][r["split"]]["start"]).cast("timestamp")).first()[0]
    assert rows.where("source = 'benign' AND is_ai_endpoint = 0").count() == 0


def test_saved_model_scores_alike(spark, sf_dir, tmp_path):
    rows = preparing.hard_rows(preparing.Tables(spark, sf_dir))
    model = detect.fit(rows, str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    requests = rows.where("split = 'test'").select(F.monotonically_increasing_id().cast("string").alias("record_id"), F.array(*preparation.FEATURES).alias("features"), F.lit(None).cast("struct<category: string, tactic: string>").alias("context"))
    wrong = requests.limit(3).withColumn("features", F.slice("features", 1, 14))
    found = [{r["record_id"]: r for r in detect.score(requests.unionByName(wrong), m).collect()} for m in (model, loaded)]
    assert found[0] == found[1] and len(found[0]) == requests.count()
    one = requests.first()
    alone = detect.score(spark.createDataFrame([one], requests.schema), loaded).first()
    assert alone["probability"] == pytest.approx(found[0][one["record_id"]]["probability"]) and alone["category"] == "N/A"
    assert alone["line"].startswith("MONITOR {") and alone["decision"] == int(alone["probability"] >= detect.THRESHOLD)
    waves = detect.burst(rows.where("split = 'test'").drop("split"), loaded, 100).collect()
    assert sorted(r["position"] for r in waves) == list(range(100)) and {r["wave"] for r in waves} == {0, 1, 2, 3}
    assert preparation.accepted_rejected(requests.unionByName(wrong))[1].count() == 3


def test_models_on_overlapping_classes(spark, sf_dir):
    row = preparing.QUERIES["legacy_forest"](spark, sf_dir).first()
    assert 0.6 < row["accuracy"] <= 1 and 0.5 < row["roc_auc"] <= 1


def test_forest_ablations(spark, sf_dir):
    got = {r["experiment"]: r for r in preparing.QUERIES["forest_ablations"](spark, sf_dir).collect()}
    assert set(got) == {f"{m}_{x}" for m in ("logistic", "forest") for x in ("baseline", *(f"minus_{k}" for k in detect.FAMILIES))}
    for m in ("logistic", "forest"):
        assert got[f"{m}_minus_telemetry"]["roc_auc"] < got[f"{m}_baseline"]["roc_auc"]
