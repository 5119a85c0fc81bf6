"""The batch job from configured feeds to labelled splits and their statistics.

    spark-submit -m quaymark.jobs.prepare --config feeds.json --data-dir data

The configuration is JSON (YAML where that can be imported): sources by name, window, splits or split_ratios, split_mode,
feature_profile, label_policy, output, max_rows, benign_multiplier. Relative paths start at the data folder.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators import preparation, sampling
from quaymark.sources import feeds

# The sources, window and splits without a configuration.
DEFAULTS = {
    "sources": {
        "phishtank": {"type": "feed", "snapshot_file": None}, "openphish": {"type": "feed", "snapshot_file": None}, "urlhaus": {"type": "feed", "snapshot_file": None},
    },
    "window": {"start": "2025-05-12T00:00:00Z", "end": "2025-08-03T23:59:59Z"},
    "splits": {
        "train": {"start": "2025-05-12T00:00:00Z", "end": "2025-06-22T23:59:59Z"}, "validation": {"start": "2025-06-23T00:00:00Z", "end": "2025-07-13T23:59:59Z"},
        "test": {"start": "2025-07-14T00:00:00Z", "end": "2025-08-03T23:59:59Z"},
    },
    "split_mode": "time", "split_ratios": {"train": 0.7, "validation": 0.15, "test": 0.15},
    "feature_profile": "url_plus_telemetry", "label_policy": {}, "output": {}, "max_rows": None, "benign_multiplier": 1.0,
}


def resolve(path: str, base: str) -> str:
    """path itself if it is absolute or names a file system, else within base."""
    return path if path.startswith("/") or "://" in path else f"{base.rstrip('/')}/{path}"


def load_config(spark: SparkSession, path: str | None) -> dict:
    """The file's settings over the defaults; the defaults alone without a file or where there is none."""
    if not path:
        return dict(DEFAULTS)
    try:
        text = "\n".join(r["value"] for r in spark.read.text(path).collect())  # a configuration file
    except Exception as e:  # Spark says in many ways that there is no such file
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return dict(DEFAULTS)
    if path.endswith((".yml", ".yaml")):
        import yaml

        return DEFAULTS | (yaml.safe_load(text) or {})
    return DEFAULTS | json.loads(text)


def split_mode(config: dict) -> str:
    mode = str(config["split_mode"]).lower()
    if mode not in ("time", "random"):
        raise ValueError(f"unknown split mode {mode}")
    ratios = config["split_ratios"]
    if mode == "random" and not 0.99 <= sum(ratios.get(k, 0.0) for k in ("train", "validation", "test")) <= 1.01:
        raise ValueError("split ratios must sum to 1")
    return mode


def load_source(spark: SparkSession, name: str, meta: dict, window: dict, base: str, max_rows: int | None = None) -> DataFrame:
    """A source in normal form: none of reference material, mock rows where the file is missing or can't be read as a feed."""
    if meta.get("type") in preparation.REFERENCE_KINDS:
        return spark.createDataFrame([], feeds.NORMAL)
    path = meta.get("snapshot_file")
    if path:
        try:
            names = meta.get("column_names")
            schema = ", ".join(f"`{c}` string" for c in names) if names else None
            raw = feeds.read_feed(spark, resolve(path, base), schema=schema, header=not names, limit=max_rows if meta.get("streaming") else None)
            return feeds.normalize(raw, name, window["start"], meta.get("label", 1), meta.get("url_template", "https://{domain}/"), meta.get("domain_column"), meta.get("fill_timestamp", True)).drop("source")
        except Exception as e:
            if not isinstance(e, ValueError) and "PATH_NOT_FOUND" not in str(e):
                raise
    return feeds.mock(spark, name, window["start"], window["end"], kind=meta.get("type", "phishing")).drop("id")


def prepare(spark: SparkSession, config: dict, base: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their split, a row of counters a split). Counters are one aggregate each over rows that are checkpointed by then."""
    config, mode = DEFAULTS | config, split_mode(DEFAULTS | config)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", resolve("checkpoints", base)))
    window, profile = config["window"], config["feature_profile"]
    frames = []
    for name, meta in config["sources"].items():
        rows = load_source(spark, name, meta, window, base, config["max_rows"])
        if meta.get("augment_ai_endpoints", True):
            rows = preparation.augment(rows, window["start"], window["end"])
        frames.append(preparation.feature_frame(rows, name, profile))
    rows = feeds.union(frames).withColumn("row", F.monotonically_increasing_id())
    inside = F.coalesce(F.col("timestamp").between(F.lit(window["start"]).cast("timestamp"), F.lit(window["end"]).cast("timestamp")), F.lit(False))
    repaired = sampling.repair_timestamps(rows.checkpoint(), "timestamp", "row", window["start"], window["end"])
    rows = repaired.checkpoint()
    seen = rows.agg(F.count_if(~inside).alias("outside"), F.count_if(inside & (F.col("is_phishing") == 1)).alias("bad")).first()
    kept = rows.where(inside)
    n = int(seen["bad"] * float(config["benign_multiplier"]))
    names = {"prompt_tokens": "tokens_prompt", "completion_tokens": "tokens_completion"}
    made = feeds.benign(spark, n, window["start"], window["end"], profile == "url_only").withColumnsRenamed(names).withColumn("is_ai_endpoint", F.lit(True))
    good = preparation.feature_frame(made, "benign", profile)
    taxonomy = config["label_policy"].get("taxonomy", {})
    key = F.pmod(F.xxhash64("timestamp", "source", "row"), F.lit(1_000_003))
    full = kept.unionByName(good.withColumn("row", F.monotonically_increasing_id()))
    full = preparation.assign_taxonomy(full.checkpoint(), key, taxonomy.get("owasp"), taxonomy.get("mitre_atlas"))
    bounds = {k: (v["start"], v["end"]) for k, v in config["splits"].items()}
    if mode == "random":
        ratios = config["split_ratios"]
        split = sampling.split_stratified(full.withColumn("key", key), "is_phishing", "key", ratios["train"], ratios["validation"]).drop("key")
        split = split.withColumn("split", F.when(F.col("split") == "val", "validation").otherwise(F.col("split")))
        labels = ["train", "validation", "test"]
    else:
        some = F.lit(False)
        for a, b in bounds.values():
            some = some | F.coalesce(F.col("timestamp").between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")), F.lit(False))
        split, labels = sampling.split_by_time(full, "timestamp", bounds), list(bounds)
    own = lambda k: F.col("split") == k
    counted = [x for i, k in enumerate(labels) for x in (F.count_if(own(k)).alias(f"n{i}"), F.count_if(own(k) & (F.col("is_phishing") == 1)).alias(f"bad{i}"))]
    split = split.drop("row").checkpoint()
    outside = 0 if mode == "random" else full.agg(F.count_if(~some)).first()[0]
    got = split.agg(*counted).first()
    head = (seen["outside"], outside, ",".join(preparation.FEATURES), window["start"], window["end"], mode)
    stats = [(k, got[f"n{i}"], got[f"bad{i}"] / got[f"n{i}"], *head) for i, k in enumerate(labels) if got[f"n{i}"]]
    names = "split string, n long, phishing_ratio double, dropped_outside_window long, dropped_outside_splits long, features string, window_start string, window_end string, split_mode string"
    return split, spark.createDataFrame(stats, names)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Prepare labelled splits from feeds")
    parser.add_argument("--config")
    parser.add_argument("--data-dir", default="data")
    parser.add_argument("--max-rows", type=int)
    parser.add_argument("--benign-multiplier", type=float)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    config = load_config(spark, args.config)
    config |= {k: v for k, v in (("max_rows", args.max_rows), ("benign_multiplier", args.benign_multiplier)) if v is not None}
    rows, stats = prepare(spark, config, args.data_dir)
    home = resolve(config["output"].get("processed_dir", "processed"), args.data_dir)
    feeds.write_splits(rows, f"{home}/splits")
    feeds.write_document(stats, resolve(config["output"].get("stats_file", f"{home}/dataset_stats"), args.data_dir))


if __name__ == "__main__":
    main()
