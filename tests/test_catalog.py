"""Every query with SQL gives DuckDB's rows; the others have tests of their own below."""

import datetime
import math
import os
import zlib

import duckdb
import pytest

import __spark_entry__
from quaymark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return f"{v:.6g}" if not math.isnan(v) else "nan"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return f"{float(v):.6g}" if abs(float(v)) < 1e6 else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.isdir("/root/testdata/sf0.001")


def test_text_statistics(spark, sf_dir):
    texts = {r["item_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    for r in catalog.QUERIES["text_statistics"](spark, sf_dir).collect():
        b = texts[r["item_id"]]
        assert r["compression"] == round(len(zlib.compress(b)) / len(b), 6)


def test_stream_sessions_are_the_closed_ones(spark, sf_dir):
    closed = {(r["user_id"], r["start"], r["n"]) for r in catalog.QUERIES["stream_sessions"](spark, sf_dir).collect()}
    batch = {(r["user_id"], r["start"], r["n"]) for r in catalog.QUERIES["sessions"](spark, sf_dir).collect()}
    assert closed <= batch and len(batch) - len(closed) < 10


@pytest.mark.parametrize("name", ["logistic_metrics", "forest_metrics", "model_ablations"])
def test_models(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).collect()
    assert got[0]["accuracy"] > 0.9 and all(0 <= r["roc_auc"] <= 1 for r in got)
