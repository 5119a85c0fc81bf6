"""Pruned similarity joins against all pairs, and what share of the pairs they look at."""

import numpy as np
import pytest

from quaymark.operators import similarity

SCHEMA = "vec_id long, embedding array<float>, label string"


def clustered(rng, n, centres, spread, dims=24):
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, dims))
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    return clustered(rng, 900, centres, 0.12), clustered(rng, 700, centres, 0.12)


def frame(spark, x, extra=()):
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(10_000 + i, v, "odd") for i, v in enumerate(extra)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [None, [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, []]


@pytest.mark.parametrize("chunk", [None, 150, 60])
def test_equals_all_pairs_and_skips_most(spark, vectors, chunk):
    q, c = vectors
    exact = (q / np.linalg.norm(q.astype(float), axis=1, keepdims=True)) @ (c / np.linalg.norm(c.astype(float), axis=1, keepdims=True)).T
    corpus = frame(spark, c, ODD).withColumnRenamed("vec_id", "id")
    got = {r["vec_id"]: r for r in similarity.best_match(frame(spark, q, ODD), corpus, chunk).collect()}
    assert len(got) == len(q) + len(ODD) and all(got[10_000 + i]["best"] is None for i in range(len(ODD)))
    assert max(abs(got[i]["best"] - exact[i].max()) for i in range(len(q))) < 1e-7
    share = sum(r["compared"] for r in got.values()) / exact.size
    assert share < {None: 0.25, 150: 0.6, 60: 0.8}[chunk], share
    for threshold in (0.75, 0.98):
        pairs = {(r["vec_id"], r["id"]) for r in similarity.similar(frame(spark, q, ODD), corpus, threshold, chunk).collect()}
        sure, maybe = set(zip(*np.nonzero(exact >= threshold + 1e-7), strict=True)), set(zip(*np.nonzero(exact >= threshold - 1e-7), strict=True))
        assert sure <= pairs <= maybe and sure


def test_vectors_without_structure_and_repeated_ones(spark):
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(300, 24)).astype(np.float32), rng.normal(size=(120, 24)).astype(np.float32)
    c[50:90] = c[0]
    exact = (q / np.linalg.norm(q.astype(float), axis=1, keepdims=True)) @ (c / np.linalg.norm(c.astype(float), axis=1, keepdims=True)).T
    got = similarity.best_match(frame(spark, q), frame(spark, c).withColumnRenamed("vec_id", "id")).collect()
    assert all(abs(r["best"] - exact[r["vec_id"]].max()) < 1e-7 for r in got)


def test_empty_tables(spark, vectors):
    none, some = spark.createDataFrame([], SCHEMA), frame(spark, vectors[0][:3])
    as_corpus = lambda df: df.withColumnRenamed("vec_id", "id")
    assert [r["best"] for r in similarity.best_match(some, as_corpus(none)).collect()] == [None] * 3 and similarity.best_match(none, as_corpus(some)).count() == 0
    assert similarity.similar(some, as_corpus(none), 0.5).count() == 0 == similarity.similar(none, as_corpus(some), 0.5).count()
