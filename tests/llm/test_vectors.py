import numpy as np
import pytest

from quaymark.llm import vectors
from quaymark.llm.common import table


def brute(rows, threshold=0.9):
    """vec_id, links and component of each row, comparing all with all."""
    ok = [i for i, (_, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    x = np.array([rows[i][1] for i in ok], float)
    x /= np.abs(x).max(1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = {i: i for i in range(len(rows))}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(near), strict=True):
        root[top(ok[a])] = top(ok[b])
    links = dict(zip(ok, near.sum(1).tolist(), strict=True))
    least = {}
    for i, (v, _) in enumerate(rows):
        t = top(i)
        least[t] = min((y for y in (least.get(t), v) if y is not None), default=None)
    return [(v, links.get(i, 0), least[top(i)]) for i, (v, _) in enumerate(rows)]


def around(rng, base, cos):
    other = rng.normal(size=len(base))
    other -= other @ base * base
    return cos * base + np.sqrt(1 - cos * cos) * other / np.linalg.norm(other)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [b for b in base] + [around(rng, b, rng.uniform(0.9, 0.99)) for b in base[:500]]
    for b in base[500:504]:  # crowds, tight and loose
        rows += [around(rng, b, 0.99995) for _ in range(60)] + [around(rng, b, 0.96) for _ in range(12)]
    rows = [(i, x.tolist()) for i, x in enumerate(rows)]
    want = brute(rows)
    got = {r["vec_id"]: r for r in vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found, real = sum(r["n_links"] for r in got.values()), sum(w[1] for w in want)
    assert 0.9 * real <= found <= real and all(got[v]["n_links"] <= n for v, n, _ in want)
    single = [got[v]["n_links"] for v, n, _ in want[:500]]
    assert sum(single) >= 0.9 * 500
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_given_vectors(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.link(df).collect()) == sorted(brute(rows))


def test_odd_rows(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(7, a), (3, b), (3, a), (None, a), (5, None), (6, []), (8, [0.0] * 3), (9, [1.0, None, 2.0]), (10, [float("nan")] * 3), (11, [float("inf"), 1.0, 1.0]), (None, [0.0] * 3), (12, [x * 1e300 for x in a]), (13, [3.0, -1.0, 0.0]), (None, [-3.0, 1.0, 5.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, kept string, n_links int")
    got = sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.link(df).collect()], key=str)
    assert got == sorted(brute(rows), key=str)
    assert vectors.link(df.limit(0)).collect() == []


def test_recall_of_longer_substrings(spark, monkeypatch):
    """What a table of millions would get: 22 bits a substring and more of them; links at 0.90 to 0.93, counted one by one."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    cos = rng.uniform(0.901, 0.93, 300)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, cos * base + np.sqrt(1 - cos**2) * other]))]
    bits, count = vectors.tables(3_000_000)
    assert bits == 22 and count > vectors.TABLES and vectors.tables(50_000) == (vectors.SUBSTRING, vectors.TABLES)
    monkeypatch.setattr(vectors, "tables", lambda n: (bits, count))
    got = {r["vec_id"]: r for r in vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[300 + i]["component_id"] == i for i in range(300)) >= 0.9 * 300


@pytest.mark.parametrize(("dims", "mean"), [(64, 0.5), (64, 0.7), (384, 0.5), (384, 0.7)])
def test_recall_with_a_common_mean(spark, dims, mean):
    """Unrelated vectors at a cosine of 0.5 or 0.7, as text embeddings have; links at 0.90 to 0.93, counted one by one."""
    rng = np.random.default_rng(dims)
    shared, own = rng.normal(size=dims), rng.normal(size=(700, dims))
    base = np.sqrt(mean) * shared / np.linalg.norm(shared) + np.sqrt(1 - mean) * own / np.linalg.norm(own, axis=1)[:, None]
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [(i, x.tolist()) for i, x in enumerate([*base, *[around(rng, b, rng.uniform(0.901, 0.93)) for b in base[:500]]])]
    want = {v: n for v, n, _ in brute(rows)}
    got = {r["vec_id"]: r["n_links"] for r in vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 0 and all(got[v] <= n for v, n in want.items())
