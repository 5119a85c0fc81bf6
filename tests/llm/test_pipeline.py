import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaymark.llm import decontam, neardup, packing, pii, quality
from quaymark.llm.common import table


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def similarity(a, b, k=5):
    a, b = ({tuple(x.lower().split()[i : i + k]) for i in range(len(x.split()) - k + 1)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies(spark):
    rng = random.Random(8)
    base, docs, copies = [words(rng, rng.randrange(60, 400)) for _ in range(120)], [], 0
    for i, w in enumerate(base):
        docs.append((10 * i, " ".join(w)))
        for j in range(1, 3):
            v = list(w)
            for _ in range(max(1, len(w) // 100)):
                v[rng.randrange(len(v))] = "changed"
            if similarity(" ".join(w), " ".join(v)) >= 0.8:
                docs.append((10 * i + j, " ".join(v).upper()))
                copies += 1
    for i in range(0, 1200, 40):  # too far away
        w = docs[0][1].split() if not i else next(t for d, t in docs if d == i).split()
        v = [x if k % 14 else "other" for k, x in enumerate(w)]
        assert similarity(" ".join(w), " ".join(v)) < 0.7
        docs.append((10**7 + i, " ".join(v)))
    docs += [(1, docs[0][1]), (10**6, docs[3][1]), (None, docs[0][1])]
    kept = neardup.dedup(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, f0 int")).collect()
    assert {10 * i for i in range(120)} <= {r["doc_id"] for r in kept}
    assert sum(r["doc_id"] is not None and r["doc_id"] >= 10**7 for r in kept) >= 29
    assert len([r for r in kept if r["doc_id"] is None or r["doc_id"] < 10**7]) - 120 <= 0.05 * copies


def test_odd_rows(spark):
    docs = [(3, None), (2, ""), (None, " "), (5, "one two"), (5, "one two"), (None, "lonely words here"), (7, "word " * 30000)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, nd_0 int, id int")
    kept = neardup.dedup(df).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [2, 5, 7, None]
    assert neardup.dedup(df.limit(0)).collect() == []
    clash = df.withColumnsRenamed({"nd_0": "nd_id", "id": "nd_doc"}).withColumn("a.b", F.lit(3)).withColumn("keys", F.lit(4))
    rows = neardup.dedup(clash).collect()
    assert rows[0].asDict().keys() == {*clash.columns} and {tuple(r)[2:] for r in rows} == {(1, 2, 3, 4)}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory, sf_dir):
    home, docs, out = tmp_path_factory.mktemp("stages"), table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        after = spark.read.parquet(f"{home}/{k}")
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_columns_and_rows(stages):
    for before, after, names, new in stages[:-1]:
        assert names == new and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    assert [len(a) for _, a, _, _ in stages[2:4]] == [len(stages[1][1])] * 2


def test_quality_stage(spark, sf_dir, stages):
    before, after, _, _ = stages[0]
    truth = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    left = {r["doc_id"] for r in after}
    right = [truth[r["doc_id"]] == (r["doc_id"] in left) for r in before if r["doc_id"] in truth]
    assert sum(right) / len(right) > 0.97


def test_copy_stage(stages):
    before, after, _, _ = stages[1]
    text = {r["doc_id"]: r["text"] for r in before}
    least = {}
    for d, t in text.items():
        least[t] = min(d, least.get(t, d))
    left = {r["doc_id"] for r in after}
    assert all(d not in left for d, t in text.items() if d != least[t])
    assert len(left) > 0.5 * len(least)


def test_text_stages(spark, sf_dir, stages):
    items = table(spark, sf_dir, "benchmark")
    cut = spark.createDataFrame([(r["doc_id"], r["text"]) for r in stages[2][1]], "doc_id long, text string")
    assert not any(r["contaminated"] for r in decontam.report(cut, items).collect())
    new = spark.createDataFrame([(r["doc_id"], r["text"]) for r in stages[3][1]], "doc_id long, text string")
    found = lambda rows: {m for r in rows for m in __import__("re").findall(pii._EMAIL + "|" + pii._IP, r["text"])}
    assert new.count() and found(stages[3][0]) and not found(stages[3][0]) & found(stages[3][1])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3][1])


def test_packed_stage(spark, sf_dir, stages):
    enc = packing.Encoder(packing.vocabulary())
    want = {r["doc_id"]: len(enc.encode(r["text"])) // 4 + 1 for r in stages[4][0]}
    got = {}
    for r in stages[4][1]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    assert corpus_pipeline.run(spark, sf_dir).count() == len(stages[4][1])
    assert quality.NAMES and corpus_pipeline.ORACLE_SQL is None
