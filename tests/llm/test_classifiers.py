import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quaymark.llm import language, quality, toxicity
from quaymark.llm.common import table, text_view

ODD = [(1, "A short clean line of words.", "en"), (None, None, None), (2, "", "en"), (3, " \n\t", "xx"), (4, "12 !? 99", "fr"), (4, "12 !? 99", "fr"), (5, "word " * 40000, "en"), (6, "Я 漢字", None)]


def odd(spark):
    return spark.createDataFrame([(*r, 0.5, 7) for r in ODD], "doc_id long, text string, lang string, score double, x int")


def held(doc_id, parts, which):
    return zlib.crc32(str(doc_id).encode()) % parts == which


def shares(spark, rows, sf_dir, label):
    truth = {r["doc_id"]: r[label] for r in table(spark, sf_dir, "labels").collect()}
    own = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return np.mean([a == b for a, b in own]), len(own)


@pytest.fixture(scope="module")
def sf01():
    return "/root/testdata/sf0.01"


def test_quality_held_out(spark, sf01):
    rows = quality.query(spark, sf01).collect()
    right, n = shares(spark, rows, sf01, "quality")
    assert n > 100 and right > 0.97
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_quality_density_is_gaussian():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = [rng.normal(c, 1 + c, (400, d)) for c in (0, 1)]
    model = quality.Quadratic({c: (400, v.sum(0), v.T @ v) for c, v in enumerate(x)}, pooled=0, diagonal=0, floor=0)
    lam = d / (d + 400)
    cov = [np.cov(v.T, bias=True) for v in x]
    both = (cov[0] + cov[1]) / 2
    want = []
    for v, s in zip(x, cov, strict=True):
        s = (1 - lam) * s + lam * both
        diff = x[0][:5] - v.mean(0)
        want.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(s), diff) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.score(x[0][:5]), 1 / (1 + np.exp(want[0] - want[1])))


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (5, 0), (5, 0), (4, 1), (99, 1)], "doc_id long, quality int")
    rows = quality.classify(odd(spark), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.classify(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(odd(spark).limit(0), labels).collect() == []


def tree_cost(train, text, order):
    """Bits of text by the definition, byte by byte."""
    seen = [Counter() for _ in range(order + 1)]
    for t in train:
        t = b"\0" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[k][t[i - k : i + 1]] += 1
    bits = 0.0
    text = b"\0" * order + text
    for i in range(order, len(text)):
        for k in range(order, -1, -1):
            near = {g: c for g, c in seen[k].items() if g[:-1] == text[i - k : i]}
            if not near:
                continue
            n, q, c = sum(near.values()), len(near), near.get(text[i - k : i + 1])
            if c:
                bits -= math.log2(c / (n + q))
                break
            bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [1, 3])
def test_code_lengths(order):
    train = [b"the cat sat", b"that hat", b"a", "été".encode()]
    texts = ["the hat", "", "zebra", "t", "été that", "aa"]
    data, off = text_view(pa.array(train, pa.binary()).cast(pa.string()))
    keys, n = np.unique(language.grams(data, off, order), return_counts=True)
    model = language.Languages({"x": language.ContextTree(keys, n, order)}, order)
    got = model.lengths(*text_view(pa.array(texts)))[:, 0]
    assert np.allclose(got, [tree_cost(train, t.encode(), order) for t in texts])


def test_language_held_out(spark, sf01):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf01, "documents").collect()}
    rows = language.query(spark, sf01).collect()
    own = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and np.mean(own) > 0.95
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) for r in rows)


def test_language_odd_rows(spark):
    model = language.fit(odd(spark))
    got = sorted([tuple(r) for r in language.identify(odd(spark), model).collect()], key=str)
    assert [r[1] for r in got if r[0] in (None, 2, 3, 4)] == ["und"] * 5 and all(0 <= r[2] <= 1 for r in got)
    assert {r[1] for r in got if r[0] in (1, 5)} == {"en"}
    none = language.fit(odd(spark).limit(0))
    assert {r[1] for r in language.identify(odd(spark), none).collect()} == {"und"}


def test_toxicity_held_out(spark, sf01):
    rows = toxicity.query(spark, sf01).collect()
    right, n = shares(spark, rows, sf01, "toxic")
    assert n > 70 and right > 0.85
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_pools_are_maxima():
    net = toxicity.Net()
    text = pa.array(["one two three four", "", None, "ÉTÉ two", "!!"])
    ids, codes, doc = toxicity.tokens(text)
    pools, _ = net.pool(ids, codes, doc, len(text))
    for i, t in enumerate(text.to_pylist()):
        own_ids, own, _ = toxicity.tokens(pa.array([t or ""]))
        e = net.p["E"][own_ids].sum(1)[own] if len(own) else np.zeros((0, toxicity.DIM))
        for j, w in enumerate(toxicity.WIDTHS):
            padded = np.vstack([e, np.zeros((w, toxicity.DIM))])
            act = [sum(padded[p + k] @ net.p[f"W{w}{k}"] for k in range(w)) for p in range(len(e))]
            want = np.maximum(np.max(act, axis=0) + net.p[f"b{w}"], 0) if act else np.zeros(toxicity.FILTERS)
            assert np.allclose(pools[i, j * 8 : j * 8 + 8], want, atol=1e-5)


def test_toxicity_odd_rows(spark):
    none = language.Languages({}, 3)
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, None), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert len(toxicity.score(docs, toxicity.fit(docs, labels, none), none).collect()) == len(ODD)
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0), none), none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels, none), none).collect() == []


def test_toxicity_gradients_equal_finite_differences():
    net = toxicity.Net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["b2"][:] = 0.02
    text, y, weight = pa.array(["one two three four", "five one", "", "two two six seven eight"]), np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.5])
    ids, codes, doc = toxicity.tokens(text)

    def loss():
        act = [np.zeros((4, 0))]
        e = net.p["E"][ids].sum(1)[codes]
        for w in toxicity.WIDTHS:  # in double precision
            own = np.zeros((4, toxicity.FILTERS))
            for i in range(4):
                x = np.vstack([e[doc == i], np.zeros((w, toxicity.DIM))])
                n = (doc == i).sum()
                if n:
                    own[i] = np.maximum(np.max([sum(x[p + k] @ net.p[f"W{w}{k}"] for k in range(w)) for p in range(n)], axis=0) + net.p[f"b{w}"], 0)
            act.append(own)
        z = np.hstack(act) @ net.p["out"] + net.p["bias"]
        return float((weight * (np.log1p(np.exp(z)) - y * z)).mean())

    grads, rows, ge = net.gradients(ids, codes, doc, y, weight)
    rng = np.random.default_rng(0)
    for k in grads:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in net.p[k].shape)
            near(net.p[k], at, loss, grads[k][at])
    for r in range(0, len(rows), 5):
        for d in range(0, toxicity.DIM, 3):
            near(net.p["E"], (rows[r], d), loss, ge[r, d])


def near(x, at, loss, want, h=1e-5):
    old = x[at]
    x[at] = old + h
    up = loss()
    x[at] = old - h
    down = loss()
    x[at] = old
    assert abs((up - down) / (2 * h) - want) < 1e-5 + 1e-3 * abs(want)


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    """A word that is toxic in few of many rows counts; every labelled row of a larger table moves the net."""
    monkeypatch.setattr(toxicity, "SHARD", 2000)
    plain, none = "the quick brown fox number{} jumps over lazy dogs", language.Languages({}, 3)
    rows = [(i, plain.format(i) + (f" vile{i}" if i % 2 else "")) for i in range(7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7000)], "doc_id long, toxic int")
    net, start = toxicity.fit(docs, labels, none), toxicity.Net()
    moved = np.flatnonzero((net.p["E"] != start.p["E"]).any(1))
    ids, _, _ = toxicity.tokens(pa.array([f"vile{i}" for i in range(1, 7000, 2)]))
    assert np.isin(ids[:, 0], moved).mean() > 0.95
    again = toxicity.fit(docs.repartition(3), labels, none)
    assert all((net.p[k] == again.p[k]).all() for k in net.p) and net.cut == again.cut


def shuffled(spark, work):
    """What work gives, with the records and bytes that its stages have written to shuffles."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {x.stageId(): (x.shuffleWriteRecords(), x.shuffleWriteBytes()) for x in map(found.apply, range(found.size()))}

    before = max(stages(), default=-1)
    return work(), *np.sum([x for k, x in stages().items() if k > before], axis=0)


def test_toxicity_moves_do_not_grow_with_shards(spark, monkeypatch):
    """Four times the shards on as many tasks send hardly more moves, and each shard is still trained on by itself."""
    monkeypatch.setattr(toxicity, "STEPS", 1)
    none, n = language.Languages({}, 3), 64 * 40
    docs = spark.createDataFrame([(i, f"plain words of number{i % 7}" + " vile" * (i % 2)) for i in range(n)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
    sent, nets = [], []
    for shard in (n // 16, n // 64):
        monkeypatch.setattr(toxicity, "SHARD", shard)
        net, records, _ = shuffled(spark, lambda: toxicity.fit(docs, labels, none))
        nets.append(net)
        sent.append(records)
    assert sent[1] < 1.5 * sent[0]
    monkeypatch.setattr(toxicity, "RUN", 1)  # a task a shard
    alone = toxicity.fit(docs, labels, none)
    assert all((nets[1].p[k] == alone.p[k]).all() for k in alone.p) and (nets[0].p["E"] != nets[1].p["E"]).any()


def test_toxicity_shards_shuffle_packed_texts_once(spark):
    """Fewer bytes are shuffled than the shards' words take; each label of each row has its words, language and shard."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(2, 12, 3000)]
    texts = [" ".join(rng.choice(vocabulary, 150)) for _ in range(600)]
    rows = [*enumerate(texts), (3, texts[9]), (None, "no id"), (700, None), (701, "Ü 漢字 é"), (900, "no label")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [*((i, i % 2) for i in range(600)), (3, 0), (700, 1), (701, 0), (5000, 1)]
    truth = spark.createDataFrame(labels, "doc_id long, y int")
    out, _, size = shuffled(spark, lambda: toxicity.shards(docs, truth, language.Languages({}, 3), 4 * toxicity.SHARD))
    assert size < out.selectExpr("sum(length(words))").first()[0]
    got = out.withColumn("part", toxicity.F.spark_partition_id()).collect()
    assert sorted((r["doc_id"], r["y"]) for r in got) == sorted((i, y) for i, _ in rows for j, y in labels if i == j)
    assert len({r["shard"] for r in got}) == 4 == len({(r["shard"], r["part"]) for r in got})
    words = {tuple(codes) for _, codes in toxicity._read(out.where("doc_id = 3").toArrow().to_batches())[0]}
    assert words == {tuple(toxicity.tokens(pa.array([t]))[1]) for t in (texts[3], texts[9])}


def test_toxicity_thresholds_count_every_row():
    """The best F1 by brute force over all bins."""
    rng = np.random.default_rng(3)
    y = rng.random(5000) < 0.1
    place = np.minimum((np.clip(rng.normal(0.3 + 0.3 * y, 0.2), 0, 1) * toxicity.BINS).astype(int), toxicity.BINS - 1)
    at, of = np.unique(place, return_inverse=True)
    net = toxicity.Net()
    net.calibrate({"x": (at, np.bincount(of), np.bincount(of, y))})
    f1 = lambda t: 2 * (y & (place >= t)).sum() / ((place >= t).sum() + y.sum())
    assert f1(net.cut["x"] * toxicity.BINS) == max(f1(t) for t in at) and net.cut[""] == net.cut["x"]


def test_language_counts_every_text(spark):
    """More texts of a language than a sample would hold, in several partitions: counts of all of them."""
    rows = [(i, f"text {i} of {i * 7919 % 5000}", "en") for i in range(5000)] + [(9000, "ein text", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    data, off = text_view(pa.array([t for _, t, x in rows if x == "en"]))
    keys, n = np.unique(language.grams(data, off, 3), return_counts=True)
    own = language.ContextTree(keys, n, 3)
    tree = language.fit(docs).trees[1]
    assert all(np.array_equal(a, b) for x, y in zip(own.levels, tree.levels, strict=True) for a, b in zip(x, y, strict=True))
