"""Threshold-algorithm search against scores computed document by document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quaymark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    docs = [(d, Counter(terms(t))) for d, t in docs if d is not None and terms(t)]
    n_docs, long = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = set()
    for i, own in asked.items():
        found = []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * n_docs // long
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                found.append((-s, d))
        out |= {(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])}
    return out


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["Éa", "x7", "naïve", "ÀB"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(j, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for j in range(n)]
    docs += [(n + j, docs[3][1]) for j in range(40)] + [(5, docs[9][1]), (None, "w1 w2"), (900_001, None), (900_002, ""), (900_003, " .,;!"), (900_004, "w1 " * 30_000 + "w59"), (900_005, "W1-w2_w3@W4")]
    return docs


def items(rng, docs):
    out = [(f"i{j}", " ".join(rng.sample(docs[j][1].split(), min(6, len(docs[j][1].split()))))) for j in range(12)]
    return [*out, ("i0", "w40 w41"), (None, "w1"), ("none", "absent words"), ("empty", ""), ("void", None), ("one", "W59"), ("all", "w0 w1 w2 w3 w4 w5 éa x7 Naïve Àb")]


@pytest.mark.parametrize(("item_bytes", "entries", "k"), [(None, None, 50), (60, 300, 7), (None, 40, 3)])
def test_equals_brute_force(spark, item_bytes, entries, k):
    rng = random.Random(11)
    docs = corpus(rng, 300)
    asked = items(rng, docs)
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, item int, score string").repartition(5)
    b = spark.createDataFrame([(a, b, 0) for a, b in asked], "item_id string, text string, rank int")
    got = [tuple(r) for r in lexical.search(d, b, k, item_bytes, entries).select("item_id", "rank", "doc_id", "score").collect()]
    assert set(got) == brute(docs, asked, k) and len(got) == len(set((a, b) for a, b, *_ in got))


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items_, void = spark.createDataFrame([("q", "a")], "item_id string, text string"), spark.createDataFrame([], "item_id string, text string")
    for d, b in ((none, items_), (one, void), (none, void), (one, items_.selectExpr("item_id", "'' as text"))):
        got = lexical.search(d, b)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_terms_are_compared_not_only_hashed():
    data = np.frombuffer(b"abc abd abc", np.uint8)
    known = lexical.Vocabulary(["abc", "zz"])
    start, end = np.array([0, 4, 8]), np.array([3, 7, 11])
    hit, term = known.find(data, start, end, np.repeat(known.hashes[known.number == 0], 3))  # one hash for all
    assert hit.tolist() == [0, 2] and term.tolist() == [0, 0]


def test_stops_once_the_threshold_is_below():
    """One term whose impact falls steadily: the best are looked up and little more; equal scores are all looked up."""
    n = 5000
    def block(x):
        return lexical.Block(np.arange(n), np.ones(n, np.int64), np.zeros(n, np.int32), x, 1)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    (ids, scores), looked = block(np.arange(n, 0, -1).astype(np.int64)).search(np.array([0]), np.ones(1, bool), empty, 50)
    assert ids.tolist() == list(range(50)) and looked == lexical.FIRST
    (same, _), again = block(np.arange(n, 0, -1).astype(np.int64)).search(np.array([0]), np.ones(1, bool), (ids - n, scores + n), 50)
    assert again == 0 and same.tolist() == (ids - n).tolist()
    (_, _), ties = block(np.full(n, 7, np.int64)).search(np.array([0]), np.ones(1, bool), empty, 50)
    assert ties == n


def test_query_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = {tuple(r) for r in lexical.query(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect()}
    assert got == set(con.execute(lexical.ORACLE).fetchall()) and len(got) > 1000
