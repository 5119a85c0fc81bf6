import random
import re

import xxhash

from quaymark.llm import simhash
from quaymark.llm.components import components


def fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_fingerprints(spark):
    texts = ["", None, " \t\n", "One", "one two", "one  TWO three", "a b c d e f g", "é x y\x1c z", "word " * 50000, "one  TWO three", "ÀB c\x0bd e"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(df).collect()}
    assert got == {i: fingerprint(t) for i, t in enumerate(texts)}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(900, x) for x in range(901, 1000)] + [(7, 7), (None, 3)]
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = roots({x for e in real for x in e}, real)
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_links_lose_nothing(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for base in list(prints)[:6]:  # crowds with chains in them
        for _ in range(120):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))))
    prints = [x - (1 << 64) if x >> 63 else x for x in prints]
    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 2]
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    want = roots(prints, near)
    for crowd in (8, 10**6):
        got = {r["node"]: r["root"] for r in components(simhash.links(df, crowd=crowd)).collect()}
        assert {x: got.get(x, x) for x in prints} == want


def test_group(spark):
    rows = [(5, "a b c d"), (3, "A B  c d"), (3, "a b c d"), (None, "a b c d"), (9, ""), (8, None), (None, "x y z w"), (2, "p q r s")]
    got = simhash.group(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int")).collect()
    assert sorted([(r["doc_id"], r["component_id"]) for r in got], key=str) == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (None, None), (2, 2)], key=str)
    assert simhash.group(spark.createDataFrame([], "doc_id long, text string")).collect() == []
