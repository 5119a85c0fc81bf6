import random

import pytest

from quaymark.llm import neardup


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8))) for _ in range(n)]


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def expected(docs):
    """The smallest id of each component of all pairs at 0.8 or more."""
    up = {d: d for d, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {d: shingles(t) for d, t in docs}
    for i, (a, _) in enumerate(docs):
        for b, _ in docs[:i]:
            x = len(sets[a] & sets[b])
            if 5 * x >= 4 * (len(sets[a]) + len(sets[b]) - x):
                a2, b2 = top(a), top(b)
                up[max(a2, b2)] = min(a2, b2)
    return {top(d) for d, _ in docs}


def kept(spark, docs):
    return {r["doc_id"] for r in neardup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


@pytest.fixture(scope="module")
def rng():
    return random.Random(11)


def test_replaced_and_appended_passages(spark, rng):
    """Pairs at 0.80 to 0.85 all link; pairs just below 0.8 don't."""
    docs = []
    for i in range(60):
        w = words(rng, rng.randrange(150, 600))
        n = len(w)
        cut = round(n * (0.17 if i % 2 else 0.105))
        other = [*w, *words(rng, round(n * 0.23))] if i % 2 else [*w[: n // 3], *words(rng, cut - 5), *w[n // 3 + cut - 5 :]]
        assert 0.8 <= similarity(" ".join(w), " ".join(other)) < 0.86
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    for i in range(60, 90):
        w = words(rng, rng.randrange(200, 500))
        other = [*w, *words(rng, round(len(w) * 0.27))]
        assert 0.76 < similarity(" ".join(w), " ".join(other)) < 0.8
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    assert kept(spark, docs) == {2 * i for i in range(60)} | set(range(120, 180))


def changed(rng, w, k):
    v = list(w)
    for i in rng.sample(range(len(v)), k):
        v[i] = "x" + "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    return v


def test_bridged_crowds(spark, rng):
    """Two crowds joined only by one close pair, neither of which is near both."""
    docs = []
    for g in range(4):
        w, new = words(rng, 400), words(rng, 80)
        at = lambda k: w[: 100] + new[:k] + w[100 + k :]  # noqa: B023, E731
        docs += [(1000 * g + i, " ".join(changed(rng, at(0), 1))) for i in range(40)]
        docs += [(1000 * g + 100 + i, " ".join(changed(rng, at(80), 1))) for i in range(40)]
        docs += [(1000 * g + 200, " ".join(at(22))), (1000 * g + 201, " ".join(at(58)))]
    assert expected(docs) == {0, 1000, 2000, 3000}
    assert kept(spark, docs) == expected(docs)
    apart = [d for d in docs if d[0] % 1000 != 201]
    assert kept(spark, apart) == expected(apart) and len(expected(apart)) == 8


def test_stars_of_any_size(spark, rng):
    """Copies at 0.80 to 0.84 of one text, far from each other, are linked to it in groups of 3 as of 80."""
    docs = []
    for g, size in enumerate((3, 10, 30, 80)):
        w = words(rng, 400)
        docs.append((1000 * g, " ".join(w)))
        for i in range(1, size):
            at = rng.randrange(0, 350)
            docs.append((1000 * g + i, " ".join([*w[:at], *words(rng, 38), *w[at + 38 :]])))
            assert 0.8 <= similarity(docs[-1][1], " ".join(w)) < 0.84
    assert kept(spark, docs) == expected(docs) == {0, 1000, 2000, 3000}


def test_repeated_lines_are_no_copies(spark, rng):
    """Documents that share one often repeated line but little else all stay."""
    line = words(rng, 12)
    docs = [(i, " ".join([*line * 60, *words(rng, 40), *line])) for i in range(50)]
    docs += [(100 + i, " ".join([*words(rng, 300)[: 260 + i], *line])) for i in range(3)]
    assert expected(docs) == {d for d, _ in docs}
    assert kept(spark, docs) == expected(docs)


def test_all_pairs_of_mixed_documents(spark, rng):
    """2,000 documents, similarities from 0 to 1 and shared passages: the same rows as by comparing all pairs."""
    passages, docs = [words(rng, 60) for _ in range(6)], []
    base = [words(rng, rng.randrange(20, 120)) for _ in range(400)]
    for i in range(2000):
        w = list(base[i % 400] if i % 3 else base[i % 7])
        if i % 5 == 0:
            w = [*passages[i % 6], *w[: rng.randrange(1, 20)]]
        docs.append((i, " ".join(changed(rng, w, min(len(w), rng.randrange(0, 3))))))
    assert kept(spark, docs) == expected(docs)
