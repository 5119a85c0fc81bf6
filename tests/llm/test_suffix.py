import hashlib
import random
import tempfile

import numpy as np
import pyarrow as pa
import pytest

from quaymark.llm import bitmap, induced, suffix
from quaymark.llm.common import table


def order(text, cap, held):
    with tempfile.TemporaryDirectory() as folder:
        blocks = induced.suffixes(np.array(text, np.uint16), cap, folder, held)
        return [pair for at, shared in blocks for pair in zip(at.tolist(), shared.tolist(), strict=True)]


@pytest.mark.parametrize("block", [3, 1 << 16])
@pytest.mark.parametrize("held", [1, 8, 1000])
def test_suffix_order(held, block, monkeypatch):
    """Blocks and queues smaller than the text; names that repeat go to disk-backed queues where held is 1."""
    monkeypatch.setattr(induced, "_BLOCK", block)
    rng = random.Random(1)
    for turn in range(150):
        n = rng.randrange(0, 70)
        t = [rng.randrange(rng.choice([1, 2, 3, 9]) + 1) for _ in range(n)] * (1 + 2 * (turn % 3 == 0))
        n = len(t)
        got = order(t, 5, held)
        assert [p for p, _ in got] == sorted(range(n), key=lambda i: t[i:])
        for (p, _), (q, shared) in zip(got, got[1:], strict=False):
            k = 0
            while k < 5 and max(p, q) + k < n and t[p + k] == t[q + k]:
                k += 1
            assert shared == k


def test_values_are_carried(monkeypatch):
    """Only seeds are compared with the text symbol by symbol."""
    rng = random.Random(2)
    piece = [rng.randrange(1, 27) for _ in range(300)]
    t = [x for _ in range(20) for x in [*piece[rng.randrange(100) :], 0]]
    compared, plain = [], induced._shared
    monkeypatch.setattr(induced, "_shared", lambda text, one, other, cap: compared.append(len(one)) or plain(text, one, other, cap))
    got = order(t, 50, 64)
    assert [p for p, _ in got] == sorted(range(len(t)), key=lambda i: t[i:])
    assert sum(compared) < len(t) / 2
    assert sum(shared == 50 for _, shared in got) > len(t) / 2


def brute(docs, size=50):
    last = 1 << 63
    first = {}
    for d, t in docs:
        b, key = (t or "").encode(), last if d is None else d
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            first[w] = min(first.get(w, last), key)
    out = []
    for d, t in docs:
        b, key = (t or "").encode(), last if d is None else d
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < key:
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_matches_brute_force(spark):
    rng = random.Random(6)
    line = lambda n: "".join(rng.choice("ab cé") for _ in range(n))
    a, b = line(120), line(70)
    docs = [(3, a), (1, "x" + a[20:100] + b), (1, a), (None, a), (None, b + b), (7, b[:49]), (8, b[:50]), (9, None), (10, ""), (11, "z" * 400), (12, "z" * 90), (5, a + b), (5, a + b), (13, line(3000) + a), (14, a[:60] + "!" + a[60:]), (15, "\0" * 60), (16, "\0" * 60)]
    docs += [(20 + i, line(rng.randrange(200)) + rng.choice([a, b, ""]) + line(rng.randrange(200))) for i in range(40)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, m int, start int")
    assert rows(suffix.dedup(df)) == brute(docs)
    assert rows(suffix.dedup(df, shard_bytes=2000, held=64)) == brute(docs)
    assert rows(suffix.dedup(df, shard_bytes=1 << 30, held=64)) == brute(docs)  # eight shards of far more than held
    kept = suffix.dedup(df, keep_text=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in kept)
    assert suffix.dedup(df.limit(0)).collect() == []


def made(texts, seed=4):
    """Documents of phrases of few words, so that many windows are shared in part; some are copies, and ids repeat."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9))) for _ in range(12)]
    phrases = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(8)]
    docs = [(rng.randrange(texts), " ".join(rng.choice(phrases) for _ in range(rng.randrange(1, 6)))) for _ in range(texts)]
    return docs + [(texts + i, docs[i % 7][1]) for i in range(20)]


def test_full_bit_maps(spark, monkeypatch):
    """Bit maps that let nearly all runs pass change no result: a copy's run may pass before that of its first document."""
    docs = made(60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(bitmap, "PLACES", 8)
    monkeypatch.setattr(bitmap, "MOST", 8)
    assert bitmap.places(10**9) == 8
    assert rows(suffix.dedup(df)) == brute(docs)


def test_maps_follow_the_input():
    """A map of a fixed size is full at some size, and then all runs are shuffled and sorted."""
    assert bitmap.places(10**5) == bitmap.PLACES
    for n in (2 * 10**6, 10**7):
        assert 1 / 32 <= n / 2 ** bitmap.places(n) <= 1 / 16
    assert bitmap.places(10**12) == bitmap.MOST


def test_only_runs_that_meet_are_sorted(spark, monkeypatch):
    """Runs of one minimizer that differ on both of its sides share no window: sorting all of them took a third of the work."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    common, tail = word(22), word(60)
    docs = [(i, word(60) + common + word(60)) for i in range(12)]  # apart
    met = [(100 + i, word(60) + common + tail) for i in range(3)]  # equal from the common piece on
    taken, plain = [], suffix._sorted

    def counted(distinct, *a):
        taken.extend(bytes(r["seg"]).decode() for r in distinct.collect())
        return plain(distinct, *a)

    monkeypatch.setattr(suffix, "_sorted", counted)
    for some in (docs, docs + met):
        taken.clear()
        assert rows(suffix.dedup(spark.createDataFrame(some, "doc_id long, text string"))) == brute(some)
        assert not any(s in t for s in taken for _, t in docs)
    assert taken


def test_minimizer_sides(spark):
    """Against brute force: runs that end near the minimizer, and those that have its piece more than once."""
    rng = random.Random(7)
    period = "abcdefghijklmnopqrstuvw"
    docs = made(80) + [(200 + i, period * rng.randrange(1, 9) + made(7, i)[0][1][: rng.randrange(60)]) for i in range(12)]
    for n in range(50, 80, 3):
        docs += [(300 + n, docs[3][1][10 : 10 + n]), (400 + n, docs[5][1][:n] + docs[3][1][:n])]
    assert rows(suffix.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute(docs)


@pytest.mark.parametrize("n", [0, 3, 15, 20, 49, 50])
def test_one_short_text(spark, n):
    docs = [(1, "x" * n)]
    assert rows(suffix.dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_equal_runs_are_one_row():
    """Equal runs of a task are one row before they are shuffled, with their least and greatest document."""
    got = suffix._grouped(np.array([[1, 7, 5, 5, 3], [2, 8, 4, 4, 1], [1, 7, 2, 9, 3], [1, 7, 6, 6, 3]]))
    assert sorted(got.tolist()) == [[1, 7, 2, 9, 3], [2, 8, 4, 4, 1]]


def test_repeated_segments():
    """A segment that comes twice is sorted once, with its least document, whichever comes first."""
    one, other = b"x" + bytes(range(60)), b"y" + bytes(range(60))
    with tempfile.TemporaryDirectory() as folder:
        shard = suffix.Shard(folder, 50, 64)
        for sh, seg, lo, hi in [(1, one, 8, 8), (2, other, 5, 5), (1, one, 3, 4), (1, one, 9, 9)]:
            shard.add(pa.array([7]), pa.array([sh]), pa.array([seg], pa.binary()), pa.array([lo]), pa.array([hi]))
        assert shard.file.size == 2 * 62
        got = {r["sh"]: [tuple(x.values()) for x in r["lost"]] for b in shard.results() for r in b.to_pylist()}
    assert got == {1: [(0, 12, 3)], 2: [(1, 11, 3)]}


def test_spans_of_a_text_across_batches(spark):
    spans = [(d, th, s) for d in range(3) for th in (d, -1) for s in range(700 * d + 1)]
    got = suffix._by_text(spark.createDataFrame(spans, "doc long, th long, span long").repartition(7)).collect()
    assert sorted((r["doc"], r["th"], r["spans"]) for r in got) == sorted((d, th, list(range(700 * d + 1))) for d in range(3) for th in (d, -1))


def test_few_bytes_are_many_small_shards(spark, monkeypatch):
    """What tasks sort at once is on disk: a few large shards of a small table took more of it than the table allows."""
    dealt, plain = [], suffix._sorted
    monkeypatch.setattr(suffix, "_sorted", lambda distinct, shards, *a: dealt.append(shards) or plain(distinct, shards, *a))
    rng = random.Random(3)
    a = "".join(rng.choice("abcd ") for _ in range(400))
    docs = [(i, a[rng.randrange(100) : 300 + rng.randrange(100)]) for i in range(20)]
    assert rows(suffix.dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert dealt and min(dealt) >= 24


def test_merged_spans():
    spans = np.sort(np.array([s << suffix._LENGTH | n for s, n in [(0, 50), (10, 40), (60, 50), (60, 50), (110, 60), (120, 5), (171, 50)]]))
    assert suffix.merged(spans) == [(0, 50), (60, 170), (171, 221)] and suffix.merged(spans[:0]) == []


def test_rank():
    places = np.array([0, 3, 63, 64, 200])
    less, among = induced.Rank(places, 201)(np.arange(201))
    assert less.tolist() == np.searchsorted(places, np.arange(201)).tolist() and np.flatnonzero(among).tolist() == places.tolist()


def test_given_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id < 1000000")
    assert rows(suffix.dedup(docs)) == brute([tuple(r) for r in docs.collect()])
