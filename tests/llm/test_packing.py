import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quaymark.llm import packing
from quaymark.llm.common import table

PATH = packing.vocabulary()


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def test_encoder_is_the_tokenizer(spark, sf_dir, encoder):
    plain = Tokenizer.from_file(PATH)
    texts = [r["text"] for r in table(spark, sf_dir, "documents").collect()]
    rng = random.Random(1)
    signs = packing._PLAIN + "'''<|>  \n\t aAbBsStTßÉé09½" * 3 + "İǅǈ漢я́ﬁ \x1c"
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["it's we'll 'story I'D <|endoftext|> x", "a<|startoftext|>b", "\x85\xa0\x1c x", ""]
    for t in texts:
        assert encoder.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def fewest(lengths, capacity):
    """By trying every bin for every item."""
    best = [len(lengths)]
    order = sorted(lengths, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(order):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= order[i]:
                more = list(rooms)
                more[more.index(r)] -= order[i]
                go(i + 1, more)
        go(i + 1, [*rooms, capacity - order[i]])

    go(0, [])
    return best[0]


def check_plan(plan, counts):
    used = np.zeros(len(counts), int)
    for items, times in plan:
        assert sum(items) <= len(counts) - 1 and times > 0
        for x in items:
            used[x] += times
    assert (used == counts).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_fewest_bins(lengths):
    counts = np.bincount(lengths, minlength=21) if lengths else np.zeros(21, int)
    for plan in (packing.best_fit(counts), packing.complete(counts)):
        check_plan(plan, counts)
    assert sum(t for _, t in packing.complete(counts)) == (fewest(lengths, 20) if lengths else 0)


def test_large_histograms():
    rng = np.random.default_rng(2)
    for scale in (1, 300):
        lengths = np.clip(rng.lognormal(6.4, 0.9, 2000).astype(int), 1, 4096)
        counts = np.bincount(lengths, minlength=4097) * scale
        plan = packing.complete(counts)
        check_plan(plan, counts)
        need = -(-(counts * np.arange(4097)).sum() // 4096)
        assert sum(t for _, t in plan) <= need * 1.001 + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_lower_bound_holds(lengths):
    assert -(-sum(lengths) // 20) <= packing.lower_bound(np.bincount(lengths, minlength=21)) <= fewest(lengths, 20)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9), st.integers(5, 20))
def test_fillings_are_the_undominated_ones(lengths, room):
    """Against all multisets that fit: none is left out that no other piece left could improve, and none is listed that one could."""
    counts = np.bincount(lengths, minlength=21)
    search = packing.Search(counts, 10**6)
    search.best = 10**6
    got = list(search.fillings(room, None))
    if sum(lengths) <= room:
        assert got == [tuple(sorted(lengths, reverse=True))]
        return
    kinds = sorted({tuple(sorted(c, reverse=True)) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if sum(c) <= room})

    def improves(items):
        left = counts - np.bincount(items, minlength=21) if items else counts
        slack = room - sum(items)
        many = {sum(c) for k in range(2, len(items) + 1) for c in itertools.combinations(items, k)}
        return any(left[y] and (y <= slack or any(s <= y <= s + slack for s in many) or any(x < y <= x + slack for x in items)) for y in range(1, 21))

    assert set(got) == {x for x in kinds if not improves(x)} and len(got) == len(set(got))
    assert [room - sum(x) for x in got] == sorted(room - sum(x) for x in got)


def check_rows(rows, docs, capacity, encoder):
    want = []
    for doc_id, text in docs:
        ids = encoder.encode(text or "") + b"\1\0\0\0"
        for p, lo in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[lo : lo + 4 * capacity]
            want.append((doc_id, p, lo // 4, len(part) // 4, zlib.crc32(part)))
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


def test_pack(spark, encoder):
    docs = [(1, "one two three"), (1, "one two three"), (None, None), (2, ""), (3, "word " * 100), (4, "été 漢字 x"), (None, "y")]
    df = spark.createDataFrame([(*d, 3, 4) for d in docs], "doc_id long, text string, length int, offset int")
    rows = packing.pack(packing.tokenise(df, PATH, capacity=16), capacity=16).collect()
    check_rows(rows, docs, 16, encoder)
    assert packing.pack(packing.tokenise(df.limit(0), PATH)).collect() == []


def test_given_documents(spark, sf_dir, encoder):
    df = table(spark, sf_dir, "documents")
    rows = packing.query(spark, sf_dir).collect()
    check_rows(rows, [(r["doc_id"], r["text"]) for r in df.collect()], 4096, encoder)
    need = -(-sum(r["length"] for r in rows) // 4096)
    assert len({r["sequence_id"] for r in rows}) <= need + 1
