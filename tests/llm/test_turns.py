"""The repair DP against all edits of short conversations, and segments against whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quaymark.llm import turns

GOAL = re.compile("(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = [], []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "ok")
        seen.append((role, text))
    return out


def all_edits(rows):
    """(cost, audit, repaired) of the best of all edits with up to two insertions in each gap."""
    gaps = ["", "u", "a", "ua", "au"]
    options = []
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        extra, own = 5 * (fault == "truncated"), [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", extra, (role, text)), ("R", 1 + extra, ("user", text)), ("R", 1 + extra, ("assistant", text))]
        options.append(own)
    best = None
    for chosen in itertools.product(*options):
        base = sum(c for _, c, _ in chosen)
        if best and base > best[0]:
            continue
        for puts in itertools.product(gaps, repeat=len(rows) + 1):
            cost = base + 5 * sum(map(len, puts))
            if best and cost > best[0]:
                continue
            audit, out = "I" * len(puts[0]), [(NAMES[x], "") for x in puts[0]]
            for (edit, _, row), put in zip(chosen, puts[1:], strict=True):
                audit += edit + "I" * len(put)
                out += ([row] if row else []) + [(NAMES[x], "") for x in put]
            if GOAL.fullmatch("".join(r[0][:1] if r[0] else "?" for r in out)) and (not best or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", " ", "" , "u", "S"]), rng.choice(["Yes.", "no", " ", "", "ok!", "what? ", "a b", "Yes."])) for _ in range(n)]


def test_best_of_all_edits():
    rng = random.Random(3)
    for _ in range(220):
        rows = random_rows(rng, rng.randrange(0, 4))
        best = turns.Segment([(a, b, f) for (a, b), f in zip(rows, faults(rows), strict=True)])
        audit, out, state = best.edits("-")
        more, end = turns.finish(state)
        assert (best.cost("-"), audit + more, out + end) == all_edits(rows), rows
    assert turns.faults(rows := random_rows(rng, 60)) == faults(rows)


def expected(convs):
    """Reports from whole conversations, damage and all, in plain Python."""
    out = {}
    for conv, rows in convs.items():
        after = []
        for turn, role, text in rows:
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            after += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        pairs = [(b, c) for _, b, c in after]
        f, known, first = faults(pairs), [t for t, *_ in after if t is not None], [r[:1] for r, _ in pairs]
        best = turns.Segment([(a, b, x) for (a, b), x in zip(pairs, f, strict=True)])
        audit, turned, state = best.edits("-")
        more, end = turns.finish(state)
        text = "\n".join(f"{a}:{b}" for a, b in turned + end)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[f.count(x) for x in ("blank", "duplicate", "truncated")], sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first)), best.cost("-"), audit + more, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("rows", "chars"), [(None, None), (3, None), (1, None), (None, 40)])
def test_segments_equal_whole_conversations(spark, rows, chars):
    """A conversation over all partitions, those of a segment, of many, without rows left, of null turns and of a null id."""
    rng = random.Random(8)
    convs = {c: [(t * rng.choice([1, 1, 2]), *random_rows(rng, 1)[0]) for t in range(rng.randrange(1, 9))] for c in range(60)}
    convs = {c: [(t, *r[1:]) for t, r in {r[0]: r for r in rs}.items()] for c, rs in convs.items()}
    convs[100] = [(t, *random_rows(rng, 1)[0]) for t in range(700)]
    convs[101] = [(0, "user", "only. " * 40)]
    convs[None] = [(None, "user", "Hello."), (3, None, "x"), (4, "assistant", None), (5, "assistant", "Bye.")]
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    convs[gone] = [(0, "user", "dropped.")]
    flat = [(c, t, r, x, 1, "e") for c, rs in convs.items() for t, r, x in rs]
    rng.shuffle(flat)
    df = spark.createDataFrame(flat, "conv_id long, turn int, role string, text string, place int, fault string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in turns.report(df, rows, chars).collect()}
    assert got == expected(convs) and got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repeated_rows_ties_and_no_rows(spark):
    rows = [("a", None, "user", "Hi."), ("a", None, "user", "Hi."), ("a", 7, "user", "Hi."), ("a", 7, "assistant", "Yes.")]
    df = spark.createDataFrame([(*r, True) for r in rows], "conv_id string, turn long, role string, text string, alive boolean")
    pieces, reports = turns.repair(df)
    (r,) = reports.collect()
    assert (r["gaps"], r["duplicate"], r["blank"], r["cost"]) == (0, 2, 0, 4)
    assert [(t["role"], t["text"]) for p in pieces.orderBy("piece").collect() for t in p["turns"]] == [("user", "Hi."), ("assistant", "Yes.")]
    assert turns.report(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_query(spark, sf_dir):
    convs = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.query(spark, sf_dir).collect()}
    assert got == expected(convs)
