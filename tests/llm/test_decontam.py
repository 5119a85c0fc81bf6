import hashlib
import re

from quaymark.llm import decontam
from quaymark.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            size = min(n, len(b))
            for j in range(len(b) - size + 1 if size else 0):
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == b[j : j + size]:
                        hit |= set(range(i, i + size))
                        found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


TEN = "one two three four five six seven eight nine ten"
DOCS = [
    (1, f"x {TEN.upper()} eleven é9"), (1, f"x {TEN} eleven é9"), (None, TEN), (2, None), (3, ""), (4, " \n\t"), (5, "short item"), (6, "short, ITEM short item"),
    (7, "one two three"), (8, f"{TEN} {TEN}"), (9, "word " * 30000 + TEN), (10, "zero " + TEN.replace(" ", "--")), (11, "été ÉTÉ"),
]
ITEMS = [(3, f"zero {TEN} eleven"), (3, "short item"), (20, TEN), (None, "one two three"), (4, None), (5, "..."), (6, "été ÉTÉ")]


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_matches_brute_force(spark):
    docs = spark.createDataFrame([(*d, "a", 1) for d in DOCS], "doc_id long, text string, dc_words string, n_hit int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(decontam.report(docs, items)) == sorted(brute(DOCS, ITEMS), key=str)
    blocks = decontam.mark(docs.select("doc_id", "text"), items, block_bytes=40)
    whole = decontam.mark(docs.select("doc_id", "text"), items)
    assert rows(blocks) == rows(whole)


def test_real_rows_match_brute_force(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    got = {r["doc_id"]: tuple(r) for r in decontam.report(docs, items).collect()}
    assert sum(r[5] for r in got.values()) > 0
    some = [tuple(r) for r in docs.collect() if got[r["doc_id"]][5]][:12]
    for want in brute(some, [tuple(r) for r in items.collect()]):
        assert got[want[0]] == want


def test_removal(spark):
    docs = spark.createDataFrame([(1, f"Keep this. {TEN}! And this.", "en"), (2, "clean", "fr"), (3, None, "de")], "doc_id long, text string, dc_items string")
    items = spark.createDataFrame([(1, TEN)], "item_id long, text string")
    cut = decontam.decontaminate(docs.drop("dc_items"), items)
    assert rows(cut) == [(1, "Keep this. ! And this."), (2, "clean"), (3, None)]
    assert rows(decontam.decontaminate(docs.drop("dc_items"), items, mode="document")) == [(2, "clean"), (3, None)]


def test_empty(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.report(docs.limit(0), items).collect() == []
    assert not any(r["contaminated"] for r in decontam.report(docs, items.limit(0)).collect())
