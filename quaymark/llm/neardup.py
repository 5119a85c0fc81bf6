"""SimHash near-dedup of whole documents: every link of five-word similarity 0.8 or more, each verified on whole shingle sets.

Documents are near copies at a similarity (shared among all distinct five-word shingles) of 0.8 or more; one document of
each connected group of them stays. No pair is lost and no link is guessed, whatever the size of a group:

- First links: SimHash fingerprints of the shingle sets are blocked and verified within 2 bits as in ``simhash``, and the
  sets that share one of their ``LOW`` least shingle hashes are compared with one pivot of that hash. This joins most near
  copies, crowds included, at a few comparisons a document.
- The rest: sets are sorted by one order of all shingles. Two similar sets of n and m shingles share at least
  t / (1 + t) (n + m); so the first that both have is among the first n - ceil(t n) + 1 of either, and the places before
  it, all unshared, are at most what that leaves of n, and of m. Shingles by whose place two documents of different
  groups may be similar are the only ones that go on: their members meet two pivots, then what is still apart meets.
  Two documents meet at the first such shingle that they share, seldom again at a later one. Of what meets, pairs that
  share too few of these shingles to be similar end there.
  Shingles that are frequent in a sample come last in the order; the sample decides what the work costs, never what is
  found.
- Each link is an exact intersection of the two sets of 64-bit shingle hashes. Sets are made again from the texts where
  they are needed; bit maps of fixed size, which let some others past, keep the rest out of the shuffle.

Defined results: texts of fewer words are one shingle; null, empty and wordless texts are alike; equal sets (of equal size
and 64-bit digest) are one node; of repeated rows one stays; a null doc_id stays only where its group has no other; empty
tables give no rows; all columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .bitmap import BitMap
from .common import chunks, fresh, lower_table, mix, ship, text_view, token_hashes, written
from .components import components

SHINGLE, SIMILARITY, LOW = 5, 0.8, 4
#: Documents of the sample, and how many of them have a frequent shingle.
SAMPLE, FREQUENT = 16384, 4
#: Earlier keys of a set that go with each key, so that two sets meet at the first that they share and not again nearby.
BEFORE = 6
_WORD = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])


def shingled(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each distinct shingle, sorted; each text's number of them and the digest of its set."""
    _, _, doc, w = token_hashes(lower_table()[data], off, _WORD)
    count = np.bincount(doc, minlength=len(off) - 1)
    with np.errstate(over="ignore"):
        h = w[: max(0, len(w) - shingle + 1)]
        for j in range(1, shingle):
            h = mix(h) + w[j : j + len(h)]
        whole = doc[: len(h)] == doc[len(w) - len(h) :]
        row, h = [doc[: len(h)][whole]], [mix(h)[whole]]
        for d in np.flatnonzero((count > 0) & (count < shingle)).tolist():
            a = int(np.searchsorted(doc, d))
            x = w[a : a + 1]
            for j in range(1, count[d]):
                x = mix(x) + w[a + j : a + j + 1]
            row.append(np.array([d]))
            h.append(mix(x ^ np.uint64(count[d])))
        row, h = np.concatenate(row), np.concatenate(h)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        row, h = row[new], h[new]
        n = np.bincount(row, minlength=len(off) - 1)
        digest = np.zeros(len(n), np.uint64)
        if len(h):
            digest[n > 0] = np.add.reduceat(mix(h), (np.cumsum(n) - n)[n > 0])
        return row, h, n, mix(digest + mix(n.astype(np.uint64)))


def _least(n, similarity: float):
    """How many shingles a set of n shares with any that is similar."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def _prints(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit SimHash fingerprint of each set; zero of none."""
    out, some = np.zeros(len(n), np.uint64), n > 0
    if len(h):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        over = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32) * 2 > n[some][:, None]
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _lists(values: np.ndarray, row: np.ndarray, size: int) -> pa.Array:
    """Values of rows 0 to size, sorted by row, as lists of longs."""
    ends = np.searchsorted(row, np.arange(size + 1), "left")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, last: np.ndarray) -> DataFrame:
    """Per row of docs: doc, the digest of its set (id), its size n, SimHash fp, least hashes low, and keys, the shingles by
    which it is found, in the order in which the sorted hashes ``last`` come last."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 1, 1 << 18):
            row, h, n, digest = shingled(*text_view(chunk.column(1)), shingle)
            late = np.zeros(len(h), bool)
            if len(last):
                late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
            order, place = np.lexsort((h, late, row)), np.arange(len(h)) - (np.cumsum(n) - n)[row]
            order, low = order[place < (n - _least(n, similarity) + 1)[row]], place < LOW
            cols = [chunk.column(0), pa.array(digest.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(_prints(h, n).view(np.int64)), _lists(h[low], row[low], len(n)), _lists(h[order], row[order], len(n))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "id", "n", "fp", "low", "keys"])

    return docs.select(_named(id_col).cast("long"), _named(text_col).cast("string")).mapInArrow(run, "doc long, id long, n int, fp long, low array<long>, keys array<long>")


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def signed(docs: DataFrame, name: str, shingle: int, text_col: str, wanted: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Those rows of docs whose set's digest is wanted, with the digest, called ``name``."""
    ship(docs.sparkSession)
    names, at = [*docs.columns, name], docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(names) - 1)])  # dots in names don't pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, at, 1 << 18):
            digest = shingled(*text_view(chunk.column(at)), shingle)[3]
            some = pa.array(wanted(digest))
            yield pa.RecordBatch.from_arrays([c.filter(some) for c in (*chunk.columns, pa.array(digest.view(np.int64)))], names=[*chunk.schema.names, "id"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("id", T.LongType())])).toDF(*names)


def sets(texts: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, s): all distinct shingle hashes of each set of a one-column table of texts whose digest may be among ids (id)."""
    known = BitMap(ids, F.col("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 0, 1 << 18):
            _, h, n, digest = shingled(*text_view(chunk.column(0)), shingle)
            s = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))
            wanted = pa.array(known(digest))
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)).filter(wanted), s.filter(wanted)], names=["id", "s"])

    return texts.mapInArrow(run, "id long, s array<long>").dropDuplicates(["id"])


def frequent(texts: DataFrame, shingle: int) -> np.ndarray:
    """The sorted hashes of shingles that some documents of a sample share; the sample's size bounds how many."""
    ship(texts.sparkSession)
    count = texts.count()
    if count > SAMPLE:
        texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < (SAMPLE << 30) // count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 0, 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(shingled(*text_view(chunk.column(0)), shingle)[1].view(np.int64))], names=["h"])

    counts = texts.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT)
    return np.sort(counts.select("h").toArrow()["h"].to_numpy().view(np.uint64))


def verified(pairs: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (u, v) whose whole sets are similar. Sets are dealt out by id once and serve both ends."""
    side = lambda c: of.select(F.col("id").alias(c), F.col("s").alias(f"s{c}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", F.size("su").alias("nu"), F.size("sv").alias("nv"), F.size(F.array_intersect("su", "sv")).alias("both"))
    return both.where(F.col("both") >= similarity * (F.col("nu") + F.col("nv") - F.col("both")) - 1e-9).select("u", "v")


def _sized(a: str, b: str, similarity: float) -> Column:
    """Whether sets of a and b shingles can be similar."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def _placed(n: str, m: str, at: str, to: str, similarity: float) -> Column:
    """Whether so many unshared shingles before the first shared one leave sets of n and m similar: neither can have more
    than what the shared ones that similarity needs leave it."""
    least = F.ceil(similarity / (1 + similarity) * (F.col(n) + F.col(m)) - 1e-9)
    return (F.col(at) <= F.col(n) - least) & (F.col(to) <= F.col(m) - least)


def _ends(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u != v").distinct()


def _plausible(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (u, v) of different groups that share keys enough: of the shingles that two similar sets must share, those
    that aren't keys of both come after the last key of one of the two. rows has all keys that such pairs share."""
    own = rows.groupBy("id").agg(F.first("n").alias("n"), F.collect_list("h").alias("k"))  # at most a set's keys
    side = lambda c: own.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("k").alias(f"k{c}"))
    least = lambda c: F.ceil(similarity * F.col(c) - 1e-9)
    enough = F.ceil(similarity / (1 + similarity) * (F.col("nu") + F.col("nv")) - 1e-9) - F.greatest(least("nu"), least("nv")) + 1
    return pairs.join(side("v"), "v").join(side("u"), "u").where(F.size(F.array_intersect("ku", "kv")) >= enough).select("u", "v")


def first_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Candidates (u, v): ids within 2 bits of SimHash, and ids with one of their least hashes and its pivot."""
    least = nodes.groupBy("fp").agg(F.min("id").alias("p"))
    near = simhash.links(least.select("fp"))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("p").alias(f"p{c}"))
    close = near.join(of("u"), "u").join(of("v"), "v").select("pu", "pv").unionAll(nodes.join(least, "fp").select("id", "p"))
    rows = nodes.select("id", "n", F.explode("low").alias("h"))
    pivots = rows.groupBy("h").agg(F.min_by(F.struct("id", "n"), F.xxhash64("id", "h")).alias("p"), F.count("*").alias("c")).where("c > 1")
    met = rows.join(pivots, "h").where(_sized("n", "p.n", similarity))
    return written(_ends(close, "pu", "pv").unionAll(_ends(met, "id", "p.id")).distinct())


def _open(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(h, id, n, g, at) of the keys whose members the links leave in several groups g; at is the key's place in its set."""
    several = written(nodes.select(F.explode("keys").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    known = BitMap(several, F.col("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2)
            h, size = keys.flatten().to_numpy(), np.diff(keys.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            at, some = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size), np.flatnonzero(known(h))
            own = pa.array(row[some])
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), *(batch.column(c).take(own) for c in (0, 1)), pa.array(at[some].astype(np.int32))], names=["h", "id", "n", "at"])

    met = nodes.select("id", "n", "keys").mapInArrow(run, "h long, id long, n int, at int").join(several, "h", "left_semi")
    return _apart(met.select("h", "id", "n", F.col("id").alias("g"), "at"), links)


def _apart(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with their groups as links make them, of keys that still have several."""
    groups = components(links)
    named = written(rows.join(groups, rows["id"] == groups["node"], "left").select("h", "id", "n", F.coalesce("root", "g").alias("g"), "at"))
    return written(named.join(named.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi").select("h"), "h"))


def _led(rows: DataFrame) -> DataFrame:
    """rows with ``before``, the keys that come right before each in its set; at most a set's keys are put in order."""
    own = rows.groupBy("id").agg(F.first("n").alias("n"), F.first("g").alias("g"), F.array_sort(F.collect_list(F.struct("at", "h"))).alias("x"))
    each = own.select("id", "n", "g", F.transform("x", lambda x: x["h"]).alias("hs"), F.posexplode("x").alias("i", "x"))
    first = F.greatest(F.col("i") - BEFORE, F.lit(0))
    return each.select("x.h", "id", "n", "g", "x.at", F.slice("hs", first + 1, F.col("i") - first).alias("before"))


def similar(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between digests of similar sets, which join all of them that a chain of similar sets joins.

    docs: a one-column table of texts; nodes: (id, n, fp, low, keys) of each distinct set.
    """
    ids = lambda pairs: pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    links = lambda pairs: verified(pairs, sets(docs, ids(pairs), shingle), similarity)
    found = written(links(first_pairs(nodes, similarity)))
    rows = _open(nodes, found)
    apart = lambda n, g, at: (F.col("g") != F.col(g)) & _sized("n", n, similarity) & _placed("n", n, "at", at, similarity)
    for pivot in (F.struct(F.col("at") / F.col("n"), F.xxhash64("id")), F.xxhash64("id", "h")):  # the member with least before the key; any
        pivots = rows.groupBy("h").agg(F.min_by(F.struct("id", "n", "g", "at"), pivot).alias("p"))
        pairs = written(_plausible(_ends(rows.join(pivots, "h").where(apart("p.n", "p.g", "p.at")), "id", "p.id"), rows, similarity))
        if not pairs.isEmpty():
            found = written(found.unionAll(links(pairs)))
            rows = _apart(rows, found)
    led = written(_led(rows))
    other = led.select("h", F.col("id").alias("v"), F.col("n").alias("m"), F.col("g").alias("k"), F.col("at").alias("to"), F.col("before").alias("prior"))
    again = F.arrays_overlap("before", "prior")  # they meet at an earlier key
    pairs = written(_plausible(_ends(led.join(other, "h").where((F.col("id") < F.col("v")) & apart("m", "k", "to") & ~again), "id", "v"), rows, similarity))
    return found if pairs.isEmpty() else found.unionAll(links(pairs))


def dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id.

    Rows that a bit map shows to be alone pass where they are; only the others are joined with what stays.
    """
    texts = docs.select(_named(text_col).cast("string").alias("text"))
    rows = described(docs, id_col, text_col, shingle, similarity, frequent(texts, shingle))
    nodes = written(rows.groupBy("id").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "fp", "low", "keys")]))
    groups = written(components(similar(texts, nodes.drop("doc", "copies"), shingle, similarity)))
    named = nodes.select("id", "doc", "copies").join(groups, nodes["id"] == groups["node"], "left").where("node IS NOT NULL OR copies > 1").select("id", "doc", F.coalesce("root", "id").alias("root"))
    named = written(named)
    keep = named.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("z"), "doc", "id")).alias("x")).select(F.col("x.doc").alias("kept_doc"), F.col("x.id").alias("kept_id"))
    known = BitMap(named, F.col("id"))
    digest, doc = fresh("nd_id", docs.columns), fresh("nd_doc", docs.columns)
    full = lambda met: signed(docs, digest, shingle, text_col, lambda d: known(d) == met)
    some = full(True).withColumn(doc, _named(id_col).cast("long"))
    of = some.join(named.select("id"), some[digest] == named["id"], "left_anti")
    one = some.join(keep, (some[digest] == keep["kept_id"]) & some[doc].eqNullSafe(keep["kept_doc"]), "left_semi").dropDuplicates([digest, doc])
    return full(False).drop(digest).unionAll(of.unionAll(one).drop(digest, doc))
