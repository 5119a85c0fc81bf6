"""Conversation structure repair: the cheapest edits that make a conversation's roles ``(s?(ua)+)?``, by dynamic programming.

A retained-subsequence DP: rows are kept or reroled, or lie in the gap before the next retained row. Walking back from the
end, prefix sums price a gap's deletions, a running minimum for each role holds the best row to retain next, and the pair of
roles on both sides says whether one turn must be inserted. Equal costs go to the least audit in ASCII order, D < I < K < R:
the later retained row, then an insertion, then a kept row. So each row costs a constant amount of work.

Rows are dealt by ranges of (conversation, turn), so that a conversation of any size is many tasks' work. Those that lie
within a task are done there. Of the rest, which cross a task's border or are longer than a segment, every segment gives its
4 x 4 table of costs from state to state; costs are carried back over the segments, the states that the edits pass through
carried forward, and each segment is then edited by itself. Duplicates across segments meet by digest, once a segment.
What must be sequential is streamed in order with bounded memory: the carries, a row a segment, and in the query the SHA-256.

Defined results: rows go by turn, nulls first, then role, then a hash of the text; null roles and texts are one space; a row
whose role has another initial than s, u, a, or an empty role, can't be kept; repeated rows are duplicates; null conv_ids are
a conversation; rows that aren't ``alive`` only make their conversation known; an empty table gives no rows; other columns
are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ship, table, written

#: Rows and characters of a segment.
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
STATES = "-sua"  # nothing retained yet, or the role of the last retained row
NAMES = {"u": "user", "a": "assistant"}
#: Turns to insert between two retained rows; pairs that aren't here can't follow each other.
_GAP = {("-", "s"): "", ("-", "u"): "", ("-", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a", ("a", "u"): "", ("a", "a"): "u"}
#: To the end of the conversation from each state.
_LAST = {"-": 0, "s": 2 * INSERT, "u": INSERT, "a": 0}
_NEVER = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive: the rows after the stated damage; a dropped one stays as not alive."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(none("conv_id"), F.lit(":"), none("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(none("text"), "[.!?]", "")).otherwise(none("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(none("role")).alias("role"), text.alias("text"), (fault != 0).alias("alive"), F.when(fault == 3, 2).otherwise(1).alias("n"))
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")


class Segment:
    """Rows of one conversation in order, as (role, text, fault), with the costs from here to the end of the conversation.

    ``after`` has those from the states at the end of the segment.
    """

    def __init__(self, rows: list[tuple[str, str, str]], after: dict[str, int] = _LAST):
        n = len(rows)
        deleted = [DELETE * i for i in range(n + 1)]  # of the rows before
        best: dict[str, tuple[int, int, str]] = {}  # for each role: cost from the start with the row to retain next, that row, its edit
        self.rows, self.next = rows, [None] * n

        def follow(state: str, i: int) -> tuple[int, int, str, str]:
            """(cost, row, role, edit) of what is best after row i - 1 in state; row n is the end."""
            found = (deleted[n] + after[state], n, "", "")
            for role, (cost, j, edit) in best.items():
                put = _GAP.get((state, role))
                if put is None:
                    continue
                cost += INSERT * len(put)
                if cost > found[0]:
                    continue
                if cost < found[0] or (-j, -len(put), edit) < (-found[1], -len(_GAP.get((state, found[2]), "")), found[3]):
                    found = (cost, j, role, edit)
            return (found[0] - deleted[i], *found[1:])

        for i in range(n - 1, -1, -1):
            role, _, fault = rows[i]
            if fault in ("blank", "duplicate"):
                continue
            own, extra = role[:1], TRUNCATED if fault == "truncated" else 0
            self.next[i] = {r: follow(r, i + 1) for r in ("s", "u", "a") if r != "s" or own == "s"}
            for r, (rest, *_) in self.next[i].items():
                edit = "K" if r == own else "R"
                cost = deleted[i] + extra + (KEEP if edit == "K" else REROLE) + rest
                if r not in best or cost < best[r][0]:
                    best[r] = (cost, i, edit)
        self.start = {s: follow(s, 0) for s in STATES}

    def cost(self, state: str) -> int:
        return self.start[state][0]

    def edits(self, state: str) -> tuple[str, list[tuple[str, str]], str]:
        """The audit, the turns (role, text) that it leaves, and the state at the end, from a state at the start. At the end
        of a conversation, ``finish`` follows."""
        audit, turns, at = [], [], 0
        _, j, role, edit = self.start[state]
        while j < len(self.rows):
            put = _GAP[state, role]
            audit.append("D" * (j - at) + "I" * len(put) + edit)
            turns += [(NAMES[r], "") for r in put]
            turns.append((self.rows[j][0] if edit == "K" else NAMES[role], self.rows[j][1]))
            state, at = role, j + 1
            _, j, role, edit = self.next[j][state]
        return "".join([*audit, "D" * (len(self.rows) - at)]), turns, state


def finish(state: str) -> tuple[str, list[tuple[str, str]]]:
    """The insertions that end a conversation in state."""
    put = {"-": "", "s": "ua", "u": "a", "a": ""}[state]
    return "I" * len(put), [(NAMES[r], "") for r in put]


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """Of each row (role, text): blank, duplicate, truncated or ok, the first that holds."""
    seen, out = set(), []
    for row in rows:
        bare = row[1].rstrip(_SPACE)
        out.append("blank" if not bare else "duplicate" if row in seen else "truncated" if bare[-1] not in ".!?" else "ok")
        seen.add(row)
    return out


def _counts(turns: list, rows: list[tuple[str, str, str]]) -> dict:
    """What the segments of a conversation add up: counts, and the ends that tell what lies between two of them."""
    known, first = [t for t in turns if t is not None], [r[0][:1] for r in rows]
    return {
        **{f: sum(r[2] == f for r in rows) for f in ("blank", "duplicate", "truncated")}, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairwise(first)),
        "n": len(rows), "head": first[0] if rows else None, "tail": first[-1] if rows else None, "low": min(known, default=None), "high": max(known, default=None), "distinct": len(set(known)),
    }


class _Sum:
    """_counts of segments in order put together."""

    def __init__(self):
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
        self.tail = self.low = self.high = None

    def add(self, c: dict) -> None:
        for k in self.n:
            self.n[k] += c[k]
        if self.tail is not None and c["head"] is not None:
            self.n["illegal"] += self.tail + c["head"] not in ("su", "ua", "au")
        if self.high is not None and c["low"] == self.high:
            self.n["distinct"] -= 1
        self.tail = c["tail"] if c["head"] is not None else self.tail
        self.low = c["low"] if self.low is None else self.low
        self.high = self.high if c["high"] is None else c["high"]

    def report(self, cost: int) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n["distinct"]
        return {"gaps": gaps, **{k: self.n[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost}


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_TURNS = "array<struct<role: string, text: string>>"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            yield from batch.slice(i, 1024).to_pylist()


def _out(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Records in batches of a bounded number of characters."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += 64 + len(r.get("text") or "") + sum(len(t["text"]) for t in r.get("turns") or ())
        if size > 1 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(df: DataFrame, work, schema: str) -> DataFrame:
    """df's partitions, in their order, turned by ``work`` from records into records."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _out(work(_records(batches)), arrow), schema)


def _groups(records: Iterator[dict], *keys: str) -> Iterator[Iterator[dict]]:
    """Runs of records with equal keys, each as a stream that must be read to its end."""
    record = next(records, None)
    while record is not None:
        key = [record[k] for k in keys]

        def run() -> Iterator[dict]:
            nonlocal record
            while record is not None and [record[k] for k in keys] == key:
                yield record
                record = next(records, None)

        yield run()


def _segments(run: Iterator[dict], rows: int, chars: int) -> Iterator[tuple[list[dict], bool]]:
    """A conversation's living rows in segments, each with whether it is the last."""
    held, size = [], 0
    for r in run:
        if not r["alive"]:
            continue
        if held and (len(held) >= rows or size + len(r["text"]) > chars):
            yield held, False
            held, size = [], 0
        held.append(r)
        size += len(r["text"])
    yield held, True


def _digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def _turns(pairs: list[tuple[str, str]]) -> list[dict]:
    return [{"role": a, "text": b} for a, b in pairs]


def repair(rows: DataFrame, segment_rows: int | None = None, segment_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pieces, reports) of rows (conv_id, turn, role, text, alive).

    pieces: conv_id, piece (in order within the conversation), whole (it is the only one), audit, turns (role, text).
    reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    """
    ship(rows.sparkSession)
    n_rows, n_chars, kind = segment_rows or SEGMENT_ROWS, segment_chars or SEGMENT_CHARS, dict(rows.dtypes)["conv_id"]
    order = ["conv_id", "turn", "role", "hash", "spread"]
    keyed = rows.select("conv_id", "turn", "role", "text", "alive", F.xxhash64("text").alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("spread"))  # equal rows may be anywhere among themselves

    def first(records: Iterator[dict]) -> Iterator[dict]:
        """Conversations that lie within the task, done; the rows of all others, by segment."""
        number, opened, only = TaskContext.get().partitionId() << 40, 0, None
        for k, run in enumerate(_groups(records, "conv_id")):
            if only is not None:
                yield from done(*only)  # another conversation follows it, so it ends here
                only = None
            for i, (segment, end) in enumerate(_segments(run, n_rows, n_chars)):
                if segment and end and not i and k:
                    only = (segment, number + opened)
                else:
                    yield from left(segment, number + opened)
                opened += 1
        if only is not None:
            yield from left(*only)

    def plain(segment: list[dict]) -> list[tuple[str, str, str]]:
        pairs = [(r["role"], r["text"]) for r in segment]
        return [(a, b, f) for (a, b), f in zip(pairs, faults(pairs), strict=True)]

    def done(segment: list[dict], number: int) -> Iterator[dict]:
        known, total = plain(segment), _Sum()
        best = Segment(known)
        total.add(_counts([r["turn"] for r in segment], known))
        audit, turns, state = best.edits("-")
        more, end = finish(state)
        yield {"conv_id": segment[0]["conv_id"], "segment": number, "audit": audit + more, "turns": _turns(turns + end), "report": total.report(best.cost("-"))}

    def left(segment: list[dict], number: int) -> Iterator[dict]:
        for i, (r, (role, text, fault)) in enumerate(zip(segment, plain(segment), strict=True)):
            yield {"conv_id": r["conv_id"], "segment": number, "place": i, "turn": r["turn"], "role": role, "text": text, "fault": fault, "key": _digest(role, text) if fault in ("truncated", "ok") else None}

    schema = f"conv_id {kind}, segment long, place int, turn long, role string, text string, fault string, key binary, audit string, turns {_TURNS}, report struct<{_REPORT.replace(' long', ': long')}>"
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    one = written(_mapped(dealt, first, schema))
    pieces, reports = _crossing(one.where("report is null").select("conv_id", "segment", "place", "turn", "role", "text", "fault", "key"), kind)
    closed = one.where("report is not null")
    alike = lambda df, *c: df.select("conv_id", *c)
    return (
        alike(closed, F.col("segment").alias("piece"), F.lit(True).alias("whole"), "audit", "turns").unionByName(alike(pieces, "piece", F.lit(False).alias("whole"), "audit", "turns")),
        alike(closed, "report.*").unionByName(reports),
    )


def _crossing(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(pieces, reports) of conversations that are several segments."""
    shown = rows.where("key is not null").groupBy("conv_id", "key").agg(F.min("segment").alias("seen")).select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "seen")
    fault = F.when(F.col("segment") > F.col("seen"), "duplicate").otherwise(F.col("fault"))
    marked = rows.join(shown, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left").select("conv_id", "segment", "place", "turn", "role", "text", F.coalesce(fault, "fault").alias("fault"))
    rows = written(marked).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")
    triple = lambda run: [(r["role"], r["text"], r["fault"]) for r in run]

    def priced(records: Iterator[dict]) -> Iterator[dict]:
        for run in _groups(records, "conv_id", "segment"):
            own = list(run)
            known = triple(own)
            costs = [[s.cost(a) for a in STATES] for s in (Segment(known, {b: 0 if b == end else _NEVER for b in STATES}) for end in STATES)]
            yield {"conv_id": own[0]["conv_id"], "segment": own[0]["segment"], "costs": costs, **_counts([r["turn"] for r in own], known)}

    tables = written(_mapped(rows, priced, f"conv_id {kind}, segment long, costs array<array<long>>, blank long, duplicate long, truncated long, illegal long, n long, head string, tail string, low long, high long, distinct long"))

    def back(records: Iterator[dict]) -> Iterator[dict]:
        """Costs to the end of the conversation from each state at the end of each segment."""
        for run in _groups(records, "conv_id"):
            after = [_LAST[s] for s in STATES]
            for r in run:
                yield {"conv_id": r["conv_id"], "segment": r["segment"], "after": after}
                after = [min(_NEVER, *(r["costs"][e][s] + after[e] for e in range(4))) for s in range(4)]

    ahead = _mapped(tables.select("conv_id", "segment", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment")), back, f"conv_id {kind}, segment long, after array<long>")
    known = written(ahead)
    on = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.segment") == F.col(f"{b}.segment"))
    beside = lambda small, *c: rows.alias("r").join(small.alias("s"), on("r", "s")).select("r.*", *[f"s.{x}" for x in c]).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")

    def ends(records: Iterator[dict]) -> Iterator[dict]:
        for run in _groups(records, "conv_id", "segment"):
            own = list(run)
            best = Segment(triple(own), dict(zip(STATES, own[0]["after"], strict=True)))
            yield {"conv_id": own[0]["conv_id"], "segment": own[0]["segment"], "ends": [best.edits(s)[2] if best.cost(s) < _NEVER else s for s in STATES], "first": [best.cost(s) for s in STATES]}

    passed = _mapped(beside(known, "after"), ends, f"conv_id {kind}, segment long, ends array<string>, first array<long>")
    facts = passed.alias("r").join(tables.alias("s"), on("r", "s")).select("r.*", "s.blank", "s.duplicate", "s.truncated", "s.illegal", "s.head", "s.tail", "s.low", "s.high", "s.distinct")

    def forward(records: Iterator[dict]) -> Iterator[dict]:
        """The state in which each segment starts, and after the last the conversation's report."""
        for run in _groups(records, "conv_id"):
            state, total, cost, last = "-", _Sum(), None, None
            for r in run:
                if last is not None:
                    yield last | {"final": False}
                cost = r["first"][0] if cost is None else cost
                last = {"conv_id": r["conv_id"], "segment": r["segment"], "state": state}
                state = r["ends"][STATES.index(state)]
                total.add(r)
            yield last | {"final": True, "report": total.report(cost)}

    path = written(_mapped(facts.repartition("conv_id").sortWithinPartitions("conv_id", "segment"), forward, f"conv_id {kind}, segment long, state string, final boolean, report struct<{_REPORT.replace(' long', ': long')}>"))
    both = known.alias("r").join(path.alias("s"), on("r", "s")).select("r.*", "s.state", "s.final")

    def edited(records: Iterator[dict]) -> Iterator[dict]:
        for run in _groups(records, "conv_id", "segment"):
            own = list(run)
            audit, turns, state = Segment(triple(own), dict(zip(STATES, own[0]["after"], strict=True))).edits(own[0]["state"])
            more, end = finish(state) if own[0]["final"] else ("", [])
            yield {"conv_id": own[0]["conv_id"], "piece": own[0]["segment"], "audit": audit + more, "turns": _turns(turns + end)}

    pieces = _mapped(beside(both, "after", "state", "final"), edited, f"conv_id {kind}, piece long, audit string, turns {_TURNS}")
    return pieces, path.where("final").select("conv_id", "report.*")


def _streamed(pieces: DataFrame, kind: str) -> DataFrame:
    """conv_id, audit, repaired_sha256 of conversations of several pieces, read in order."""

    def work(records: Iterator[dict]) -> Iterator[dict]:
        for run in _groups(records, "conv_id"):
            digest, audit, conv, some = hashlib.sha256(), [], None, False
            for r in run:
                conv = r["conv_id"]
                audit.append(r["audit"])
                for t in r["turns"]:
                    digest.update(f"{chr(10) * some}{t['role']}:{t['text']}".encode())
                    some = True
            yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    return _mapped(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece"), work, f"conv_id {kind}, audit string, repaired_sha256 string")


def report(conversations: DataFrame, segment_rows: int | None = None, segment_chars: int | None = None) -> DataFrame:
    """Every conversation's report, audit and digest after the stated damage."""
    kind = dict(conversations.dtypes)["conv_id"]
    pieces, reports = repair(damage(conversations), segment_rows, segment_chars)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    texts = pieces.where("whole").select("conv_id", "audit", F.sha2(lines, 256).alias("repaired_sha256")).unionAll(_streamed(pieces.where("NOT whole").select("conv_id", "piece", "audit", "turns"), kind))
    both = reports.alias("a").join(texts.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")))
    found = both.select("a.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    # conversations whose rows were all dropped
    ids = conversations.select("conv_id").distinct()
    gone = ids.alias("i").join(reports.select("conv_id").alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left_anti")
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.unionByName(gone.select("conv_id", *zero, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))


def query(spark, sf_dir):
    return report(table(spark, sf_dir, "conversations"))
