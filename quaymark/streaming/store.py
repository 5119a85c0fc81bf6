"""A store of open sessions: what is known of each user's session while it runs, kept as state until an event-time timer ends it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user_id long, start timestamp, end timestamp, n long, total double, per_minute double, last_event long, last_type string, closed boolean"
#: Of a user's open sessions: first and last instant in microseconds, events, sum of values, last event's id and type.
STATE = "starts array<long>, ends array<long>, counts array<long>, totals array<double>, events array<long>, types array<string>"


class Session:
    """A run of events with pauses shorter than the gap. The last event is the latest, of equal ones that of the greatest id."""

    __slots__ = ("start", "end", "n", "total", "event", "type")

    def __init__(self, start: int, end: int, n: int, total: float, event: int, kind: str | None):
        self.start, self.end, self.n, self.total, self.event, self.type = start, end, n, total, event, kind

    def join(self, other: Session) -> None:
        self.n, self.total = self.n + other.n, self.total + other.total
        if (other.end, other.event) > (self.end, self.event):
            self.event, self.type = other.event, other.type
        self.start, self.end = min(self.start, other.start), max(self.end, other.end)


def merge(sessions: list[Session], gap: int) -> list[Session]:
    """Sessions in order of their start, those closer than the gap joined."""
    out: list[Session] = []
    for s in sorted(sessions, key=lambda s: (s.start, s.end)):
        if out and s.start - out[-1].end < gap:
            out[-1].join(s)
        else:
            out.append(s)
    return out


def _folded(batch: pd.DataFrame, gap: int) -> list[Session]:
    """A batch's events as sessions, without a Python object an event."""
    b = batch.sort_values(["at", "event_id"], kind="stable")
    part = (b["at"].diff() >= gap).cumsum()
    g = b.groupby(part.to_numpy(), sort=True)
    rows = zip(g["at"].min(), g["at"].max(), g.size(), g["value"].sum(), g["event_id"].last(), b["event_type"].groupby(part.to_numpy()).nth(-1), strict=True)
    return [Session(int(a), int(z), int(n), float(v), int(e), k) for a, z, n, v, e, k in rows]


def sessions(events: DataFrame, minutes: int = 30, running: bool = False) -> DataFrame:
    """Sessions (OUT) of a stream of events (user_id, ts, event_id, event_type, value) whose ts carries a watermark.

    A session is given out as closed once the watermark has passed its end by ``minutes``; then its state goes. With
    ``running``, every batch also gives the open sessions that it changed, as they stand. Events may come in any order within
    the watermark's delay: one can join two open sessions. Rows behind the watermark are dropped and counted: a row without
    start and end gives their number as n (``late`` sums these and what Spark drops itself). Null users are a user, null
    values count 0; rows without a time belong to no session and are left out.
    """
    gap = minutes * 60_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = [Session(*x) for x in zip(*state.get, strict=True)] if state.exists else []
        changed, behind, mark = set(), 0, state.getCurrentWatermarkMs() * 1000
        for batch in batches if not state.hasTimedOut else ():
            gone = (batch["at"] < mark) & (mark > 0)
            behind += int(gone.sum())
            new = _folded(batch[~gone], gap)
            changed |= {s.start for s in new}
            known = merge([*known, *new], gap)
        over = [s for s in known if s.end + gap <= mark]
        known = [s for s in known if s.end + gap > mark]
        if known:
            state.update(tuple(list(x) for x in zip(*[(s.start, s.end, s.n, s.total, s.event, s.type) for s in known], strict=True)))
            state.setTimeoutTimestamp(max(-(-(min(s.end for s in known) + gap) // 1000) - 1, state.getCurrentWatermarkMs()))
        elif state.exists:
            state.remove()
        shown = [(s, True) for s in over] + [(s, False) for s in known if running and any(s.start <= c <= s.end for c in changed)]
        at = lambda x: pd.Timestamp(x, unit="us")
        rate = lambda s: s.n / ((s.end - s.start) / 60e6) if s.end > s.start else None
        rows = [(key[0], at(s.start), at(s.end), s.n, s.total, rate(s), s.event, s.type, c) for s, c in shown] + [(key[0], None, None, behind, None, None, None, None, None)] * (behind > 0)
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"user_id": "Int64", "start": "datetime64[us]", "end": "datetime64[us]", "last_event": "Int64", "total": "float64", "per_minute": "float64"})

    rows = events.where("ts is not null").select("user_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("event_id", F.lit(-1)).cast("long").alias("event_id"), "event_type", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    return rows.groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def late(query: StreamingQuery, found: DataFrame) -> int:
    """Rows dropped because the watermark had passed them, by a query's progress and by the rows that it wrote."""
    return (found.where("start is null").agg(F.sum("n")).first()[0] or 0) + sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])


def held(query: StreamingQuery) -> int:
    """Groups that have state at the end of a query's last batch."""
    last = query.lastProgress
    return sum(int(o["numRowsTotal"]) for o in last["stateOperators"]) if last else 0
