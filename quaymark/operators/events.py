"""Windows, sessions, rates, drift and alerts over event tables (user_id, ts, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import quantiles


#: Microseconds of the time slices in which a user's events are put in order; longer than any window that looks back.
SLICE = 3_600_000_000


def sliced(df: DataFrame, reach: int) -> DataFrame:
    """df (ts) with ``at`` (microseconds), ``slice`` and ``own``: each row in its slice, and those of the last ``reach``
    microseconds of a slice once more in the next, as not its own. A window over a key and slice that looks back no further sees
    all that one over the key would, and a key with very many rows is many tasks' work."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = df.withColumn("at", at).withColumn("own_slice", F.floor(F.col("at") / SLICE))
    both = F.when(F.floor((F.col("at") + reach) / SLICE) > F.col("own_slice"), F.array("own_slice", F.col("own_slice") + 1)).otherwise(F.array("own_slice"))
    return rows.withColumn("slice", F.explode(both)).withColumn("own", F.col("slice") == F.col("own_slice")).drop("own_slice")


def rates(df: DataFrame) -> DataFrame:
    """Events of the same user in the last 1 and 5 minutes, this one included."""
    w = lambda m: Window.partitionBy("user_id", "slice").orderBy("at").rangeBetween(-m * 60_000_000, 0)
    rows = sliced(df.select("event_id", "user_id", "ts"), 300_000_000)
    return rows.select("event_id", "own", F.count("*").over(w(1)).alias("n_1m"), F.count("*").over(w(5)).alias("n_5m")).where("own").drop("own")


def gaps(df: DataFrame) -> DataFrame:
    """Microseconds since the user's event before, and whether the type changed within 10 minutes.

    Within slices of time the event before is the row before; a slice's first row takes the last one of the slices before.
    """
    rows = sliced(df.select("event_id", "user_id", "ts", "event_type"), 0).withColumn("row", F.struct("at", "event_id", "event_type"))
    ends = rows.groupBy("user_id", "slice").agg(F.max("row").alias("end"))
    before = ends.select("user_id", "slice", F.lag("end").over(Window.partitionBy("user_id").orderBy("slice")).alias("before"))  # a row a slice
    inner = Window.partitionBy("user_id", "slice").orderBy("at", "event_id")
    own = rows.withColumn("near", F.lag("row").over(inner))
    joined = own.alias("o").join(before.alias("b"), F.col("o.user_id").eqNullSafe(F.col("b.user_id")) & F.col("o.slice").eqNullSafe(F.col("b.slice")))
    last = F.coalesce("o.near", "b.before")
    gap = F.col("o.at") - last["at"]
    churn = (gap <= 600_000_000) & (last["event_type"] != F.col("o.event_type"))
    return joined.select("o.event_id", gap.alias("gap_us"), F.coalesce(churn.cast("int"), F.lit(0)).alias("churn"))


def sessions(df: DataFrame, minutes: int = 30) -> DataFrame:
    """Sessions of a user that end after a pause of so many minutes."""
    s = df.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return s.select("user_id", F.col("w.start").alias("start"), "n", "total")


def entropy(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Shannon entropy in bits of item's values within keys."""
    n = df.groupBy(*keys, item).agg(F.count("*").alias("n"))
    # sum n log n and sum n are enough
    s = n.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return s.select(*keys, F.abs(F.round(F.log2("t") - F.col("s") / F.col("t"), 6)).alias("entropy"))


def tumbling(df: DataFrame, minutes: int = 5) -> DataFrame:
    g = df.groupBy(F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes").alias("w"))
    return g.agg(F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95")).select(F.col("w.start").alias("start"), "n", "p95")


def sliding(df: DataFrame, wide: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    g = df.groupBy(F.window(F.col("ts").cast("timestamp"), wide, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def consecutive(windows: DataFrame, breach: str, minutes: int = 5, run: int = 3) -> DataFrame:
    """Runs of at least ``run`` breaching windows that follow each other; a missing window ends a run.

    Windows number their slot; slot minus rank is constant within a run. Ranks are taken within days joined at midnight.
    """
    slot = F.floor(F.unix_seconds("start") / (60 * minutes))
    bad = windows.where(breach).select(slot.alias("slot"))
    first = bad.join(bad.select((F.col("slot") + 1).alias("slot")), "slot", "left_anti").select(F.col("slot").alias("first"))
    day = lambda c: F.floor(F.col(c) / 288)
    w = Window.partitionBy("d").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    marks = bad.join(first.withColumnRenamed("first", "slot").withColumn("f", F.col("slot")), "slot", "left").withColumn("d", day("slot"))
    carried = marks.withColumn("f", F.last("f", ignorenulls=True).over(w))
    ends = carried.groupBy("d").agg(F.max_by("f", "slot").alias("open"))
    over = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    known = ends.select("d", F.last("open", ignorenulls=True).over(over).alias("before"))
    runs = carried.join(known, "d").select(F.coalesce("f", "before").alias("first"), "slot").groupBy("first").agg(F.count("*").alias("n"))
    return runs.where(F.col("n") >= run).select(F.timestamp_seconds(F.col("first") * 60 * minutes).alias("start"), "n")


def daily_rate(df: DataFrame) -> DataFrame:
    """Each day's share of errors against the mean and three deviations of the seven days before."""
    day = df.groupBy(F.to_date("ts").alias("day")).agg(F.avg((F.col("event_type") == "error").cast("double")).alias("rate"))
    w = Window.orderBy("day").rowsBetween(-7, -1)  # a row a day
    m, s = F.avg("rate").over(w), F.stddev_samp("rate").over(w)
    return day.select("day", F.round("rate", 6).alias("rate"), F.round(m, 6).alias("mean_7d"), F.coalesce((F.abs(F.col("rate") - m) > 3 * s).cast("int"), F.lit(0)).alias("alert"))


def bursts(df: DataFrame) -> DataFrame:
    """A user's hours whose count exceeds that user's mean by over three deviations."""
    hour = df.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    base = hour.groupBy("user_id").agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("s"))
    return hour.join(base, "user_id").where(F.col("n") > F.col("m") + 3 * F.col("s") + 1e-9).select("user_id", "hour", "n")


def policy(df: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The first rule that holds: costly tokens that repeat or are slow, injection words, markup in the payload, else benign.

    df: event_id, user_id, ts, tokens, latency, payload.
    """
    top = F.broadcast(quantiles(df, "tokens", [0.975]).agg(F.max(F.col("p")[0]).alias("cap")))  # one row
    w = Window.partitionBy("user_id", "slice").orderBy("at").rangeBetween(-600_000_000, 0)
    big = df.crossJoin(top).withColumn("big", (F.col("tokens") > F.col("cap")).cast("int"))
    e = sliced(big, 600_000_000).withColumn("repeats", F.sum("big").over(w)).where("own")
    low = F.lower("payload")
    rule = F.when((F.col("big") == 1) & ((F.col("repeats") > 3) | (F.col("latency") > 300)), "LLM09").when(low.rlike("ignore (all|previous)|jailbreak|system prompt"), "LLM01").when(low.rlike("<script|<html|select .* from|drop table"), "LLM05").otherwise("BENIGN")
    tactic = F.create_map(*[F.lit(x) for x in ("LLM09", "TA0042", "LLM01", "TA0031", "LLM05", "TA0027", "BENIGN", "N/A")])
    return e.select("event_id", rule.alias("category"), F.element_at(tactic, rule).alias("tactic"), (rule != "BENIGN").cast("int").alias("label"))


def strict_cost_attacks(df: DataFrame) -> DataFrame:
    """The stricter reading of costly use: tokens over the 97.5th percentile within an hour that is a burst of its user."""
    top = F.broadcast(quantiles(df, "tokens", [0.975]).agg(F.max(F.col("p")[0]).alias("cap")))  # one row
    hot = bursts(df).select("user_id", "hour")
    return df.crossJoin(top).where("tokens > cap").withColumn("hour", F.date_trunc("hour", "ts")).join(hot, ["user_id", "hour"], "left_semi").select("event_id", "user_id", "tokens")


def benign_guard(df: DataFrame) -> DataFrame:
    """Whether a request is ordinary: tokens between the 5th and 95th percentile, similarity under 0.75, latency under its 95th.

    df: event_id, tokens, latency, similarity.
    """
    t = quantiles(df, "tokens", [0.05, 0.95]).select(F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    q = quantiles(df, "latency", [0.95]).select(F.col("p")[0].alias("slow"))
    ok = F.col("tokens").between(F.col("lo"), F.col("hi")) & (F.col("similarity") < 0.75) & (F.col("latency") <= F.col("slow"))
    return df.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(q)).select("event_id", F.when(ok, "BENIGN").otherwise("REVIEW").alias("category"), F.when(ok, "N/A").alias("tactic"))


def injections(df: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Prompt injection by words (LLM01) or by similarity to known prompts (LLM04). df: event_id, payload, similarity."""
    words = F.lower("payload").rlike("ignore (all|previous)|jailbreak|system prompt")
    category = F.when(words, "LLM01").when(F.col("similarity") >= threshold, "LLM04")
    return df.select("event_id", category.alias("category"), F.when(category == "LLM01", "TA0031").when(category == "LLM04", "TA0027").alias("tactic")).where("category is not null")


def alert_levels(windows: DataFrame, warn: float = 150.0, critical: float = 200.0) -> DataFrame:
    """Windows (start, p95) whose 95th percentile of latency reaches a level."""
    level = F.when(F.col("p95") >= critical, "critical").when(F.col("p95") >= warn, "warn")
    return windows.select("start", "p95", level.alias("level")).where("level is not null")
