"""Registered queries of streaming scoring, as-of joins, state, sketches, pruned similarity, exact tests, validation and ordered reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.operators import asof, distinct, learning, preparation, sampling, similarity
from quaymark.sources import feeds
from quaymark.streaming import jobs, scoring, store

from .catalog import ORACLE, QUERIES, Tables, query
from .preparing import _stream, hard_rows

__all__ = ["ORACLE", "QUERIES"]

_WEIGHTS = {"url_length": 0.02, "num_dots": -0.03, "prompt_tokens": 0.03}


def asked(events: DataFrame) -> DataFrame:
    """Requests made of events: some with too few features, without any, or with a null among them."""
    k = F.get_json_object("props", "$.k").cast("double")
    full = F.array(F.col("value"), F.lit(1.0), F.lit(2.0), F.pmod("event_id", F.lit(9)).cast("double"), *[F.lit(0.0)] * 8, k, F.col("value") * 2, F.when(F.col("event_id") % 2 == 0, F.lit(float("inf"))).otherwise(1.0))
    features = F.when(F.col("event_id") % 11 == 0, F.slice(full, 1, 14)).when(F.col("event_id") % 13 == 0, F.lit(None)).when(F.col("event_id") % 17 == 0, F.concat(F.slice(full, 1, 14), F.array(F.lit(None).cast("double")))).otherwise(full)
    context = F.when(F.col("event_id") % 3 != 0, F.struct(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("record_id"), F.when(F.col("event_id") % 3 == 2, "LLM01").alias("owasp_category"), F.lit("TA0031").alias("atlas_tactic")))
    return events.select(features.alias("features"), context.alias("context"), F.col("ts").alias("received"))


def score_stream(t: Tables) -> str:
    """Saves a model, loads it, scores the events' requests as a stream; the folder with what it wrote."""
    home = jobs.shared(t.spark)
    learning.linear(_WEIGHTS, -4.0).write().overwrite().save(f"{home}/model")
    model = learning.PipelineModel.load(f"{home}/model")
    scoring.start(asked(_stream(t)), scoring.Sinks(home, model, "linear-1")).awaitTermination()
    return home


_ASKED = """a AS (SELECT event_id, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 11 = 0 THEN 'length' WHEN event_id % 13 = 0 THEN 'missing' WHEN event_id % 17 = 0 THEN 'null' END AS problem FROM events),
 p AS (SELECT *, 1 / (1 + exp(-(-4 + 0.02e0 * value - 0.03e0 * (event_id % 9) + 0.03e0 * k))) AS p FROM a WHERE problem IS NULL)"""


@query("stream_scoring", f"WITH {_ASKED} SELECT CAST(p >= 0.03 AS INT) AS decision, round(p, 6) AS probability, CASE event_id % 3 WHEN 0 THEN 'N/A' WHEN 2 THEN 'LLM01' END AS owasp_category, CASE event_id % 3 WHEN 0 THEN 'N/A' ELSE 'TA0031' END AS atlas_tactic, k AS prompt_tokens, value * 2 AS completion_tokens, 'linear-1' AS model_version, 'v2025.08.10' AS feature_version, CASE WHEN event_id % 3 <> 0 THEN 'r' || event_id END AS record_id, true AS timed FROM p")
def stream_scoring(t):
    """Monitor records of valid requests, all fields but id and time, of which only that they are there."""
    monitor, _, _ = scoring.committed(t.spark, score_stream(t))
    timed = F.col("request_id").rlike("^[0-9a-f]{32}$") & F.col("timestamp").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$") & (F.col("latency_ms") > 0) & F.col("line").startswith('MONITOR {"request_id":')
    return monitor.select("decision", F.round("probability", 6).alias("probability"), *scoring.FIELDS[5:], timed.alias("timed"))


@query("stream_rejects", f"WITH {_ASKED} SELECT problem AS outcome, count(*) AS n FROM a WHERE problem IS NOT NULL GROUP BY problem UNION ALL SELECT 'accepted', count(*) FROM p UNION ALL SELECT 'flagged', count(*) FROM p WHERE p >= 0.03")
def stream_rejects(t):
    """Rejected requests by what is wrong with them, and the batches' own counts of the others."""
    _, rejected, batches = scoring.committed(t.spark, score_stream(t))
    sums = batches.select(F.explode(F.array(*[F.struct(F.lit(c).alias("outcome"), F.col(c).alias("n")) for c in ("accepted", "flagged")])).alias("x")).groupBy("x.outcome").agg(F.sum("x.n").alias("n"))
    return rejected.groupBy(F.col("problem").alias("outcome")).agg(F.count("*").alias("n")).unionByName(sums)


_CHANGES = "changes AS (SELECT user_id, ts AS changed, max(event_id) AS change_id FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id, ts)"


def _asof(t: Tables, tolerance: str | None, **more) -> DataFrame:
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    left = e.where("event_type = 'purchase'").select("event_id", F.when(F.col("event_id") % 9 > 0, F.col("user_id")).alias("user_id"), "ts")
    right = e.where("event_type IN ('signup', 'error')").select("user_id", F.col("ts").alias("changed"), F.col("event_id").alias("change_id"), "event_type")
    return asof.as_of(left, right, ["user_id"], "ts", "changed", ["change_id", "event_type"], "change_id", tolerance, **more)


_ASOF = f"WITH {_CHANGES}, p AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN user_id END AS user_id, ts FROM events WHERE event_type = 'purchase'), j AS (SELECT p.*, changed, change_id FROM p ASOF LEFT JOIN changes c ON p.user_id = c.user_id AND p.ts >= c.changed)"


@query("asof_context", f"{_ASOF} SELECT j.event_id, changed, change_id, e.event_type AS kind FROM j LEFT JOIN events e ON e.event_id = change_id")
def asof_context(t):
    """Each purchase with the user's last sign-up or error before it, whenever that was."""
    return _asof(t, None).select("event_id", F.col("changed_found").alias("changed"), "change_id", F.col("event_type").alias("kind"))


@query("asof_churn", f"{_ASOF} SELECT coalesce(CAST(ts - changed <= INTERVAL 10 MINUTES AS INT), 0) AS churn, count(*) AS n, count(DISTINCT user_id) AS users FROM j GROUP BY churn")
def asof_churn(t):
    """Purchases whose user had a sign-up or error within the ten minutes before, and the others."""
    j = _asof(t, "10 minutes")
    return j.groupBy(F.col("change_id").isNotNull().cast("int").alias("churn")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("stream_session_store", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
 SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 0), 6) AS per_minute, max_by(event_type, (ts, event_id)) AS last_type FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTES""")  # fmt: skip
def stream_session_store(t):
    """Sessions that the store has closed: length, rate and last context."""
    found = jobs.run(store.sessions(_stream(t)), "append").where("closed")
    return found.select("user_id", "start", "n", F.round("total", 4).alias("total"), F.round("per_minute", 6).alias("per_minute"), "last_type")


_RANKED = "SELECT date_trunc('hour', ts) AS hour, count(value) AS n FROM events GROUP BY hour"


@query("stream_quantile_sketch", f"SELECT hour AS start, n, true AS median_near, true AS p95_near FROM ({_RANKED})")
def stream_quantile_sketch(t):
    """Hours' sketched median and 95th percentile from a stream, each held against its true rank: within a hundredth."""
    found = jobs.sketch_quantiles(jobs.run(jobs.sketched(_stream(t), "1 hour"), "complete"), [0.5, 0.95])
    true = t.events.select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start"), "value").join(found, "start")
    rank = lambda i, op: F.count_if(op(F.col("value"), F.col("quantiles")[i])) / F.max("n")
    near = lambda i, q: (rank(i, lambda a, b: a < b) <= q + 0.01) & (rank(i, lambda a, b: a <= b) >= q - 0.01)
    return true.groupBy("start").agg(F.max("n").alias("n"), near(0, 0.5).alias("median_near"), near(1, 0.95).alias("p95_near"))


@query("merged_quantile_sketch", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(value) AS n, true AS near FROM events GROUP BY day")
def merged_quantile_sketch(t):
    """Days' medians from five-minute sketches, without the values; each within a hundredth of its true rank."""
    day = F.to_date("start").cast("string").alias("day")
    days = jobs.sketch_quantiles(jobs.merged(jobs.sketched(t.events), day), [0.5])
    true = t.events.select(F.to_date("ts").cast("string").alias("day"), "value").join(days, "day")
    below, upto = (F.count_if(c) / F.max("n") for c in (F.col("value") < F.col("quantiles")[0], F.col("value") <= F.col("quantiles")[0]))
    return true.groupBy("day").agg(F.max("n").alias("n"), ((below <= 0.51) & (upto >= 0.49)).alias("near"))


@query("similar_prompts", "WITH c AS (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT e.vec_id, id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS cosine FROM embeddings e, c WHERE e.vec_id <> id) SELECT vec_id, id, round(cosine, 6) AS cosine FROM x WHERE cosine >= 0.3")
def similar_prompts(t):
    """Pairs of a vector and one of the stated reference set, whose ids are divisible by 50, from a cosine on."""
    corpus = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), "embedding")
    return similarity.similar(t.embeddings, corpus, 0.3).where("vec_id <> id").select("vec_id", "id", F.round("cosine", 6).alias("cosine"))


@query("first_in_file_order", "SELECT CAST(row_number() OVER () - 1 AS BIGINT) AS ordinal, l_orderkey, l_linenumber FROM lineitem LIMIT 5000")
def first_in_file_order(t):
    """The first rows of a table as they stand in its files (how many is what is asked for)."""
    rows = feeds.numbered(t.lineitem.select("l_orderkey", "l_linenumber"), until=5000)
    return rows.where("ordinal < 5000").select("ordinal", "l_orderkey", "l_linenumber")


@query("file_order_gaps", "WITH r AS (SELECT row_number() OVER () - 1 AS i, l_orderkey AS k FROM lineitem) SELECT count(*) AS n, CAST(max(i) AS BIGINT) AS last, CAST(sum(i * (k % 97)) AS BIGINT) AS weighed FROM r")
def file_order_gaps(t):
    """Every row's place in its file, summed up with a weight that another order would change."""
    rows = feeds.numbered(t.lineitem.select("l_orderkey"), "i")
    return rows.agg(F.count("*").alias("n"), F.max("i").alias("last"), F.sum(F.col("i") * (F.col("l_orderkey") % 97)).alias("weighed"))


_RATED = "r AS (SELECT source AS reviewer, doc_id, quality AS a, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END END AS b, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS k FROM documents JOIN labels USING (doc_id))"


@query("agreement_checks", f"""WITH {_RATED}, f AS (SELECT reviewer, k FROM r GROUP BY ALL HAVING count(*) = 50), g AS (SELECT reviewer, k, count(b) AS t, count(*) FILTER (a = b) / CAST(nullif(count(b), 0) AS DOUBLE) AS po, avg(a) FILTER (b IS NOT NULL) AS pa, avg(b) AS pb FROM r JOIN f USING (reviewer, k) GROUP BY ALL)
 SELECT reviewer, CAST(k AS BIGINT) AS "check", t AS pairs, round(po, 6) AS agreement, round(CASE WHEN t > 0 THEN coalesce((po - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0), 1) END, 6) AS kappa FROM g""")  # fmt: skip
def agreement_checks(t):
    """Cohen's kappa of every fifty ratings of a reviewer."""
    d = t.documents.select("doc_id", F.col("source").alias("reviewer")).join(t.labels, "doc_id")
    second = F.when(F.col("doc_id") % 4 == 0, F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return preparation.agreement_checks(d.select("reviewer", "doc_id", F.col("quality").alias("first"), second.alias("second")), "doc_id")


@query("distinct_sketches", "WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events FROM events GROUP BY day) SELECT day, users, events, true AS near FROM d UNION ALL SELECT 'all', (SELECT count(DISTINCT user_id) FROM events), (SELECT count(DISTINCT event_id) FROM events), true")
def distinct_sketches(t):
    """Distinct users and events by day and in all, exactly, and whether the stored days' sketches come within a fiftieth."""
    home = jobs.shared(t.spark)
    days = t.events.select(F.to_date("ts").cast("string").alias("day"), "user_id", "event_id")
    distinct.store(days, "day", ["user_id", "event_id"], home)
    near = distinct.by_key(t.spark, home, "day").unionByName(distinct.overall(t.spark, home).withColumn("day", F.lit("all")))
    exact = days.groupBy("day").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("events"))
    whole = days.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("events")).withColumn("day", F.lit("all"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(0.02 * F.col(b), F.lit(0.5))
    return exact.unionByName(whole).join(near, "day").select("day", "users", "events", (close("user_id", "users") & close("event_id", "events")).alias("near"))


def mislabelled(rows: DataFrame) -> DataFrame:
    key = F.xxhash64(*preparation.FEATURES)
    return rows.withColumns({"row": key, "y": F.when(F.pmod(key, F.lit(100)) < 15, 1 - F.col("y")).otherwise(F.col("y"))})


@query("cross_validation")
def cross_validation(t):
    """Five-fold means and intervals of a logistic model on rows of which every seventh or so has the other label; fitted, so
    no SQL: tested against single fits."""
    rows = mislabelled(hard_rows(t).drop("split"))
    folded = sampling.folds(rows, "y", "row").drop("row")
    found = learning.cross_validated(folded, learning.logistic(preparation.FEATURES))
    return learning.summary(found, ["accuracy", "precision", "recall", "f1", "roc_auc"])
