"""Registered queries of preparation, request checks, tests of models, policy variants and further streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.functions import payloads, urls
from quaymark.jobs import detect, prepare
from quaymark.operators import events as ev
from quaymark.operators import learning, metrics, sampling
from quaymark.operators import preparation as pre
from quaymark.sources import feeds
from quaymark.streaming import jobs

from .catalog import ORACLE, QUERIES, _BOUNDS, _END, _PICK, _S, _START, _URL, Tables, query, scored

__all__ = ["ORACLE", "QUERIES"]

_AI = " OR ".join(f"contains(url, '{p}')" for p in pre.AI_PATTERNS)
_DAYS = f"(date_diff('day', DATE '{_START[:10]}', DATE '{_END[:10]}') + 1)"
_MADE = f"""SELECT CASE WHEN id * 3 % 2 = 0 THEN 'http://' ELSE 'https://' END || {_PICK(pre.AUGMENT_HOSTS, "id * 5 + 1")} || {_PICK(pre.AI_PATTERNS, "id * 3 + 2")} || '?id=' || CAST(100 + id * 37 % 900 AS VARCHAR) AS url, 'Synthetic' AS target,
 TIMESTAMP '{_START}' + to_days(CAST(id * 7 % {_DAYS} AS INT)) AS ts, 1 AS is_phishing, true AS is_ai_endpoint FROM (SELECT unnest(range(20)) AS id)
 UNION ALL SELECT * FROM (VALUES {", ".join(f"('{u}', '{n}', TIMESTAMP '{d} 00:00:00', 1, true)" for u, n, d in pre.AUGMENT_ROWS)}) AS v(url, target, ts, is_phishing, is_ai_endpoint)"""
_CRAWL = f"SELECT {_URL} AS url, 'crawl' AS target, CASE WHEN page_id % 5 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(page_id % 600 AS INT)) END AS ts, CASE WHEN page_id % 7 > 0 THEN CAST(page_id % 2 AS INT) END AS is_phishing, page_id FROM pages"


def crawl(t: Tables) -> DataFrame:
    at = F.expr("CASE WHEN page_id % 5 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(page_id % 600 AS INT)) END").cast("timestamp")
    return t.pages.select(F.expr(_URL).alias("url"), F.lit("crawl").alias("target"), at.alias("timestamp"), F.expr("CASE WHEN page_id % 7 > 0 THEN CAST(page_id % 2 AS INT) END").alias("is_phishing"), "page_id")


@query("augment_endpoints", f"WITH c AS ({_CRAWL}) SELECT url, target, ts, is_phishing, coalesce({_AI}, false) AS is_ai_endpoint FROM c UNION ALL {_MADE}")
def augment_endpoints(t):
    return pre.augment(crawl(t).drop("page_id"), _START, _END).select("url", "target", F.col("timestamp").alias("ts"), "is_phishing", "is_ai_endpoint")


@query("reference_source", f"SELECT url, target, ts, is_phishing FROM ({_MADE})")
def reference_source(t):
    """A source of reference material has no rows of its own but those of augmentation."""
    rows = prepare.load_source(t.spark, "prompts", {"type": "jailbreak_reference", "snapshot_file": "prompts.jsonl"}, {"start": _START, "end": _END}, t.folder)
    return pre.augment(rows, _START, _END).select("url", "target", F.col("timestamp").alias("ts"), "is_phishing")


@query("missing_source", f"SELECT 'https://' || {_PICK(feeds.MOCK_HOSTS, 'id * 7 + 3')} || {_PICK(feeds.MOCK_PATHS, 'id * 11 + 5')} || '?campaign=lost' || CAST(id AS VARCHAR) AS url, 'telemetry-campaign' AS target, 1 AS is_phishing FROM (SELECT unnest(range(120)) AS id)")
def missing_source(t):
    """A source whose file is not there gives mock rows."""
    return prepare.load_source(t.spark, "lost", {"type": "telemetry", "snapshot_file": "no_such_feed.csv"}, {"start": _START, "end": _END}, t.folder).select("url", "target", "is_phishing")


_N = lambda c: f"CAST(length(u) - length(replace(u, '{c}', '')) AS BIGINT)"
_PARTS = f"""c AS ({_CRAWL}), p AS (SELECT *, coalesce(url, '') AS u FROM c), q AS (SELECT *, regexp_extract(u, '^[a-zA-Z]+://([^/]+)', 1) AS netloc, regexp_extract(u, '^[a-zA-Z]+://[^/]+([^?#]*)', 1) AS path, regexp_extract(u, '[?]([^#]*)', 1) AS query FROM p)"""
_FRAME = f"""WITH {_PARTS} SELECT page_id, length(u) AS url_length, length(netloc) AS domain_length, length(path) AS path_length, {_N(".")} AS num_dots, {_N("/")} AS num_slashes, CAST(starts_with(u, 'https://') AS INT) AS is_https,
 CAST(contains(u, '/v1/chat/completions') OR contains(u, '/v1/completions') OR contains(u, '/v1/embeddings') OR contains(u, '/v1/models') OR contains(u, '/inference') OR contains(u, '/predict') AS INT) AS is_ai_endpoint, CAST(page_id % 90 AS DOUBLE) AS prompt_tokens, 0e0 AS completion_tokens, coalesce(CASE WHEN page_id % 3 > 0 THEN CAST(page_id AS DOUBLE) END, 0) AS latency_ms, coalesce(is_phishing, 1) AS is_phishing FROM q"""


def frame(t: Tables, profile: str = "url_plus_telemetry") -> DataFrame:
    rows = crawl(t).withColumns({"tokens_prompt": F.col("page_id") % 90, "latency_ms": F.expr("CASE WHEN page_id % 3 > 0 THEN page_id END")})
    return pre.feature_frame(rows, "crawl", profile)


@query("feature_frame", "SELECT count(*) AS n, sum(url_length) AS url_length, sum(domain_length) AS domain_length, sum(path_length) AS path_length, sum(num_dots) AS num_dots, sum(num_slashes) AS num_slashes, CAST(sum(is_https) AS BIGINT) AS is_https, CAST(sum(is_ai_endpoint) AS BIGINT) AS is_ai_endpoint, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, sum(latency_ms) AS latency_ms, is_phishing FROM (" + _FRAME + ") GROUP BY is_phishing")
def feature_frame(t):
    names = ["url_length", "domain_length", "path_length", "num_dots", "num_slashes", "is_https", "is_ai_endpoint", "prompt_tokens", "completion_tokens", "latency_ms"]
    return frame(t).groupBy("is_phishing").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names])


@query("feature_profile", "SELECT count(*) AS n, 15 AS features, 0e0 AS tokens, 0e0 AS latency FROM pages")
def feature_profile(t):
    f = frame(t, "url_only")
    return f.agg(F.count("*").alias("n"), F.lit(len([c for c in f.columns if c in pre.FEATURES])).alias("features"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("latency_ms").alias("latency"))


@query("model_input", "SELECT page_id % 3 AS split_no, count(*) AS n, sum(CASE WHEN page_id % 2 = 0 THEN 1e0 ELSE 0e0 END) AS flag, sum(CASE WHEN page_id % 4 IN (1, 2) THEN 1e0 ELSE 0e0 END) AS x, CAST(sum(CASE WHEN page_id % 5 > 0 THEN page_id % 2 ELSE 0 END) AS BIGINT) AS y FROM pages GROUP BY split_no")
def model_input(t):
    """Booleans, nulls, NaN and infinities of a split as numbers; metadata left out."""
    x = F.expr("CASE page_id % 4 WHEN 0 THEN double('NaN') WHEN 3 THEN double('-Infinity') ELSE 1.0D END")
    rows = t.pages.select((F.col("page_id") % 3).cast("string").alias("split"), (F.col("page_id") % 2 == 0).alias("flag"), x.alias("x"), F.expr("CASE WHEN page_id % 5 > 0 THEN page_id % 2 END").alias("is_phishing"), F.lit("s").alias("source"), F.lit("t").alias("owasp_category"))
    return pre.model_input(rows).groupBy(F.col("split").cast("long").alias("split_no")).agg(F.count("*").alias("n"), F.sum("flag").alias("flag"), F.sum("x").alias("x"), F.sum("y").alias("y"))


_OWASP = "LLM01, LLM05,, LLM09 "
_DRAW = lambda name: f"CAST('0x' || left(md5('{name}:' || doc_id), 8) AS BIGINT)"


@query("assign_taxonomy", f"SELECT doc_id, CASE WHEN toxic = 1 THEN {_PICK(['LLM01', 'LLM05', 'LLM09'], _DRAW('category'))} ELSE 'BENIGN' END AS owasp_category, CASE WHEN toxic = 1 THEN {_PICK(['TA0031', 'TA0042'], _DRAW('tactic'))} ELSE 'N/A' END AS atlas_tactic FROM labels")
def assign_taxonomy(t):
    return pre.assign_taxonomy(t.labels.withColumn("is_phishing", F.col("toxic")), F.col("doc_id"), _OWASP, ["TA0031", "TA0042"]).select("doc_id", "owasp_category", "atlas_tactic")


@query("taxonomy_lists", "SELECT conv_id, turn, array_to_string(CASE WHEN len(x) > 0 THEN x ELSE ['LLM01'] END, '|') AS names FROM (SELECT conv_id, turn, list_filter([trim(w) FOR w IN string_split(CASE turn % 3 WHEN 0 THEN ' a, ,b ' WHEN 1 THEN ' , ' ELSE role END, ',')], lambda w: w <> '') AS x FROM conversations)")
def taxonomy_lists(t):
    text = F.expr("CASE turn % 3 WHEN 0 THEN ' a, ,b ' WHEN 1 THEN ' , ' ELSE role END")
    return t.conversations.select("conv_id", "turn", F.array_join(pre.taxonomy_split(text), "|").alias("names"))


@query("record_ids", "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_type || '_' || strftime(ts, '%Y%m%dT%H%M%S') END AS record_id, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE value END AS x FROM events")
def record_ids(t):
    ts = F.when(F.col("event_id") % 7 > 0, F.col("ts").cast("timestamp"))
    x = F.expr("CASE event_id % 3 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') ELSE value END")
    return t.events.select("event_id", pre.record_id(F.col("event_type"), ts).alias("record_id"), payloads.finite(x).alias("x"))


@query("request_validation", "SELECT status, problem, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN 422 WHEN 1 THEN 422 WHEN 2 THEN 422 WHEN 3 THEN 422 ELSE 200 END AS status, CASE event_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'length' WHEN 2 THEN 'length' WHEN 3 THEN 'null' END AS problem FROM events) GROUP BY ALL")
def request_validation(t):
    of = lambda n: F.array_repeat(F.col("value"), n)
    features = F.when(F.col("event_id") % 5 == 1, of(14)).when(F.col("event_id") % 5 == 2, of(16)).when(F.col("event_id") % 5 == 3, F.concat(of(14), F.array(F.lit(None).cast("double")))).when(F.col("event_id") % 5 == 4, of(15))
    return pre.validated(t.events.select("event_id", features.alias("features"))).groupBy("status", "problem").agg(F.count("*").alias("n"))


@query("spot_checks", "SELECT source AS reviewer, count(*) AS n, count(*) FILTER (doc_id % 4 = 0) AS checked, CAST(count(*) FILTER (doc_id % 4 = 0) >= 0.2 * count(*) AS INT) AS enough, count(*) // 50 AS checks_due FROM documents GROUP BY source")
def spot_checks(t):
    return pre.spot_checks(t.documents.select(F.col("source").alias("reviewer"), F.when(F.col("doc_id") % 4 == 0, 1).alias("second")))


@query("rater_pairs", "WITH l AS (SELECT user_id AS record_id, CAST(max_by(event_type, epoch_us(ts)) AS VARCHAR) AS log_label, count(*) AS log_rows FROM events GROUP BY user_id) SELECT c_custkey AS record_id, c_mktsegment AS label, log_label, log_rows FROM customer LEFT JOIN l ON c_custkey = record_id")
def rater_pairs(t):
    """An audit log with many rows of a record does not multiply the pairs."""
    log = t.events.select(F.col("user_id").alias("record_id"), F.col("event_type").alias("label"), F.col("ts").alias("timestamp"))
    return pre.rater_pairs(t.customer.select(F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("label")), log)


@query("first_of_batch", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 1")
def first_of_batch(t):
    return pre.first_of_batch(t.pages.select("page_id", "url"), "page_id")


@query("class_extremes", "WITH c AS (SELECT quality AS y, count(*) AS n FROM labels GROUP BY y) SELECT (SELECT y FROM c ORDER BY n DESC, y LIMIT 1) AS majority, (SELECT y FROM c ORDER BY n, y LIMIT 1) AS minority")
def class_extremes(t):
    return pre.class_extremes(t.labels, "quality")


_INSIDE = lambda a, b: f"ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'"
_HOLES = {"train": (_START, "2024-01-10 23:59:59"), "test": ("2024-01-12 00:00:00", _END)}


@query("split_counters", f"SELECT count(*) AS n, count(*) FILTER (NOT {_INSIDE(_START, _END)}) AS outside_window, count(*) FILTER ({_INSIDE(_START, _END)} AND NOT ({' OR '.join(_INSIDE(*b) for b in _HOLES.values())})) AS outside_splits FROM events")
def split_counters(t):
    return pre.split_counters(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", (_START, _END), _HOLES)


# tails by Simpson's rule on the densities, 2,000 steps
_SIMPSON = lambda top, density, steps=2000: f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density(f'(({top}) * i / {steps}e0)')})) * ({top}) / {3 * steps}e0)"
_NORMAL_P = lambda z: f"(1 - 2 * {_SIMPSON(f'least(abs({z}), 12)', lambda x: f'exp(-{x} * {x} / 2)')} / sqrt(2 * pi()))"
_T_DENSITY = lambda v: (lambda x: f"exp(lgamma(({v} + 1) / 2e0) - lgamma({v} / 2e0) - ({v} + 1) / 2e0 * ln(1 + {x} * {x} / {v})) / sqrt({v} * pi())")
_T_P = lambda t, v: f"(1 - 2 * {_SIMPSON(f'abs({t})', _T_DENSITY(v))})"
_ODDS = f"WITH {_S}, o AS (SELECT count(*) FILTER (a AND NOT d) AS b, count(*) FILTER (NOT a AND d) AS c FROM (SELECT (p >= 0.5) = (y = 1) AS a, (q >= 0.5) = (y = 1) AS d FROM s)), x AS (SELECT b, c, round(coalesce(pow(abs(b - c) - 1, 2) / nullif(CAST(b + c AS DOUBLE), 0), 0), 6) AS chi2 FROM o)"


@query("mcnemar_test", f"{_ODDS} SELECT b, c, chi2, round({_NORMAL_P('sqrt(chi2)')}, 9) AS p_value FROM x")
def mcnemar_test(t):
    return metrics.mcnemar_test(scored(t))


# the t quantile by Newton's method from the normal one, each step with the integral of the density
_NEWTON = lambda a, b: f"{b} AS (SELECT n, m, s, v, x - (0.5 + {_SIMPSON('x', _T_DENSITY('v'))} - 0.975e0) / ({_T_DENSITY('v')('x')}) AS x FROM {a})"


@query("t_interval", f"WITH g0 AS (SELECT count(value) AS n, avg(value) AS m, stddev_samp(value) / sqrt(count(value)) AS s, CAST(count(value) - 1 AS DOUBLE) AS v, 1.96e0 AS x FROM events), {_NEWTON('g0', 'g1')}, {_NEWTON('g1', 'g2')}, {_NEWTON('g2', 'g3')}, {_NEWTON('g3', 'g4')} SELECT n, round(m, 6) AS mean, round(s, 6) AS sem, round(m - x * s, 6) AS low, round(m + x * s, 6) AS high FROM g4")
def t_interval(t):
    return metrics.interval(t.events, "value")


@query("paired_tests", f"""WITH {_S}, d AS (SELECT p - q AS d FROM s), r AS (SELECT d, rank() OVER (ORDER BY round(abs(d), 9)) + (count(*) OVER (PARTITION BY round(abs(d), 9)) - 1) / 2e0 AS k, count(*) OVER (PARTITION BY round(abs(d), 9)) AS m FROM d WHERE round(abs(d), 9) > 0),
 w AS (SELECT sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS w, CAST(count(*) AS DOUBLE) AS k, sum(CAST(m AS DOUBLE) * m - 1) AS tied FROM r), z AS (SELECT (w - k * (k + 1) / 4) / sqrt(k * (k + 1) * (2 * k + 1) / 24 - tied / 48) AS z FROM w),
 g AS (SELECT count(*) AS n, avg(d) AS m, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d) SELECT n, round(m, 6) AS mean, round(t, 4) AS t, round({_T_P('t', '(n - 1)')}, 9) AS t_p, round(z, 4) AS z, round({_NORMAL_P('z')}, 9) AS wilcoxon_p FROM g, z""")  # fmt: skip
def paired_tests(t):
    return metrics.paired_tests(scored(t), "p", "q")


@query("detector_gate", f"WITH {_S}, c AS (SELECT count(*) FILTER ((p >= 0.5) = (y = 1)) AS ok, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 OR y = 1) AS any_, count(*) AS n, avg(q * 100) AS a, quantile_cont(q * 100, 0.95) AS p95 FROM s) SELECT round(ok / CAST(n AS DOUBLE), 6) AS accuracy, round(2e0 * tp / (any_ + tp), 6) AS f1, round(a, 6) AS avg_latency, round(p95, 6) AS p95, CAST(round(p95, 6) < 96 AS INT) AS meets_target FROM c")
def detector_gate(t):
    return metrics.gate(scored(t).withColumn("ms", F.col("q") * 100), "ms", 96.0)


@query("benford_test", "WITH d AS (SELECT CAST(left(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR), 1) AS INT) AS digit FROM lineitem), c AS (SELECT digit, CAST(count(*) AS DOUBLE) AS n FROM d WHERE digit > 0 GROUP BY digit), t AS (SELECT sum(n) AS t FROM c), e AS (SELECT i AS digit, t * log10(1 + 1e0 / i) AS e, t FROM t, (SELECT unnest(range(1, 10)) AS i)) SELECT CAST(max(t) AS BIGINT) AS n, round(sum(pow(coalesce(n, 0) - e, 2) / e), 4) AS chi2, CAST(sum(pow(coalesce(n, 0) - e, 2) / e) <= 15.507 AS INT) AS complies FROM e LEFT JOIN c USING (digit)")
def benford_test(t):
    """Chi squared of leading digits against Benford's law, with the 5 % limit of eight degrees of freedom."""
    d = t.lineitem.select(F.left(F.floor("l_extendedprice").cast("string"), F.lit(1)).cast("int").alias("digit")).where("digit > 0")
    c = d.groupBy("digit").agg(F.count("*").cast("double").alias("n"))
    all_ = t.spark.range(1, 10).select(F.col("id").cast("int").alias("digit")).join(c, "digit", "left").na.fill(0.0).crossJoin(F.broadcast(c.agg(F.sum("n").alias("t"))))
    e = F.col("t") * F.log10(1 + 1.0 / F.col("digit"))
    g = all_.agg(F.max("t").cast("long").alias("n"), F.sum(F.pow(F.col("n") - e, 2) / e).alias("x"))
    return g.select("n", F.round("x", 4).alias("chi2"), (F.col("x") <= 15.507).cast("int").alias("complies"))


@query("anonymised_times", "SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS who, date_trunc('hour', ts) AS hour FROM events")
def anonymised_times(t):
    return t.events.select("event_id", F.sha2(F.col("user_id").cast("string"), 256).alias("who"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))


@query("ensemble_average", f"WITH {_S}, l AS (SELECT doc_id % 10 AS batch, 'p' AS model, avg(1 - abs(p - y)) AS perf FROM s GROUP BY batch UNION ALL SELECT doc_id % 10, 'q', avg(1 - abs(q - y)) FROM s GROUP BY 1), w AS (SELECT model, least(sum(0.1 * pow(0.9e0, 9 - batch) * perf) + 0.5 * pow(0.9e0, 10), max(1 / (2 * (1 - least(perf, 0.999999))))) AS w FROM l GROUP BY model) SELECT model, round(w / sum(w) OVER (), 6) AS weight FROM w")
def ensemble_average(t):
    """Weights as a moving average of ten batches' performance, each at most its bound, made to sum to 1; in closed form."""
    s = scored(t).select(F.pmod("doc_id", F.lit(10)).alias("batch"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (1 - F.abs(F.col(m) - F.col("y"))).alias("ok")) for m in "pq"])).alias("x"))
    perf = s.groupBy("batch", "x.model").agg(F.avg("x.ok").alias("perf"))
    moved = F.sum(0.1 * F.pow(F.lit(0.9), 9 - F.col("batch")) * F.col("perf")) + 0.5 * 0.9**10
    w = perf.groupBy("model").agg(F.least(moved, F.max(1 / (2 * (1 - F.least(F.col("perf"), F.lit(0.999999)))))).alias("w"))
    return w.crossJoin(F.broadcast(w.agg(F.sum("w").alias("s")))).select("model", F.round(F.col("w") / F.col("s"), 6).alias("weight"))


_EV = "e AS (SELECT event_id, user_id, ts, CAST(json_extract(props, '$.k') AS DOUBLE) AS tokens, value AS latency, (event_id * 7919 % 1000) / 1e3 AS similarity, CASE event_id % 5 WHEN 0 THEN 'Ignore all rules' ELSE event_type END AS payload FROM events)"


def requests(t: Tables) -> DataFrame:
    payload = F.expr("CASE event_id % 5 WHEN 0 THEN 'Ignore all rules' ELSE event_type END")
    return t.events.select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("double").alias("tokens"), F.col("value").alias("latency"), (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 1e3).alias("similarity"), payload.alias("payload"))


@query("strict_cost_attacks", f"WITH {_EV}, h AS (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM e GROUP BY ALL), b AS (SELECT user_id, avg(n) AS m, stddev_pop(n) AS s FROM h GROUP BY user_id), x AS (SELECT user_id, hour FROM h JOIN b USING (user_id) WHERE n > m + 3 * s + 1e-9), c AS (SELECT quantile_cont(tokens, 0.975) AS cap FROM e) SELECT event_id, user_id, tokens FROM e, c WHERE tokens > cap AND (user_id, date_trunc('hour', ts)) IN (SELECT (user_id, hour) FROM x)")
def strict_cost_attacks(t):
    return ev.strict_cost_attacks(requests(t))


@query("benign_guard", f"WITH {_EV}, c AS (SELECT quantile_cont(tokens, 0.05) AS lo, quantile_cont(tokens, 0.95) AS hi, quantile_cont(latency, 0.95) AS slow FROM e) SELECT event_id, CASE WHEN tokens BETWEEN lo AND hi AND similarity < 0.75 AND latency <= slow THEN 'BENIGN' ELSE 'REVIEW' END AS category, CASE WHEN tokens BETWEEN lo AND hi AND similarity < 0.75 AND latency <= slow THEN 'N/A' END AS tactic FROM e, c")
def benign_guard(t):
    return ev.benign_guard(requests(t))


@query("injections", f"WITH {_EV} SELECT event_id, CASE WHEN regexp_matches(lower(payload), 'ignore (all|previous)|jailbreak|system prompt') THEN 'LLM01' ELSE 'LLM04' END AS category, CASE WHEN regexp_matches(lower(payload), 'ignore (all|previous)|jailbreak|system prompt') THEN 'TA0031' ELSE 'TA0027' END AS tactic FROM e WHERE regexp_matches(lower(payload), 'ignore (all|previous)|jailbreak|system prompt') OR similarity >= 0.75")
def injections(t):
    return ev.injections(requests(t))


_WINDOWS = "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, round(quantile_cont(value * 4, 0.95), 6) AS p95 FROM events GROUP BY start"


@query("alert_levels", f"SELECT start, p95, CASE WHEN p95 >= 200 THEN 'critical' ELSE 'warn' END AS level FROM ({_WINDOWS}) WHERE p95 >= 150")
def alert_levels(t):
    return ev.alert_levels(ev.tumbling(t.events.withColumn("value", F.col("value") * 4)))


@query("attack_samples", "SELECT * FROM (VALUES " + ", ".join(f"('{u}', '{p}', '{k}')" for u, p, k in pre.ATTACKS) + ") AS v(url, payload, type)")
def attack_samples(t):
    return pre.attack_samples(t.spark)


_SPLIT_STATS = " UNION ALL ".join(f"SELECT '{k}' AS split, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END), 6) AS phishing_ratio FROM events WHERE ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for k, (a, b) in _BOUNDS.items())


@query("dataset_report", f"WITH r AS ({_SPLIT_STATS}) SELECT r.*, (SELECT count(*) FROM events WHERE NOT {_INSIDE(_START, _END)}) AS dropped_outside_window, '{_START}' AS window_start, '{_END}' AS window_end, '{','.join(pre.FEATURES)}' AS features FROM r")
def dataset_report(t):
    """Statistics of splits with the counters and settings that a processed table is described by."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    s = sampling.split_by_time(e, "ts", _BOUNDS).groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("phishing_ratio"))
    lost = pre.split_counters(e, "ts", (_START, _END), _BOUNDS).select(F.col("outside_window").alias("dropped_outside_window"))
    return s.crossJoin(F.broadcast(lost)).select("*", F.lit(_START).alias("window_start"), F.lit(_END).alias("window_end"), F.lit(",".join(pre.FEATURES)).alias("features"))


def _stream(t: Tables) -> DataFrame:
    return jobs.events(t.spark, f"{t.folder}/events.parquet")


@query("stream_monitor", "SELECT decision, category, count(*) AS n, round(sum(probability), 4) AS total FROM (SELECT round(value / 1e3, 6) AS probability, CAST(round(value / 1e3, 6) >= 0.03 AS INT) AS decision, CASE WHEN event_id % 3 = 0 THEN 'N/A' WHEN event_id % 3 = 2 THEN 'LLM01' END AS category FROM events) GROUP BY ALL")
def stream_monitor(t):
    """Monitor rows of a stream, appended to a table."""
    context = F.when(F.col("event_id") % 3 != 0, F.struct(F.when(F.col("event_id") % 3 == 2, "LLM01").alias("category"), F.lit("TA0031").alias("tactic")))
    lines = jobs.monitor(_stream(t).select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("record_id"), F.round(F.col("value") / 1e3, 6).alias("probability"), context.alias("context")))
    return jobs.run(lines, "append").groupBy("decision", "category").agg(F.count("*").alias("n"), F.round(F.sum("probability"), 4).alias("total"))


@query("stream_batches", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_batches(t):
    """Micro-batches of requests that are summed as they come and put together after."""
    parts = jobs.batches(_stream(t), lambda df: df.groupBy("event_type", "batch").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    return jobs.summed(parts, ["event_type"]).select("event_type", "n", F.round("total", 2).alias("total"))


@query("stream_rate_drift", "WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END) AS rate FROM events GROUP BY day), w AS (SELECT *, avg(rate) OVER x AS m, stddev_samp(rate) OVER x AS s FROM d WINDOW x AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) SELECT CAST(day AS VARCHAR) AS day, round(rate, 6) AS rate, round(m, 6) AS mean_7d, coalesce(CAST(abs(rate - m) > 3 * s AS INT), 0) AS alert FROM w")
def stream_rate_drift(t):
    """Days' counts from a stream, batch by batch, then their drift."""
    days = jobs.summed(jobs.batches(_stream(t), jobs.day_counts), ["day"])
    return jobs.rate_drift(days).withColumn("day", F.col("day").cast("string"))


@query("stream_median_drift", "SELECT date_trunc('hour', ts) AS hour, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY hour HAVING quantile_cont(value, 0.5) < 20")
def stream_median_drift(t):
    return jobs.run(jobs.median_drift(_stream(t), 20.0), "complete")


@query("stream_shadow", "SELECT live, shadow, count(*) AS n FROM (SELECT CAST(value >= 20 AS INT) AS live, CAST(event_id % 4 = 0 AS INT) AS shadow FROM events) GROUP BY ALL")
def stream_shadow(t):
    """Live and shadow decisions of two streams, joined on the request within five minutes."""
    live = _stream(t).select("event_id", "ts", (F.col("value") >= 20).cast("int").alias("decision"))
    shadow = _stream(t).select("event_id", "ts", (F.col("event_id") % 4 == 0).cast("int").alias("decision"))
    return jobs.run(jobs.shadowed(live, shadow), "append").groupBy("live", "shadow").agg(F.count("*").alias("n"))


def hard_rows(t: Tables) -> DataFrame:
    """15-column rows whose classes overlap: labels of documents go with telemetry that only leans their way."""
    noise = F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000.0
    rows = t.labels.select("doc_id", F.col("quality").alias("is_phishing"), F.concat(F.lit("https://h"), F.col("doc_id").cast("string"), F.lit(".example/p?a=1")).alias("url"), F.lit(None).cast("timestamp").alias("timestamp"), (100 + 60 * F.col("quality") + 140 * noise).alias("tokens_prompt"), (50 + 100 * F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1000)) / 1000.0).alias("tokens_completion"), (80 - 20 * F.col("quality") + 60 * noise).alias("latency_ms"))
    part = lambda name, held: pre.feature_frame(rows.where((F.pmod("doc_id", F.lit(10)) >= 7) == held), "hard").withColumn("split", F.lit(name))
    return pre.model_input(part("train", False).unionByName(part("test", True)))


@query("legacy_forest")
def legacy_forest(t):
    """A fitted model, so no SQL: tested by held-out accuracy."""
    return learning.evaluate(learning.legacy_forest(pre.FEATURES), hard_rows(t), "legacy_forest")


@query("forest_ablations")
def forest_ablations(t):
    """Fitted models, so no SQL: tested by held-out accuracy."""
    return learning.ablations(hard_rows(t), pre.FEATURES, detect.FAMILIES, kinds={"logistic": learning.logistic, "forest": learning.forest})
