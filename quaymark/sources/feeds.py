"""Readers of raw feeds and their normal form, generators, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NORMAL = "url string, target string, verified boolean, timestamp timestamp, is_phishing int, tokens_prompt double, tokens_completion double, latency_ms double"
# Hosts and paths of generated rows.
MOCK_HOSTS = ["api.fake-openai.com", "login.model-internal.net", "secure-llm.example.org", "edge.prompt-hijack.biz"]
MOCK_PATHS = ["/v1/completions", "/inference", "/extract", "/models/download", "/prompt/override"]
BENIGN_HOSTS = ["api.one.example", "api.two.example", "api.three.example", "api.four.example", "api.five.example", "api.six.example"]
BENIGN_PATHS = ["/v1/chat/completions", "/v1/completions", "/v1/embeddings", "/v1/models", "/inference", "/predict"]


def read_feed(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, limit: int | None = None) -> DataFrame:
    """A feed by its suffix: .json holds an array, .jsonl a row a line, all else is CSV with # comments; bad fields are null."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".jsonl"):
        df = reader.json(path)
    elif path.endswith(".json"):
        df = reader.option("multiLine", True).json(path)
    else:
        df = reader.option("header", header).option("comment", "#").option("mode", "PERMISSIVE").csv(path)
    return first(df, limit) if limit else df


def numbered(df: DataFrame, name: str = "ordinal", until: int | None = None) -> DataFrame:
    """A frame that a file reader gave, with each row's number from 0 in the order of file names and of rows within a file.

    Rows are counted for each input split; the counts of the splits before, a row a split, say where a split begins, and rows
    are numbered within their split only, so nothing is sorted as a whole. ``until`` drops the splits that begin after so many
    rows, and where only whole files go, these aren't opened. Comments, headers and blank lines are no rows.
    """
    at = [F.col("_metadata.file_path").alias("nb_file"), F.col("_metadata.file_block_start").alias("nb_block")]
    sizes = df.select(*at, *df.columns[:1]).groupBy("nb_file", "nb_block").agg(F.count(F.lit(1)).alias("nb_n"))
    begin = sizes.select("nb_file", "nb_block", (F.sum("nb_n").over(Window.orderBy("nb_file", "nb_block")) - F.col("nb_n")).alias("nb_base"))  # a row a split
    rows = df.select(*df.columns, *at, F.monotonically_increasing_id().alias("nb_id"))
    if until is not None:
        begin = begin.where(F.col("nb_base") < until)
        last = begin.agg(F.max("nb_file")).first()[0]
        rows = rows.where(F.col("_metadata.file_path") <= F.lit(last or ""))
    own = rows.join(F.broadcast(begin) if until is not None else begin, ["nb_file", "nb_block"])  # so many splits as hold ``until`` rows
    inner = F.row_number().over(Window.partitionBy("nb_file", "nb_block").orderBy("nb_id")) - 1
    return own.withColumn(name, F.col("nb_base") + inner).select(*df.columns, name)


def first(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of a frame that a file reader gave, in file order."""
    return numbered(df, "fr_ordinal", n).where(F.col("fr_ordinal") < n).drop("fr_ordinal")


def normalize(df: DataFrame, source: str, start: str, default_label: int = 1, template: str = "https://{domain}/", domain_column: str | None = None, fill: bool = True) -> DataFrame:
    """Any feed in the normal form: names in lower case, URL and time from the first column that offers one, defaults."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    have = set(df.columns)
    if "url" in have:
        url = F.col("url")
    elif domain_column in have:
        before, _, after = template.partition("{domain}")
        url = F.concat(F.lit(before), F.col(domain_column), F.lit(after))
    else:
        found = next((c for c in ("link", "phish_url", "domain") if c in have), None)
        if not found:
            raise ValueError(f"{source}: no column offers a URL")
        url = F.col(found)
    stamp = next((c for c in ("timestamp", "date", "dateadded", "submission_time") if c in have), None)
    ts = F.try_to_timestamp(F.col(stamp).cast("string")) if stamp else F.lit(None).cast("timestamp")
    if fill:
        ts = F.coalesce(ts, F.lit(start).cast("timestamp"))
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    label = F.col("is_phishing").cast("int") if "is_phishing" in have else F.lit(default_label)
    return df.select(
        url.alias("url"), (F.coalesce("target", F.lit(source.replace("_", " "))) if "target" in have else F.lit(source.replace("_", " "))).alias("target"),
        (F.coalesce(F.col("verified").cast("boolean"), F.lit(True)) if "verified" in have else F.lit(True)).alias("verified"), ts.alias("timestamp"), label.alias("is_phishing"),
        number("tokens_prompt").alias("tokens_prompt"), number("tokens_completion").alias("tokens_completion"), number("latency_ms").alias("latency_ms"), F.lit(source).alias("source"),
    )


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def pick(items: list[str], k):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.pmod(k, F.lit(len(items))) + 1).cast("int"))


def spaced(i, n: int, start: str, end: str):
    """The i-th of n evenly spaced instants of a closed window; the start if there is only one."""
    a, b = (F.unix_micros(F.lit(x).cast("timestamp")) for x in (start, end))
    return F.timestamp_micros((a + F.floor((b - a) * i / max(n - 1, 1))).cast("long"))


def mock(spark: SparkSession, name: str, start: str, end: str, n: int = 120, kind: str = "phishing") -> DataFrame:
    """n rows of label 1, evenly spaced, for a source that can't be read; arithmetic on the row number stands for chance."""
    i = F.col("id")
    url = F.concat(F.lit("https://"), pick(MOCK_HOSTS, i * 7 + 3), pick(MOCK_PATHS, i * 11 + 5), F.lit(f"?campaign={name}"), i.cast("string"))
    return spark.range(n).select("id", url.alias("url"), F.lit(f"{kind}-campaign").alias("target"), F.lit(True).alias("verified"), F.lit(1).alias("is_phishing"), spaced(i, n, start, end).alias("timestamp"))


def benign(spark: SparkSession, n: int, start: str, end: str, url_only: bool = False) -> DataFrame:
    """n benign rows, evenly spaced; arithmetic on the row number stands for chance."""
    i = F.col("id")
    number = lambda lo, hi, k: F.lit(0.0) if url_only else (lo + F.pmod(i * k, F.lit(hi - lo))).cast("double")
    scheme = F.when(F.pmod(i * 37, F.lit(100)) >= 15, "https://").otherwise("http://")
    return spark.range(max(n, 0)).select("id", F.concat(scheme, pick(BENIGN_HOSTS, i * 5), pick(BENIGN_PATHS, i * 7)).alias("url"), F.lit(0).alias("is_phishing"), number(50, 600, 131).alias("prompt_tokens"), number(20, 400, 97).alias("completion_tokens"), number(40, 210, 71).alias("latency_ms"), spaced(i, n, start, end).alias("timestamp"))


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_document(df: DataFrame, path: str) -> None:
    """Each row as one JSON object a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
