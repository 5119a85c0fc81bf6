"""Request and payload features, text statistics and record checks, as columns."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words whose presence is counted.
PATH_WORDS = ["admin", "login", "verify", "update", "security"]
ATTACK_WORDS = ["select", "union", "drop", ";--", "script>"]
MODEL_WORDS = ["weights", "parameters", "architecture", "layers"]
IMPERATIVES = ["ignore", "reveal", "print", "show", "tell", "give", "write", "list"]


def present(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words[1:]), F.contains(low, F.lit(words[0])).cast("int")).cast("long")


def depth(payload: Column) -> Column:
    """How deep objects are nested in a JSON text; braces within strings don't count."""
    bare = F.regexp_replace(F.coalesce(payload, F.lit("")), '"(?:[^"\\\\]|\\\\.)*"', "")
    braces = F.regexp_replace(bare, "[^{}]", "")
    step = F.transform(F.split(braces, ""), lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
    at = F.aggregate(step, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most")))
    return F.greatest(at["most"] - 1, F.lit(0)).cast("long")


def request_features(url: Column, payload: Column, tokens: Column, frequency: Column) -> dict[str, Column]:
    """The twelve request features; the payload's length is that of its JSON text."""
    u, body, t = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit("{}")), F.coalesce(tokens, F.lit(""))
    path = F.regexp_extract(u, "^[a-zA-Z]+://[^/]+([^?#]*)", 1)
    return {
        "url_length": F.length(u).cast("long"), "dots": F.regexp_count(u, F.lit("[.]")).cast("long"), "ip": u.rlike(r"\b([0-9]{1,3}[.]){3}[0-9]{1,3}\b").cast("int"), "https": u.rlike("^https:").cast("int"),
        "path_words": present(path, PATH_WORDS), "payload_length": F.length(body).cast("long"), "payload_depth": depth(body), "encoded": body.rlike("[A-Za-z0-9+/]{40,}={0,2}").cast("int"),
        "frequency": F.coalesce(frequency, F.lit(0)).cast("long"), "attack_words": present(body, ATTACK_WORDS), "model_words": present(body, MODEL_WORDS), "long_tokens": F.when(F.length(t) > 100, F.length(t)).otherwise(0).cast("long"),
    }


def imperative_share(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda w: w != "")
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: w.isin(IMPERATIVES))), F.size(words)), F.lit(0.0)).cast("double")


@F.pandas_udf(T.DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """Compressed over plain bytes; Spark has no such function. Null and empty texts give 1."""
    raw = text.fillna("").map(str.encode)
    return raw.map(lambda b: len(zlib.compress(b)) / len(b) if b else 1.0)


def finite(x: Column) -> Column:
    """Null, NaN and infinities as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def cost(prompt: Column, completion: Column) -> Column:
    return prompt / 1000 * 0.01 + completion / 1000 * 0.03


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def violations(url: Column, ts: Column, confidence: Column) -> Column:
    """Names of the rules that a record breaks."""
    rules = {"url": ~F.coalesce(url, F.lit("")).rlike("^https?://"), "timestamp": ts.isNull() | (F.year(ts) < 2000), "confidence": ~F.coalesce(confidence.between(0, 1), F.lit(False))}
    return F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))
