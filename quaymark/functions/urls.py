"""Lexical URL features and checks, as columns. A null URL reads as the empty string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Path substrings that mark an inference endpoint, in the wide and the narrow list.
AI_WIDE = ["/v1/models", "/inference", "/predict", "/complete", "/embeddings", "/classify", "/generate", "/api/v1"]
AI_NARROW = ["/v1/chat/completions", "/v1/completions", "/v1/embeddings", "/v1/models", "/inference", "/predict"]
BRANDS = ["google.com", "paypal.com", "openai.com", "microsoft.com"]
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl"]
TLDS = ["tk", "ml", "ga", "cf", "xyz"]


def parts(url: Column) -> dict[str, Column]:
    """netloc (up to the next slash), host (without a port), path and query."""
    u = F.coalesce(url, F.lit(""))
    netloc = F.regexp_extract(u, "^[a-zA-Z]+://([^/]+)", 1)
    return {"url": u, "netloc": netloc, "host": F.regexp_replace(netloc, ":[0-9]+$", ""), "path": F.regexp_extract(u, "^[a-zA-Z]+://[^/]+([^?#]*)", 1), "query": F.regexp_extract(u, "[?]([^#]*)", 1)}


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def features(url: Column) -> dict[str, Column]:
    """The eleven lexical features, flags as 0 and 1."""
    p = parts(url)
    u = p["url"]
    return {
        "url_length": F.length(u).cast("long"), "domain_length": F.length(p["netloc"]).cast("long"), "path_length": F.length(p["path"]).cast("long"),
        "num_dots": _count(u, "."), "num_hyphens": _count(u, "-"), "num_underscores": _count(u, "_"), "num_slashes": _count(u, "/"),
        "has_ip": p["host"].rlike("^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$").cast("int"), "is_https": u.startswith("https://").cast("int"),
        "has_port": p["netloc"].rlike(":[0-9]+$").cast("int"), "num_params": (_count(p["query"], "&") + (p["query"] != "").cast("int")).cast("long"),
    }


def legacy_features(url: Column) -> dict[str, Column]:
    """The older scalar rules: the authority ends at any of / ? #, an IP need only start it, parameters are split at &."""
    u = F.coalesce(url, F.lit(""))
    netloc = F.regexp_extract(u, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    query = F.regexp_extract(u, "^[^?#]*[?]([^#]*)", 1)
    return {
        "domain_length": F.length(netloc).cast("long"), "has_ip": netloc.rlike("^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+").cast("int"), "is_https": F.lower(F.regexp_extract(u, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)).eqNullSafe("https").cast("int"),
        "has_port": F.regexp_extract(netloc, ":([0-9]+)$", 1).rlike("[1-9]").cast("int"), "num_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("long"),
    }


def ai_endpoint(url: Column, patterns: list[str] = AI_WIDE) -> Column:
    return F.coalesce(url, F.lit("")).rlike("|".join(patterns)).cast("int")


def subdomains(host: Column) -> Column:
    return F.greatest(F.size(F.split(host, "[.]")) - 2, F.lit(0)).cast("long")


def homograph(host: Column) -> Column:
    """A brand's name with 0 for o or 1 for l."""
    return (F.translate(host, "01", "ol").isin(BRANDS) & ~host.isin(BRANDS)).cast("int")


def suspicious(host: Column) -> Column:
    ip = host.rlike("^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$")
    return ((homograph(host) == 1) | F.element_at(F.split(host, "[.]"), -1).isin(TLDS) | ip | host.isin(SHORTENERS)).cast("int")


def error_kind(url: Column, most: int = 2048) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(F.trim(u) == "", "empty").when(F.length(u) > most, "too_large").when(~u.rlike("^https?://[^/?#]+"), "malformed").otherwise("ok")


def variants(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Five disguised forms of each URL, a row each: variant, variant_url."""
    u, host = F.col(url_col), parts(F.col(url_col))["host"]
    rest = F.regexp_replace(u, "^[a-zA-Z]+://[^/]+", "")
    forms = {"homograph": F.replace(F.replace(u, F.lit("o"), F.lit("0")), F.lit("l"), F.lit("1")), "prefix": F.concat(F.lit("https://secure-"), host, rest), "suffix": F.concat(F.lit("https://"), host, F.lit(".phishing.com"), rest), "tld": F.replace(u, F.lit(".com"), F.lit("-com.net")), "encoded": F.replace(F.replace(u, F.lit("/"), F.lit("%2F")), F.lit(":"), F.lit("%3A"))}
    return df.withColumn("v", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), x.alias("variant_url")) for k, x in forms.items()]))).select(*df.columns, "v.variant", "v.variant_url")
