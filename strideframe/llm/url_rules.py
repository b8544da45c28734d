"""URL filters by host-suffix and path-prefix expressions (DataFrame operations).

A rule is (host, path, verdict): it fits its host and every subdomain when the URL's path starts with
its path. Every URL is expanded into the expressions ``host suffix + path prefix`` as deep as the rules
go; the expressions meet the rules by an equi-join on the first 32 bits of their SHA-256, the full
digests confirm the match, and of the rules that fit the longest wins (ties: the longer host, then block).

Each distinct (host, path) is judged once, so a URL that fills a third of the table costs one row.
Rules are broadcast only if there are at most ``max_broadcast``; beyond, they are joined by shuffle
with the expressions of popular rules dealt over ``salts`` parts.

Defined results: a null URL or one without ``://`` has an empty host and path; a rule with a null host,
path or verdict never fits; without a rule the verdict is ``default``; rows and ids may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


def url_host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _folder(path: Column) -> Column:
    """A path up to its last slash, which is what the expansion offers."""
    return F.regexp_extract(path, r"^(.*/)?", 0)


def _expressions(depth: int, labels: int) -> Column:
    host, path = F.split("host", r"\.", -1), F.split("path", "/", -1)
    n = F.size(host)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(F.split("host", r"\.", -1), F.greatest(n - k + 1, F.lit(1)), k), "."))
    folders = F.transform(F.sequence(F.lit(0), F.least(F.size(path) - 1, F.lit(depth))), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(path, 1, k), "/"), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(folders, lambda f: F.concat(s, f))))


def match_rules(targets: DataFrame, rules: DataFrame, max_broadcast: int = 100_000, salts: int = 16) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) of ``targets`` that a rule fits."""
    known = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna().distinct()
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("r_host", r"\.", -1))).alias("labels"), F.max(F.char_length(F.regexp_replace("r_path", "[^/]", ""))).alias("depth")).first()
    digest = F.sha2(F.concat("r_host", _folder(F.col("r_path"))), 256)
    known = known.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, 8))
    found = targets.select("host", "path").distinct().withColumn("__e", F.explode(_expressions(size.depth or 0, size.labels or 1))).withColumn("__digest", F.sha2("__e", 256)).withColumn("prefix", F.substring("__digest", 1, 8))
    if size.n <= max_broadcast:
        joined = found.join(F.broadcast(known), "prefix")
    else:
        found = found.withColumn("__salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int"))
        joined = found.join(known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["prefix", "__salt"])
    fits = joined.where((F.col("digest") == F.col("__digest")) & F.startswith("path", "r_path"))
    order = F.struct((F.char_length("r_host") + F.char_length("r_path")).alias("n"), F.char_length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    return fits.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", **options) -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of these names are replaced)."""
    parsed = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url_col]).withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col)))
    return parsed.join(match_rules(parsed, rules, **options), ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
