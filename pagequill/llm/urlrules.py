"""URL rules by host suffix and path prefix, with DataFrame functions alone.

Each different URL is expanded into its host suffixes, combined with its path prefixes of the lengths that rules have.
The expressions meet the rules in an equi-join on the first hex digits of their digests; the whole digest confirms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequill.llm.staging import stage

SHORT = 8
SPREAD = 256
HEAVY = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(F.encode(expression, "UTF-8"), 256)


def _expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Digests of host suffix, zero byte, path prefix. A host of n labels has n suffixes."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(F.concat(h, F.lit("\0"), p)))))


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``urls`` with ``host, path, rule, verdict`` after them.

    ``rules`` holds ``(host, path, action)``. A rule fits its host and all subdomains if the path starts with its path.
    The longest host and path together win, then the longer host, then the smaller action (allow before block). Null
    URLs and those without ``://`` have an empty host and path. Columns of ``urls`` with these four names are replaced;
    one of them may be the URL itself. All other names are free.

    An expression such as ``com/`` that a third of all URLs have meets the rules once for each of ``SPREAD`` parts. A URL
    on more than one row in ``HEAVY`` gets its verdict by broadcast: there are at most that many.
    """
    rules = rules.where("host is not null and path is not null and action is not null").distinct()
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # below the longest rule path
    rows = urls.select(F.struct("*").alias("row"), F.col(url_col).alias("url"))
    own = [F.col("row")[c].alias(c) for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    parts = [url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")]
    if not lengths:
        return rows.select(*own, *parts, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    different = rows.where("url is not null").groupBy("url").agg(F.count("*").alias("n"))
    digests = _expressions(url_host(F.col("url")), url_path(F.col("url")), lengths)
    expanded = different.select("url", "n", F.pmod(F.xxhash64("url"), F.lit(SPREAD)).alias("part"), F.explode_outer(digests).alias("digest"))
    digest = _digest(F.concat("host", F.lit("\0"), "path"))
    known = rules.select(F.concat("host", "path").alias("found"), F.length("host").alias("in_host"), "action", digest.alias("whole"))
    known = known.withColumn("short", F.substring("whole", 1, SHORT))
    asked = expanded.where("digest is not null").select("part", "digest").distinct().withColumn("short", F.substring("digest", 1, SHORT))
    met = asked.join(known, "short").where("digest = whole").select("part", "digest", "found", "in_host", "action")
    order = F.when(F.col("found").isNotNull(), F.struct(-F.length("found"), -F.col("in_host"), "action", "found"))
    best = expanded.join(met, ["part", "digest"], "left").groupBy("url", "n").agg(F.min(order).alias("best"))
    best = stage(best.select("url", "n", F.col("best.found").alias("rule"), F.col("best.action").alias("verdict")))
    is_heavy = F.col("n") * HEAVY > rows.count()
    heavy, light = best.where(is_heavy).drop("n"), best.where(~is_heavy).drop("n")
    out = rows.join(F.broadcast(heavy), "url").unionByName(rows.join(F.broadcast(heavy.select("url")), "url", "left_anti").join(light, "url", "left"))
    return out.select(*own, *parts, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
