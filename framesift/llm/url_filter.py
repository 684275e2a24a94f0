"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a host and a path prefix and fits its host and all subdomains. Its literal tokens are the labels of its
host and the whole words of its path. Token frequencies are counted over all URLs, and each rule is filed under its
rarest token. A URL's tokens fetch candidate rules, and only those run their regular expression; the longest that
fits wins (then the last in text order). Small rule sets travel inside the expression, so nothing is shuffled; larger ones are joined
by token on distinct URLs, each rule once for every salt, so that a token which every URL has is no hot key.

A URL that is null or has no `://` has an empty host and path and fits no rule. What no rule fits is allowed.
Repeated rows each get their row. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that fit into an expression.
INLINE = 1000
#: Parts that the URLs of a token are split into where rules are joined.
SALTS = 32


def parts(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    at = F.instr("url", "://")
    rest = F.coalesce(F.when(at > 0, F.substr("url", at + F.lit(3))), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + F.lit(1)), "^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def url_tokens() -> Column:
    """Distinct tokens of a URL, with the one that every URL has."""
    hosts = F.transform(F.split("host", r"\."), lambda t: F.concat(F.lit("h:"), t))
    paths = F.transform(F.split("path", "[^A-Za-z0-9]+"), lambda t: F.concat(F.lit("p:"), t))
    return F.array_distinct(F.concat(F.array(F.lit("")), hosts, paths))


def rule_tokens(host: str, path: str) -> list[str]:
    """Tokens that every URL has which the rule fits. What the path ends with may be part of a longer word, so it doesn't count."""
    words = re.split("[^A-Za-z0-9]+", path)[:-1]
    return ["h:" + t for t in host.split(".") if t] + ["p:" + t for t in words if t]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], otherwise: str = "allow") -> DataFrame:
    """All columns of pages (a clashing one is replaced), and host, path, rule, verdict. rules: (allow or block, host, path prefix)."""
    spark, pages = pages.sparkSession, parts(pages.drop("rule", "verdict"))
    tokens = {r: rule_tokens(r[1], r[2]) for r in rules}
    known = sorted({t for ts in tokens.values() for t in ts})
    seen = {}
    if known and len(known) <= 8 * INLINE:
        counts = pages.select(F.explode(F.array_intersect(url_tokens(), F.array(*map(F.lit, known)))).alias("t")).groupBy("t").count()
        seen = {r["t"]: r["count"] for r in counts.collect()}  # at most one row a rule token
    elif known:
        counts = pages.select(F.explode(url_tokens()).alias("t")).groupBy("t").count()
        seen = {r["t"]: r["count"] for r in counts.join(spark.createDataFrame([(t,) for t in known], "t string"), "t").collect()}
    filed = []
    for (verdict, host, path), found in tokens.items():
        rarest = min(found, key=lambda t: (seen.get(t, 0), t), default="")
        pattern = r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path) if path else r"^(?:[^/]*\.)?" + re.escape(host) + "(?:/|$)"
        filed.append((rarest, len(host) + len(path), host + path, verdict, pattern))
    address = F.concat("host", "path")
    spare = "_best"
    while spare in pages.columns:
        spare += "_"
    out = (F.col(f"{spare}.rule").alias("rule"), F.coalesce(F.col(f"{spare}.verdict"), F.lit(otherwise)).alias("verdict"))
    if not filed:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    if len(filed) <= INLINE:
        index: dict[str, list] = {}
        for token, size, rule, verdict, pattern in sorted(filed, key=lambda r: r[2]):
            index.setdefault(token, []).append(F.struct(F.lit(size).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(pattern).alias("pattern")))
        held = F.create_map(*[x for token, rows in index.items() for x in (F.lit(token), F.array(*rows))])
        fetched = F.flatten(F.transform(F.array_intersect(url_tokens(), F.array(*map(F.lit, index))), lambda t: held[t]))
        fitting = F.filter(fetched, lambda r: F.rlike(address, r["pattern"]))
        best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"], r["rule"], r["verdict"])))
        return pages.withColumn(spare, best).select(*pages.columns, *out)
    index = spark.createDataFrame(filed, "token string, size int, rule string, verdict string, pattern string")
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    urls = pages.select("host", "path").distinct().withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    fitting = urls.withColumn("token", F.explode(url_tokens())).join(index, ["token", "salt"]).where(F.rlike(address, F.col("pattern")))
    best = fitting.groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict")).alias(spare))
    return pages.join(best, ["host", "path"], "left").select(*pages.columns, *out)
