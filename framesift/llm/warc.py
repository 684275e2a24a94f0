"""WARC not-modified revisits: each takes its content from the latest earlier full response of the same canonical URL.

An as-of join without a nested loop, over ids and validators only. Captures become points, one a (URL, time), so that any number of captures at
one time is one row. The points, in order of URL and time, are cut into spans of about `span_rows` points, so a URL with a
third of all captures is many spans, however its times lie. In a (URL, span) a window finds the latest earlier response; what
spans before hold is one row a (URL, span), carried forward by a second window over those rows only. Bodies are
joined last, to the revisits that are resolved and to no others. A response with more than one in HOT of these is one of few: it is copied SALTS times and its
revisits are dealt to the copies.

A revisit fits the response it refers to if their entity tags agree (weakly compared), or, where one of them lacks a tag, their
modification dates. Outcomes: `response` (a full one itself), `resolved`, `mismatch` (a validator differs),
`unverified` (no validator in common), `orphan` (no earlier response, or a null or empty URL, time or id).
A resolved revisit has the headers of the response, replaced by its own, except those that describe the body sent.

Of responses at the same time the one with the largest record_id counts (of equal ids that with the largest validators, then payload); earlier
means strictly earlier. Repeated rows each get their row. Null and empty payloads are payloads like any other. Other kinds of records and other columns are left out. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import materialize

#: Most spans that the points are cut into.
SPANS = 20_000
#: A response with more than one in HOT of all resolved revisits meets them in SALTS parts.
HOT, SALTS = 1000, 32
#: Headers that a not-modified answer cannot change, as they describe the body that was sent.
BODY_HEADERS = ("content-length", "content-encoding", "content-range", "transfer-encoding", "trailer", "connection", "keep-alive", "set-cookie")


def canonical(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a closing slash, sorted query without utm_ parameters; no scheme, no fragment."""
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    address = F.regexp_extract(rest, r"^([^?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(address, "^([^/]*)", 1)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(address, "^[^/]*(.*)$", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: ~p.startswith("utm_") & (p != "")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def _plain(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def merged(base: Column, update: Column) -> Column:
    """Headers of base, replaced and joined by those of update that may change."""
    low = lambda m: F.map_from_entries(F.array_sort(F.map_entries(F.transform_keys(m, lambda k, _: F.lower(k)))))
    none = F.create_map().cast("map<string,string>")
    allowed = F.map_filter(low(F.coalesce(update, none)), lambda k, _: ~k.isin(*BODY_HEADERS))
    kept = F.map_filter(low(F.coalesce(base, none)), lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def _latest_before(points: DataFrame, span_rows: int) -> DataFrame:
    """(url_key, ts, base) of the points at which a revisit asks: the latest response before, as (ts, record_id, etag, last_modified)."""
    points = materialize(points, "revisit-points")
    spans = max(1, min(SPANS, -(-points.count() // span_rows)))
    placed = materialize(points.repartitionByRange(spans, "url_key", "ts").withColumn("span", F.spark_partition_id()), "revisit-spans")
    inside = Window.partitionBy("url_key", "span").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where("asked")
    last = placed.groupBy("url_key", "span").agg(F.max("full").alias("last"))  # the latest, as its time comes first
    carried = last.withColumn("carry", F.last("last", ignorenulls=True).over(before)).select("url_key", "span", "carry")
    return near.join(carried, ["url_key", "span"]).select("url_key", "ts", F.coalesce("near", "carry").alias("base"))


def resolve(records: DataFrame, span_rows: int = 200_000) -> DataFrame:
    """Columns record_id, kind, url_key, outcome, refers_to, payload, headers of each response and revisit.

    records: record_id long, kind (response or revisit), url, ts long, etag, last_modified, headers map, payload.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "kind", canonical(F.col("url")).alias("url_key"), "ts", "etag", "last_modified", "headers", "payload")
    sound = F.col("url_key").isNotNull() & (F.col("url_key") != "") & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    is_full = F.col("kind") == "response"
    full = F.when(is_full, F.struct("ts", "record_id", "etag", "last_modified"))
    points = rows.where(sound).groupBy("url_key", "ts").agg(F.max(full).alias("full"), F.max(~is_full).alias("asked"))
    base = F.col("base")
    revisits = rows.where(~is_full).drop("payload").join(_latest_before(points, span_rows), ["url_key", "ts"], "left").withColumn("base", F.when(sound, base))
    tags = base["etag"].isNotNull() & F.col("etag").isNotNull()
    dates = base["last_modified"].isNotNull() & F.col("last_modified").isNotNull()
    same = F.when(tags, _plain(base["etag"]) == _plain(F.col("etag"))).when(dates, base["last_modified"] == F.col("last_modified"))
    outcome = F.when(base.isNull(), "orphan").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    judged = materialize(revisits.withColumn("outcome", outcome), "revisits-judged", "zstd")
    names = ["b_url", "b_ts", "b_id", "b_etag", "b_date"]
    of = lambda *columns: dict(zip(names, (columns[0], columns[1], columns[2], F.coalesce(columns[3], F.lit("")), F.coalesce(columns[4], F.lit("")))))
    resolved = judged.where("outcome = 'resolved'").withColumns(of(F.col("url_key"), base["ts"], base["record_id"], base["etag"], base["last_modified"]))
    keyed = rows.where(sound & is_full).withColumns(of(*map(F.col, ("url_key", "ts", "record_id", "etag", "last_modified"))))
    bound = max(SALTS, resolved.count() // HOT)
    hot = materialize(resolved.groupBy(*names).count().where(F.col("count") > bound).select(*names), "revisits-hot")  # fewer than HOT rows
    body = F.max_by(F.struct("payload", "headers"), F.struct("payload", F.to_json("headers"))).alias("body")
    once = keyed.join(F.broadcast(hot), names, "left_anti").groupBy(*names).agg(body)
    met = resolved.join(F.broadcast(hot), names, "left_anti").join(once, names)
    copies = keyed.join(F.broadcast(hot), names, "left_semi").groupBy(*names).agg(body).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = resolved.join(F.broadcast(hot), names, "left_semi").withColumn("salt", F.pmod(F.xxhash64("record_id", "ts", "etag"), F.lit(SALTS)).cast("int"))
    met = met.unionByName(salted.join(copies, [*names, "salt"]).drop("salt"))
    again = met.select(
        "record_id", "kind", "url_key", "outcome", base["record_id"].alias("refers_to"), F.col("body.payload").alias("payload"), merged(F.col("body.headers"), F.col("headers")).alias("headers"),
    )
    alone = judged.where("outcome <> 'resolved'").select("record_id", "kind", "url_key", "outcome", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast(records.schema["payload"].dataType).alias("payload"), "headers")
    first = rows.where(is_full).select("record_id", "kind", "url_key", F.lit("response").alias("outcome"), F.lit(None).cast("long").alias("refers_to"), "payload", "headers")
    return first.unionByName(again).unionByName(alone)


def captures(pages: DataFrame) -> DataFrame:
    """WARC-like records of a table of pages: a full response a page, and a revisit for every second one.

    A page's response has time page_id, its digest as entity tag, its html as payload, and a few headers. Pages with even
    ids are visited again 1,000,000 later under a tracking link; every fifth of those names another tag, and those
    with an id divisible by 6 send a new expiry date.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    common = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Expires"), F.lit("0"))
    first = pages.select(
        (2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("ts"), tag.alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), common.alias("headers"), F.coalesce("html", F.lit("")).alias("payload"),
    )
    again = pages.where(F.col("page_id") % 2 == 0)
    other = F.when(F.col("page_id") % 10 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    link = F.concat("url", F.when(F.instr("url", "#") > 0, "").when(F.instr("url", "?") > 0, "&utm_source=again").otherwise("?utm_source=again"))
    second = again.select(
        (2 * F.col("page_id") + 1).alias("record_id"), F.lit("revisit").alias("kind"), link.alias("url"), (F.col("page_id") + 1_000_000).alias("ts"), other.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("etag"), other, F.lit("content-length"), F.lit("0"), F.lit("Expires"), F.when(F.col("page_id") % 6 == 0, "600").otherwise("0")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(second)
