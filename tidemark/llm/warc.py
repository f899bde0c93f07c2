"""Not-modified revisits resolved against the latest earlier full response of the same canonical URL, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import save, shuffle_width, with_missing

#: Header fields that a 304 response may change in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
#: Query arguments that don't name another document.
NOISE = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)=.*"


def canonical_url(url: Column) -> Column:
    """Scheme, www and m hosts, default ports, fragments, noise arguments, argument order and trailing slashes don't count."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#.*$", "")
    rest = F.regexp_replace(u, r"(?i)^https?://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    args = F.array_sort(F.filter(F.split(query, "&", -1), lambda a: (a != "") & ~a.rlike(NOISE)))
    return F.concat(host, path, F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(args, "&"))).otherwise(F.lit("")))


def _latest_before(rows: DataFrame) -> DataFrame:
    """rows (key, time, id, sha, full, chunk) with earlier: struct(time, id, sha) of the key's last full row before, by (time, id, sha).

    A chunk holds a range of the rows ordered by key, time and id. Inside it a
    window finds the row before; the last full row of earlier chunks comes by a
    window over one row per key and chunk. However many rows a key has, and however
    its times lie, no task holds more than a chunk.
    """
    mark = F.when(F.col("full"), F.struct("time", "id", "sha"))
    inside = W.partitionBy("key", "chunk").orderBy("time", "id", "sha").rowsBetween(W.unboundedPreceding, -1)
    per_chunk = rows.groupBy("key", "chunk").agg(F.max(mark).alias("last"))
    over = W.partitionBy("key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = per_chunk.select("key", "chunk", F.last("last", ignorenulls=True).over(over).alias("carried"))
    return rows.withColumn("near", F.last(mark, ignorenulls=True).over(inside)).join(carried, ["key", "chunk"]).withColumn("earlier", F.coalesce("near", "carried")).drop("near", "carried", "chunk")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row per capture (id, url, time, status, headers map, body).

    id, key (canonical URL), outcome, source_id, headers, body_sha256, body_length.
    A capture of status 304 takes the body of the latest earlier capture of status
    200 with its canonical URL if their validators agree: equal entity tags, weak
    marks aside, where both have one, else equal last-modified dates. Headers are
    then those of the response with the permitted ones of the revisit over them.
    outcome: response, resolved, mismatch (validators differ or are missing),
    orphan (no earlier response), other (another status).

    Bodies never meet in a window: only ids, times and digests do; responses that
    are used are joined by them once. Header names are lower-cased; of equal names in
    other case the first by sorted name stays. Null headers are none; null times
    stand before all others. Captures without an id, or whose url is missing or names
    no host and path, neither look for a response nor are one for others: their
    revisits are orphans. Captures that repeat an id stay apart by time and body; of
    those equal in both the smallest headers are taken.
    """
    c = with_missing(captures, id="long", url="string", time="long", status="int", headers="map<string,string>", body="string")
    entries = F.array_sort(F.map_entries(F.coalesce("headers", F.expr("map()").cast("map<string,string>"))))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    named = F.transform(entries, lambda e, i: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v"), i.alias("i")))
    first = F.filter(named, lambda e: F.array_position(names, e["k"]) == e["i"] + 1)
    lowered = F.map_from_entries(F.transform(first, lambda e: F.struct(e["k"], e["v"])))
    c = c.select("id", canonical_url(F.col("url")).alias("key"), F.coalesce("time", F.lit(-(1 << 62))).alias("time"), "status", lowered.alias("h"), F.col("status").eqNullSafe(200).alias("full"),
                 F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256).alias("sha"), F.length(F.coalesce("body", F.lit(""))).cast("long").alias("len"))
    c = save(c.repartitionByRange(shuffle_width(c.sparkSession), "key", "time", "id").withColumn("chunk", F.spark_partition_id()), "captures")
    known = F.col("id").isNotNull() & (F.col("key") != "")
    placed = _latest_before(c.withColumn("full", F.col("full") & known))
    stored = c.where("full").groupBy(F.col("id").alias("_meets"), F.col("time").alias("_time"), F.col("sha").alias("_sha")).agg(F.min(F.struct("len", F.map_entries("h").alias("h"))).alias("s"))
    # rows that look for no response are dealt out by themselves, not all to the task of the missing key
    placed = placed.withColumn("s_id", F.when((F.col("status") == 304) & known, F.col("earlier.id"))).withColumns({
        "_meets": F.coalesce("s_id", F.xxhash64("id", "key", "time")), "_looks": F.col("s_id").isNotNull(), "_time": F.coalesce("earlier.time", F.lit(0)),
        "_sha": F.coalesce("earlier.sha", F.lit("")),
    })
    joined = placed.join(stored.withColumn("_looks", F.lit(True)), ["_meets", "_time", "_sha", "_looks"], "left")
    theirs = F.map_from_entries(F.coalesce("s.h", F.array().cast("array<struct<key:string,value:string>>")))
    tag = lambda h: F.regexp_replace(F.element_at(h, F.lit("etag")), "^W/", "")
    own_tag, old_tag = tag(F.col("h")), tag(theirs)
    date = lambda h: F.element_at(h, F.lit("last-modified"))
    agree = F.when(own_tag.isNotNull() & old_tag.isNotNull(), own_tag == old_tag).otherwise(date(F.col("h")) == date(theirs))
    outcome = (
        F.when(F.col("status").eqNullSafe(200), F.lit("response")).when(~F.col("status").eqNullSafe(304), F.lit("other")).when(F.col("s_id").isNull(), F.lit("orphan"))
        .when(F.coalesce(agree, F.lit(False)), F.lit("resolved")).otherwise(F.lit("mismatch"))
    )
    new = F.map_filter("h", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(new, k)), new)
    found = F.col("outcome") == "resolved"
    headers = F.when(found, merged).otherwise(F.col("h"))
    return joined.withColumn("outcome", outcome).select(
        "id", "key", "outcome", F.when(found, F.col("s_id")).alias("source_id"),
        F.map_from_entries(F.array_sort(F.map_entries(headers))).alias("headers"),
        F.when(found, F.col("_sha")).otherwise(F.col("sha")).alias("body_sha256"),
        F.when(found, F.col("s.len")).otherwise(F.col("len")).alias("body_length"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures out of pages (page_id, url, html), in order of page_id: a page is a full response, and is visited again.

    The server's entity tag is the page's length, weak where page_id is odd; every
    page is asked for again 3 * 64 ids later with the tag then known, every 16th
    with an outdated one, every 15th with the date alone. Pages without a page_id
    give captures without an id.
    """
    p = with_missing(pages, page_id="long", url="string", html="string")
    etag = F.concat(F.when(F.col("page_id") % 2 == 1, F.lit("W/")).otherwise(F.lit("")), F.lit('"'), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    first = p.select(
        (F.col("page_id") * 2).alias("id"), "url", (F.col("page_id") * 2).alias("time"), F.lit(200).alias("status"), F.col("html").alias("body"),
        F.create_map(F.lit("ETag"), etag, F.lit("Last-Modified"), day, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.col("page_id").cast("string")).alias("headers"),
    )
    strong = F.regexp_replace(etag, "^W/", "")
    again = p.select(
        (F.col("page_id") * 2 + 1).alias("id"), F.regexp_replace("url", "^http://", "https://").alias("url"), (F.col("page_id") * 2 + 1 + 384).alias("time"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("body"),
        F.when(F.col("page_id") % 16 == 5, F.create_map(F.lit("etag"), F.lit('"old"'), F.lit("date"), F.lit("later")))
        .when(F.col("page_id") % 15 == 7, F.create_map(F.lit("Last-Modified"), day, F.lit("Content-Type"), F.lit("text/plain")))
        .otherwise(F.create_map(F.lit("etag"), strong, F.lit("date"), F.lit("later"), F.lit("content-type"), F.lit("text/plain"), F.lit("expires"), day)).alias("headers"),
    )
    return first.unionByName(again)
