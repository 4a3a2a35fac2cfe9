"""WARC not-modified revisits, resolved by an as-of join on the canonical URL.

A revisit record (HTTP 304) holds no body. It is resolved to the latest earlier full response of
the same canonical URL, if their validators agree: entity tags by weak comparison where both have
one, else last-modified dates, else payload digests. Headers are the response's, updated by those
that a 304 may change.

A URL may hold a third of all records, so no task gets all records of a URL: records are range
partitioned by (URL, time, id), the latest response is found inside each (URL, partition), and
what earlier partitions carry over is one row for each of them.

Records without URL, time or id match nothing: revisits among them are ``missing``. Equal times
are ordered by id; a record is never earlier than itself. Repeated rows are each resolved; a
response that is repeated is one base. Header names that differ only in case: the last counts.
Null headers are empty. Empty tables give empty results. Columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duologue.llm.store import Scratch

#: Header fields that a 304 response may update in a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning", "set-cookie", "strict-transport-security")
TRACKING = "^(utm_[^=]*|gclid|fbclid|ref)(=|$)"
RECORD_COLUMNS = ("record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers")


def canonical(url: Column) -> Column:
    """Without scheme, user, ``www.``, default port, fragment, tracking parameters and final slash; host in lower case, parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place, query = F.regexp_extract(rest, "^([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    host = F.lower(F.regexp_extract(place, "^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, "^[^/]*(.*)$", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def lower_headers(headers: Column) -> Column:
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(low, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.element_at(F.filter(low, lambda e: e["key"] == k), -1)["value"])))


def merge_headers(base: Column, update: Column) -> Column:
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, canonical_url, base_id, status, headers) of every revisit; status is resolved, mismatch or missing."""
    scratch = Scratch(records.sparkSession, "warc")
    cols = [F.col(c) for c in RECORD_COLUMNS if c != "headers"]
    slim = records.select(canonical(F.col("url")).alias("canon"), *cols, lower_headers(F.col("headers")).alias("headers")).drop("url").filter("kind IN ('response', 'revisit')")
    sound = F.col("canon").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    dealt = slim.filter(sound).repartitionByRange("canon", "ts", "record_id").withColumn("pid", F.spark_partition_id())
    # written, so that a recomputed range partitioning cannot deal records differently
    dealt = scratch.keep(dealt, "records")
    base = F.struct("record_id", "ts", "etag", "last_modified", "digest", "headers")
    is_response = F.col("kind") == "response"
    inside = Window.partitionBy("canon", "pid").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("near", F.last(F.when(is_response, base), ignorenulls=True).over(inside)).filter(~is_response)
    # rows that repeat a response stand before themselves only by position; their base is the same record
    spans = dealt.groupBy("canon", "pid").agg(F.max_by(F.when(is_response, base), F.when(is_response, F.struct("ts", "record_id"))).alias("own"))
    carried = Window.partitionBy("canon").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = spans.select(F.col("canon").alias("c"), F.col("pid").alias("p"), F.last("own", ignorenulls=True).over(carried).alias("far")).filter("far IS NOT NULL")
    joined = local.join(carry, (F.col("canon") == F.col("c")) & (F.col("pid") == F.col("p")), "left").withColumn("base", F.coalesce("near", "far"))
    same = (
        F.when(F.col("etag").isNotNull() & F.col("base.etag").isNotNull(), _opaque(F.col("etag")) == _opaque(F.col("base.etag")))
        .when(F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull(), F.col("last_modified") == F.col("base.last_modified"))
        .otherwise(F.coalesce(F.col("digest") == F.col("base.digest"), F.lit(False)))
    )
    status = F.when(F.col("base").isNull(), "missing").when(same, "resolved").otherwise("mismatch")
    found = joined.withColumn("status", status).select("record_id", F.col("canon").alias("canonical_url"), F.col("base.record_id").alias("base_id"), "status", F.when(F.col("status") == "resolved", merge_headers(F.col("base.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"))
    unsound = slim.filter(~sound & ~is_response).select("record_id", F.col("canon").alias("canonical_url"), F.lit(None).cast("long").alias("base_id"), F.lit("missing").alias("status"), "headers")
    return found.unionByName(unsound)


DAY = 86_400


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl's records from stored pages: each page's full response, two later revisits, and for some an earlier one."""
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    at = F.lit(1_700_000_000) + F.col("page_id") * 60
    p = pages.select("page_id", "url", tag.alias("tag"), at.alias("at"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))

    def record(k, kind, ts, etag, **headers):
        h = F.map_from_entries(F.array(*(F.struct(F.lit(n.replace("_", "-")), v.cast("string")) for n, v in headers.items())))
        return F.struct((F.col("page_id") * 4 + k).alias("record_id"), "url", ts.alias("ts"), F.lit(kind).alias("kind"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"), h.alias("headers"))

    t1, t2, t3 = F.col("at") + DAY, F.col("at") + 2 * DAY, F.col("at") - DAY
    changed = F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    every = [
        record(0, "response", F.col("at"), F.col("tag"), Content_Type=F.lit("text/html"), Content_Length=F.col("size"), ETag=F.col("tag"), Date=F.col("at"), Server=F.lit("origin"), Cache_Control=F.lit("max-age=60")),
        record(1, "revisit", t1, F.col("tag"), Date=t1, ETag=F.col("tag"), Cache_Control=F.lit("max-age=600"), Content_Length=F.lit(0)),
        record(2, "revisit", t2, changed, Date=t2, ETag=changed, Server=F.lit("edge")),
    ]
    early = F.when(F.col("page_id") % 5 == 0, F.array(record(3, "revisit", t3, F.col("tag"), Date=t3, ETag=F.col("tag")))).otherwise(F.array().cast("array<struct<record_id:bigint,url:string,ts:bigint,kind:string,etag:string,last_modified:string,digest:string,headers:map<string,string>>>"))
    return p.select(F.explode(F.concat(F.array(*every), early)).alias("r")).select("r.*")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(crawl_of(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    written = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "canonical_url", "base_id", "status", written.alias("headers"))


SQL = rf"""
WITH split AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
parts AS (
  SELECT page_id, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 1700000000 + page_id * 60 AS at0, coalesce(strlen(html), 0) AS size,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^[^@]*@', ''), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS params
  FROM split),
p AS (SELECT page_id, tag, at0, size, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canon FROM parts),
records AS (
  SELECT page_id * 4 AS rid, canon, at0 AS ts, 'response' AS kind, tag AS etag, size, tag FROM p
  UNION ALL SELECT page_id * 4 + 1, canon, at0 + {DAY}, 'one', tag, size, tag FROM p
  UNION ALL SELECT page_id * 4 + 2, canon, at0 + {2 * DAY}, 'two', CASE WHEN page_id % 7 = 0 THEN '"changed"' ELSE 'W/' || tag END, size, tag FROM p
  UNION ALL SELECT page_id * 4 + 3, canon, at0 - {DAY}, 'early', tag, size, tag FROM p WHERE page_id % 5 = 0),
found AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {{'rid': rid, 'etag': etag, 'size': size}} END IGNORE NULLS)
            OVER (PARTITION BY canon ORDER BY ts, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base
  FROM records),
judged AS (
  SELECT *, CASE WHEN base IS NULL THEN 'missing' WHEN replace(etag, 'W/', '') = base.etag THEN 'resolved' ELSE 'mismatch' END AS status FROM found WHERE kind <> 'response')
SELECT rid AS record_id, canon AS canonical_url, base.rid AS base_id, status,
       CASE WHEN status = 'resolved' THEN 'cache-control=' || CASE kind WHEN 'one' THEN 'max-age=600' ELSE 'max-age=60' END || ';content-length=' || base.size || ';content-type=text/html;date=' || ts || ';etag=' || etag || ';server=origin'
            WHEN kind = 'one' THEN 'cache-control=max-age=600;content-length=0;date=' || ts || ';etag=' || etag
            WHEN kind = 'two' THEN 'date=' || ts || ';etag=' || etag || ';server=edge'
            ELSE 'date=' || ts || ';etag=' || etag END AS headers
FROM judged"""
