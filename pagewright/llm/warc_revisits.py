"""Not-modified revisits of a crawl, resolved to the response they stand for.

A revisit record says that a page had not changed. It is joined, by canonical
URL, to the latest full response that is earlier (as-of join); the validators
of both are compared; and the headers that a 304 response may renew replace
those of the full response.

The join is one pass over records sorted by URL and time. A URL that holds a
large part of all records does not sort in one task: time is cut into slices
(a bounded number, of about equal sizes), and the last response before a slice
is handed into it from the sums of the slices before.

Defined results: a response at the very time of a revisit counts as earlier; of
responses at one time the one with the largest id is the latest; a record whose
URL or time is null is met by nothing (its status is ``missing``); repeated
revisits give repeated rows; records of other kinds are ignored; a header list
that is null is empty, and one of any length is used whole; names are compared in
lower case and of a repeated name the last value counts; an empty table, or one
without revisits, gives an empty result. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm._session import partitions

# What a 304 response may renew (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not choose the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"

HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, www, default port, fragment, tracking and trailing slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _normal(headers: Column) -> Column:
    """Names in lower case; of a repeated name the last."""
    low = F.transform(F.coalesce(headers, F.array().cast(HEADERS)), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    later = lambda x: F.filter(x, lambda h, i: ~F.exists(F.slice(x, i + 2, F.size(x)), lambda g: g["name"] == h["name"]))
    return F.transform(F.array(low), later)[0]


def merged_headers(full: Column, revisit: Column) -> Column:
    """``full`` with what ``revisit`` may renew (both normal), sorted by name."""
    renewed = F.filter(revisit, lambda h: h["name"].isin(*PERMITTED))
    kept = F.filter(full, lambda h: ~F.exists(renewed, lambda r: r["name"] == h["name"]))
    return F.array_sort(F.concat(kept, renewed))


def _value(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def _validators(full: Column, revisit: Column) -> Column:
    tag = lambda h: F.regexp_replace(_value(h, "etag"), "^W/", "")
    one, two = tag(full), tag(revisit)
    date_one, date_two = _value(full, "last-modified"), _value(revisit, "last-modified")
    by_date = F.when(date_one.isNull() | date_two.isNull(), "unverified").when(date_one == date_two, "resolved").otherwise("changed")
    return F.when(one.isNull() | two.isNull(), by_date).when(one == two, "resolved").otherwise("changed")


def resolve(records: DataFrame, *, slices: int | None = None) -> DataFrame:
    """One row for each revisit of ``records`` (record_id long, url, ts long, kind, headers).

    (record_id, url_key, ts, status, target_id, target_ts, headers): ``status`` is
    resolved, changed, unverified or missing; ``headers`` are the merged ones of a
    resolved or unverified revisit.
    """
    slices = slices or 8 * partitions(records.sparkSession)
    rows = records.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", _normal(F.col("headers")).alias("headers"))
    cuts = sorted(set(rows.agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)], 100 * slices)).first()[0] or [])) if slices > 1 else []
    edges = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    rows = rows.withColumn("slice", F.size(F.filter(edges, lambda x: x <= F.col("ts"))))
    lost = rows.where("url_key is null or ts is null").where("kind = 'revisit'")
    rows = rows.where("url_key is not null and ts is not null")
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "headers"))
    last = rows.groupBy("url_key", "slice").agg(F.max_by(full, F.when(F.col("kind") == "response", F.struct("ts", "record_id"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    handed = last.withColumn("full", before).where("full is not null").select(F.lit(None).cast("long").alias("record_id"), "url_key", F.lit(None).cast("long").alias("ts"), F.lit("handed").alias("kind"), F.lit(None).cast(HEADERS).alias("headers"), "slice", "full")
    both = rows.withColumn("full", full).unionByName(handed)
    order = Window.partitionBy("url_key", "slice").orderBy(F.col("ts").asc_nulls_first(), F.when(F.col("kind") == "revisit", 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("met", F.last("full", ignorenulls=True).over(order)).where("kind = 'revisit'").drop("full", "kind", "slice")
    met = met.unionByName(lost.drop("kind", "slice").withColumn("met", F.lit(None).cast(met.schema["met"].dataType)))
    status = F.when(F.col("met").isNull(), "missing").otherwise(_validators(F.col("met.headers"), F.col("headers")))
    out = met.withColumn("status", status)
    headers = F.when(F.col("status").isin("resolved", "unverified"), merged_headers(F.col("met.headers"), F.col("headers")))
    return out.select("record_id", "url_key", "ts", "status", F.col("met.record_id").alias("target_id"), F.col("met.ts").alias("target_ts"), headers.alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """Two captures of every page: its response, and later a revisit by a link with tracking.

    Every fifth revisit carries an outdated validator, every seventh a date only.
    """
    tag = F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16)
    day = F.col("page_id").cast("string")
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    first = F.array(header("Content-Type", F.lit("text/html")), header("Content-Length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string")), header("ETag", tag), header("Last-Modified", day), header("Date", day))
    stale = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("W/old-"), tag)).otherwise(F.concat(F.lit("W/"), tag))
    later = F.filter(
        F.array(header("Date", F.concat(day, F.lit("+")),), header("Content-Length", F.lit("0")), header("Cache-Control", F.lit("max-age=60")), header("ETag", F.when(F.col("page_id") % 7 != 0, stale)), header("Last-Modified", day)),
        lambda h: h["value"].isNotNull(),
    )
    link = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=again#top"))
    records = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.col("url").alias("url"), F.col("page_id").alias("ts"), F.lit("response").alias("kind"), first.alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), link.alias("url"), (F.col("page_id") + 500).alias("ts"), F.lit("revisit").alias("kind"), later.alias("headers")),
    )
    return pages.select(F.explode(records).alias("r")).select("r.*")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.withColumn("headers", lines)


def _sql_url(url: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = f"lower(regexp_extract({bare}, '^([^/?]*)', 1))"
    host = f"regexp_replace(regexp_replace(regexp_replace({host}, '^[^@]*@', ''), '^www[0-9]*\\.', ''), ':(80|443)$', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    kept = f"list_sort(list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{TRACKING}')))"
    return f"{host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


OP7_SQL = f"""
WITH p AS (
  SELECT page_id, url, substr(sha256(coalesce(html, '')), 1, 16) AS tag, octet_length(encode(coalesce(html, ''))) AS size, {_sql_url("url")} AS url_key
  FROM pages),
a AS (SELECT page_id * 2 AS target_id, page_id AS target_ts, url_key, tag, size FROM p WHERE url_key IS NOT NULL),
v AS (
  SELECT page_id * 2 + 1 AS record_id, page_id + 500 AS ts, url_key, page_id,
         CASE WHEN page_id % 7 <> 0 THEN CASE WHEN page_id % 5 = 0 THEN 'W/old-' ELSE 'W/' END || tag END AS tag
  FROM p),
m AS (
  SELECT v.*, a.target_id, a.target_ts, a.tag AS full_tag, a.size,
         row_number() OVER (PARTITION BY v.record_id ORDER BY a.target_ts DESC, a.target_id DESC) AS place
  FROM v LEFT JOIN a ON v.url_key = a.url_key AND a.target_ts <= v.ts),
s AS (
  SELECT *, CASE WHEN target_id IS NULL THEN 'missing'
                 WHEN tag IS NULL THEN CASE WHEN target_ts = page_id THEN 'resolved' ELSE 'changed' END
                 WHEN regexp_replace(tag, '^W/', '') = full_tag THEN 'resolved' ELSE 'changed' END AS status
  FROM m WHERE place = 1)
SELECT record_id, url_key, ts, status, target_id, target_ts,
       CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
            || 'date: ' || page_id || '+' || chr(10) || 'etag: ' || coalesce(tag, full_tag) || chr(10) || 'last-modified: ' || target_ts END AS headers
FROM s
"""
