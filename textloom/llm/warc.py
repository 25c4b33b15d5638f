"""WARC revisit resolution: an as-of join to the latest earlier full response of the same canonical URL.

A "not modified" revisit record has no body.  It is resolved to the latest full
response with the same canonical URL and a strictly earlier time; of equal times the
larger record id wins.  Validators are checked: an entity tag that both have must agree (weak
comparison), else a last-modified date that both have must agree; with neither in common the match is unchecked.
Headers of the revisit that a 304 may update replace those of the stored response.

Defined results: a revisit without an earlier response is ``unresolved``, one whose validators
disagree is ``mismatch``; both keep their own headers.  Null urls have no canonical form and
resolve nothing; null times never are earlier or later; null header maps are empty; repeated rows, and rows with equal or null record ids, are
rows of their own (a response without an id loses to any other of its time; of equal times and ids the larger hash of the headers wins); an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

#: Headers that a 304 response may update; those that describe the body it doesn't have stay.
UPDATED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "server", "vary"]
#: Query parameters that don't choose a page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
COLUMNS = ["record_id", "kind", "url", "time", "headers"]


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.`` or ``m.``, default port, fragment, tracking parameters and closing slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^(www|m)\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    kept = F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _lowered(headers: Column) -> Column:
    """The headers with their names in lower case, of names that differ in case only the last in the order of their bytes; a null map is empty."""
    given = F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    entries = F.transform(F.array_sort(F.map_entries(given)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), e["key"])))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.get(F.map_values(F.map_filter(headers, lambda k, v: k == "etag")), F.lit(0)), "^W/", "")


def _date(headers: Column) -> Column:
    return F.get(F.map_values(F.map_filter(headers, lambda k, v: k == "last-modified")), F.lit(0))


def _merged(stored: Column, update: Column) -> Column:
    allowed = F.map_filter(update, lambda k, v: k.isin(UPDATED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical, time, target_id, target_time, status, headers.

    ``records`` has record_id (long), kind ('response' or 'revisit'), url, time (long) and headers (map; names in any case, as HTTP has it, and in lower case in the result).
    Rows are range-partitioned by URL and time, so a URL with a third of all rows spreads over as many partitions; each partition then
    gets the latest response of the partitions before it, at most one row per URL and partition.
    """
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical"), "time", _lowered(F.col("headers")).alias("headers"))
    rows = rows.withColumn("tie", F.xxhash64(F.array_sort(F.map_entries("headers"))))  # of responses with one time and id
    known = rows.filter("canonical is not null and time is not null and kind in ('response', 'revisit')")
    # at one time revisits stand before responses, so that only strictly earlier responses are seen
    ranged = known.withColumn("late", (F.col("kind") == "response").cast("int")).repartitionByRange("canonical", "time", "late", "record_id")
    stored = written(ranged.withColumn("part", F.spark_partition_id()), "captures")
    full = F.when(F.col("late") == 1, F.struct("time", "record_id", "headers"))
    seen = Window.partitionBy("canonical", "part").orderBy("time", "late", "record_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    inner = stored.withColumn("latest", F.last(full, ignorenulls=True).over(seen)).filter("late = 0")
    by_part = stored.filter("late = 1").groupBy("canonical", "part").agg(F.max_by(F.struct("time", "record_id", "headers"), F.struct("time", "record_id", "tie")).alias("last"))
    places = stored.select("canonical", "part").distinct().join(by_part, ["canonical", "part"], "left")
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.select("canonical", "part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = inner.join(carried, ["canonical", "part"]).withColumn("to", F.coalesce("latest", "carried")).select("record_id", "canonical", "time", "headers", "to")
    rest = rows.filter("kind = 'revisit' and (canonical is null or time is null)").select("record_id", "canonical", "time", "headers", F.lit(None).cast(found.schema["to"].dataType).alias("to"))
    every = found.unionByName(rest)
    stored_headers = F.col("to.headers")
    tags = [_tag(F.col("headers")), _tag(stored_headers)]
    dates = [_date(F.col("headers")), _date(stored_headers)]
    agree = F.coalesce(tags[0] == tags[1], dates[0] == dates[1])
    status = F.when(F.col("to").isNull(), "unresolved").when(~agree, "mismatch").when(agree, "resolved").otherwise("unchecked")
    ok = F.col("status").isin("resolved", "unchecked")
    return every.withColumn("status", status).select(
        "record_id", "canonical", "time", F.when(ok, F.col("to.record_id")).alias("target_id"), F.when(ok, F.col("to.time")).alias("target_time"), "status",
        F.when(ok, _merged(stored_headers, F.col("headers"))).otherwise(F.col("headers")).alias("headers"))


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """The resolved revisits with the ``body`` of their target; ``bodies`` has record_id and body."""
    other = bodies.select(F.col("record_id").alias("_id"), "body")
    return resolved.join(other, F.col("target_id") == F.col("_id"), "left").drop("_id")


def crawl(pages: DataFrame) -> DataFrame:
    """A crawl made of a table of pages, which has no capture records of its own.

    Each page is a full response at time 2 * page_id (left out if page_id is 3 modulo 11, as if it weren't archived), tagged with
    the MD5 of its html, and is revisited 7 ticks later.  The revisit shows that tag, or a changed one (page_id 2 modulo 7), or only a date (1 modulo 5).
    """
    page, md5 = F.col("page_id").cast("long"), F.md5(F.coalesce(F.col("html"), F.lit("")))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    date = F.concat(F.lit("day "), F.floor(page / 10).cast("string"))
    tag = F.concat(F.lit('"'), md5, F.lit('"'))
    stored = F.create_map(F.lit("content-length"), size, F.lit("content-type"), F.lit("text/html"), F.lit("date"), (page * 2).cast("string"), F.lit("etag"), tag, F.lit("last-modified"), date)
    shown = F.when(page % 7 == 2, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    common = [F.lit("content-length"), F.lit("0"), F.lit("date"), (page * 2 + 7).cast("string")]
    again = F.when(page % 5 == 1, F.create_map(*common, F.lit("last-modified"), date)).otherwise(F.create_map(*common, F.lit("etag"), shown))
    responses = pages.filter((page % 11 != 3)).select((page * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (page * 2).alias("time"), stored.alias("headers"))
    revisits = pages.select((page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (page * 2 + 7).alias("time"), again.alias("headers"))
    return responses.union(revisits)


def op4_revisit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return resolve(crawl(table(spark, sf_dir, "pages"))).select(
        F.expr("(record_id - 1) div 2").cast("long").alias("page_id"), "canonical", "time", F.expr("target_id div 2").cast("long").alias("target_page_id"), "target_time", "status", shown.alias("headers"))


OP4_SQL = r"""
WITH b AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), c AS (
  SELECT page_id, '"' || md5(html) || '"' AS tag, strlen(html) AS size, 'day ' || CAST(page_id // 10 AS VARCHAR) AS day,
         regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^(www|m)\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS front,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
             lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS query FROM b
), u AS (
  SELECT *, front || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM c
), v AS (
  SELECT page_id, canonical, page_id * 2 + 7 AS time, CASE WHEN page_id % 5 = 1 THEN NULL WHEN page_id % 7 = 2 THEN '"changed"' ELSE tag END AS tag,
         CASE WHEN page_id % 5 = 1 THEN day END AS day FROM u
), m AS (
  SELECT v.page_id, v.canonical, v.time, v.tag, v.day, max(r.page_id) AS target
  FROM v LEFT JOIN u r ON r.canonical = v.canonical AND r.page_id * 2 < v.time AND r.page_id % 11 <> 3
  GROUP BY ALL
), s AS (
  SELECT m.*, r.tag AS rtag, r.day AS rday, r.size AS rsize,
         CASE WHEN target IS NULL THEN 'unresolved' WHEN coalesce(m.tag = r.tag, m.day = r.day) THEN 'resolved'
              WHEN NOT coalesce(m.tag = r.tag, m.day = r.day) THEN 'mismatch' ELSE 'unchecked' END AS status
  FROM m LEFT JOIN u r ON r.page_id = m.target
), w AS (
  SELECT *, status IN ('resolved', 'unchecked') AS ok, CASE WHEN tag IS NULL THEN NULL WHEN tag = '"changed"' THEN tag ELSE 'W/' || tag END AS shown FROM s
)
SELECT page_id, canonical, time, CASE WHEN ok THEN target END AS target_page_id, CASE WHEN ok THEN target * 2 END AS target_time, status,
  CASE WHEN ok THEN 'content-length=' || CAST(rsize AS VARCHAR) || '; content-type=text/html; date=' || CAST(time AS VARCHAR) || '; etag=' || coalesce(shown, rtag) || '; last-modified=' || rday
       WHEN tag IS NULL THEN 'content-length=0; date=' || CAST(time AS VARCHAR) || '; last-modified=' || day
       ELSE 'content-length=0; date=' || CAST(time AS VARCHAR) || '; etag=' || shown END AS headers
FROM w
"""
