"""Resolve not-modified revisits of a web archive to the full responses they stand for.

A revisit (a 304 answer) refers to the latest earlier full response of the same canonical URL. The
as-of join sorts all records by (URL, time) into range partitions, so that a URL with any share of
the records is split by time; inside a partition the last response is carried along, and what a URL
brings over from earlier partitions is one row per URL and partition. Validators are compared as
HTTP caches do, and the headers that a 304 may change replace the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import stored

# Query parameters that only track, and headers that a 304 never changes (RFC 9111, 3.2 and 4.3.4).
TRACKING = r"^(utm_.*|ref|gclid|fbclid|sessionid)(=.*)?$"
KEPT_HEADERS = (
    "connection content-encoding content-length content-range content-type keep-alive proxy-authenticate "
    "proxy-authentication-info proxy-authorization proxy-connection te trailer transfer-encoding upgrade"
).split()


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, default port, leading ``www.``, tracking parameters and a final slash are dropped.

    The host is lowered and parameters are sorted. A null URL stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    parts = F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def opaque(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def validators_agree(stored_headers: Column, headers: Column) -> Column:
    """The revisit's entity tag decides; without one its Last-Modified; without both it says nothing against."""
    tag, date = headers["etag"], headers["last-modified"]
    return F.coalesce(
        F.when(tag.isNotNull(), opaque(tag) == opaque(stored_headers["etag"]))
        .when(date.isNotNull(), F.trim(date) == F.trim(stored_headers["last-modified"]))
        .otherwise(True),
        F.lit(False),
    )


def merged_headers(stored_headers: Column, headers: Column) -> Column:
    """The stored headers, with those of the revisit that may change them put in their place."""
    fresh = F.map_filter(headers, lambda name, value: ~name.isin(*KEPT_HEADERS))
    left = F.map_filter(stored_headers, lambda name, value: ~F.map_contains_key(fresh, name))
    return F.map_concat(left, fresh)


def lowered(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last in order of names counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    return F.aggregate(
        entries,
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        lambda done, e: F.map_concat(
            F.map_filter(done, lambda name, value: name != F.lower(e["key"])), F.map_from_arrays(F.array(F.lower(e["key"])), F.array(e["value"]))
        ),
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, refers_to, outcome, headers, payload_bytes.

    ``records`` has record_id, kind (``response`` or ``revisit``), url, ts, headers (map) and
    payload_bytes. ``outcome`` is ``resolved``, ``changed`` (validators differ), ``unknown`` (no
    earlier response) or ``no url``; only resolved revisits carry headers and payload_bytes of the response.
    Earlier means a smaller ts; among responses of one ts the largest record_id counts. A null ts is
    earlier than nothing and later than nothing. Repeated records and other columns do no harm.
    """
    named = records.select(
        "record_id",
        (F.col("kind") == "response").alias("full"),
        canonical_url(records["url"]).alias("canonical_url"),
        "ts",
        lowered(records["headers"]).alias("headers"),
        "payload_bytes",
    ).filter(records["kind"].isin("response", "revisit"))
    named = stored(named, "warc-records")

    timed = named.filter(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull())
    light = timed.select("record_id", "full", "canonical_url", "ts").repartitionByRange("canonical_url", "ts")
    placed = stored(light.withColumn("part", F.spark_partition_id()), "warc-placed")

    response = F.when(F.col("full"), F.struct("ts", "record_id"))
    own = Window.partitionBy("canonical_url", "part").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("earlier", F.max(response).over(own)).filter(~F.col("full"))
    last = placed.groupBy("canonical_url", "part").agg(F.max(response).alias("last"))
    across = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    brought = last.select("canonical_url", "part", F.max("last").over(across).alias("brought"))
    asof = local.join(brought, ["canonical_url", "part"], "left").select(
        "record_id", F.coalesce("earlier", "brought")["record_id"].alias("refers_to")
    ).distinct()

    revisits = named.filter(~F.col("full")).drop("full", "payload_bytes").join(asof, "record_id", "left")
    full = named.filter("full").select(
        F.col("record_id").alias("refers_to"), F.col("headers").alias("stored"), "payload_bytes"
    ).dropDuplicates(["refers_to"])
    # Revisits that refer to nothing stay out of the join: their null keys would all meet in one task.
    lost = revisits.filter(F.col("refers_to").isNull())
    for name in ("stored", "payload_bytes"):
        lost = lost.withColumn(name, F.lit(None).cast(full.schema[name].dataType))
    met = revisits.filter(F.col("refers_to").isNotNull()).join(full, "refers_to").unionByName(lost)
    agree = validators_agree(F.col("stored"), F.col("headers"))
    outcome = (
        F.when(F.col("canonical_url").isNull(), "no url")
        .when(F.col("refers_to").isNull(), "unknown")
        .when(agree, "resolved")
        .otherwise("changed")
    )
    good = outcome == "resolved"
    return met.select(
        "record_id",
        "canonical_url",
        "refers_to",
        outcome.alias("outcome"),
        F.when(good, merged_headers(F.col("stored"), F.col("headers"))).alias("headers"),
        F.when(good, F.col("payload_bytes")).alias("payload_bytes"),
    )


def header_lines(headers: Column) -> Column:
    entries = F.array_sort(F.map_entries(headers))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")


def crawl_records(pages: DataFrame) -> DataFrame:
    """Two captures for each page: the full response, and a conditional request some time before or after it.

    Times and validators follow from page_id and the digest of the page: of the conditional
    requests, some come before any response and some answer with another entity tag.
    """
    digest = F.md5(F.coalesce(pages["html"], F.lit("")))
    number = F.conv(F.substring(digest, 1, 6), 16, 10).cast("long")
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    fields = pages.select("page_id", "url", number.alias("number"), tag.alias("tag"), F.octet_length(F.coalesce(pages["html"], F.lit(""))).cast("long").alias("bytes"))
    page, number = F.col("page_id"), F.col("number")
    text = lambda c: c.cast("string")
    response = fields.select(
        (page * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (page * 1000).alias("ts"),
        F.create_map(
            F.lit("ETag"), F.col("tag"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), text(F.col("bytes")),
            F.lit("Date"), text(page * 1000), F.lit("Cache-Control"), F.lit("max-age=60"),
        ).alias("headers"),
        F.col("bytes").alias("payload_bytes"),
    )
    again = page * 1000 + number % 200000 - 20000
    revisit = fields.select(
        (page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", again.alias("ts"),
        F.create_map(
            F.lit("etag"),
            F.when(number % 5 == 0, F.lit('"other"')).when(number % 3 == 0, F.concat(F.lit("W/"), F.col("tag"))).otherwise(F.col("tag")),
            F.lit("content-length"), F.lit("0"), F.lit("date"), text(again), F.lit("expires"), text(again + 60000),
        ).alias("headers"),
        F.lit(None).cast("long").alias("payload_bytes"),
    )
    return response.unionByName(revisit)


# The registered query in SQL: as-of by a window over responses and revisits of a URL.
ORACLE_SQL = r"""
WITH f AS (
  SELECT page_id, url, ('0x' || substr(md5(coalesce(html, '')), 1, 6))::BIGINT AS number,
         '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, octet_length(encode(coalesce(html, ''))) AS bytes,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
g AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_.*|ref|gclid|fbclid|sessionid)(=.*)?$'))) AS parts
  FROM f),
u AS (
  SELECT *, host || path || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END AS canonical_url,
         page_id * 1000 AS ts, page_id * 1000 + number % 200000 - 20000 AS again
  FROM g),
r AS (
  SELECT a.page_id * 2 + 1 AS record_id, a.canonical_url, a.again, a.number,
         CASE WHEN a.number % 5 = 0 THEN '"other"' ELSE a.tag END AS asked,
         CASE WHEN a.number % 5 = 0 THEN '"other"' WHEN a.number % 3 = 0 THEN 'W/' || a.tag ELSE a.tag END AS etag,
         max({'ts': b.ts, 'page_id': b.page_id, 'tag': b.tag, 'bytes': b.bytes}) AS found
  FROM u a LEFT JOIN u b ON a.canonical_url = b.canonical_url AND b.ts < a.again
  GROUP BY ALL)
SELECT record_id, canonical_url, coalesce(found.page_id * 2, -1) AS refers_to,
       CASE WHEN canonical_url IS NULL THEN 'no url' WHEN found.page_id IS NULL THEN 'unknown'
            WHEN asked = found.tag THEN 'resolved' ELSE 'changed' END AS outcome,
       CASE WHEN coalesce(asked <> found.tag, TRUE) THEN '' ELSE
         'cache-control: max-age=60' || chr(10) || 'content-length: ' || found.bytes || chr(10) || 'content-type: text/html' || chr(10)
         || 'date: ' || again || chr(10) || 'etag: ' || etag || chr(10) || 'expires: ' || (again + 60000) END AS headers,
       CASE WHEN asked = found.tag THEN found.bytes ELSE 0 END AS payload_bytes
FROM r
"""
