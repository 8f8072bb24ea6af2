"""Registered queries of the two native operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echorank.llm.registry import query
from echorank.llm.sharding import HASH_BITS, assign_shards
from echorank.llm.tables import table
from echorank.llm.urlfilter import host_of, judge_captures, path_of

#: Bytes of text in one shard of the shuffled training mix.
SHARD_BYTES = 1 << 20
#: Captures are spread over this many minutes from the first of January 2024.
FETCH_MINUTES = 527_040
#: Dated entries per pattern of the derived list, and the days they fall on.
LIST_EVENTS, LIST_DAYS = 4, 366


def captures(pages: DataFrame) -> DataFrame:
    """Pages have no fetch time: one is derived from the page id."""
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(FETCH_MINUTES))
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return pages.select("page_id", "url", F.timestamp_add("MINUTE", minutes, start).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list about the hosts, domains and top folders of the crawl itself."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    folder = F.regexp_extract(path, r"^/([^/]+)", 1)
    named = F.array(
        host,
        F.regexp_replace(host, r"^[^.]*\.", ""),
        F.when(folder != "", F.concat(host, F.lit("/"), folder)),
    )
    patterns = (
        pages.where(host != "")
        .select(F.explode(named).alias("pattern"))
        .where(F.col("pattern").isNotNull())
        .distinct()
        .withColumn("event", F.explode(F.sequence(F.lit(1), F.lit(LIST_EVENTS))))
    )
    digest = F.conv(F.substring(F.md5(F.concat_ws("#", "pattern", "event")), 1, 8), 16, 10).cast("long")
    kind = F.pmod(F.floor(digest / LIST_DAYS), F.lit(4))
    action = F.when(kind == 0, "block").when(kind == 1, "allow").otherwise("remove")
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return patterns.select(
        "pattern", action.alias("action"), F.timestamp_add("DAY", F.pmod(digest, F.lit(LIST_DAYS)), start).alias("effective")
    )


OP7_SQL = r"""
WITH cap AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_minutes((page_id * 7919) % 527040) AS fetched_at,
         lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@', ''), ':[0-9]*$', '')) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), named AS (
  SELECT host AS pattern FROM cap WHERE host <> ''
  UNION SELECT regexp_replace(host, '^[^.]*\.', '') FROM cap WHERE host <> ''
  UNION SELECT host || '/' || regexp_extract(path, '^/([^/]+)', 1) FROM cap
        WHERE host <> '' AND regexp_extract(path, '^/([^/]+)', 1) <> ''
), events AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern || '#' || event), 1, 8) AS BIGINT) AS d
  FROM named, (SELECT unnest([1, 2, 3, 4]) AS event)
), entries AS (
  SELECT pattern, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d % 366 AS INTEGER)) AS effective,
         min(CASE (d // 366) % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS act
  FROM events GROUP BY ALL
), valid AS (
  SELECT pattern, act, effective AS since,
         coalesce(lead(effective) OVER (PARTITION BY pattern ORDER BY effective), TIMESTAMP '9999-12-31 00:00:00') AS until
  FROM entries
), parts AS (
  SELECT page_id, url, fetched_at, host, string_split(host, '.') AS l,
         list_filter(string_split(path, '/'), lambda x: x <> '') AS p
  FROM cap
), offers AS (
  SELECT page_id, url, fetched_at, i AS rank, array_to_string(l[len(l) - i + 1 : len(l)], '.') AS pattern
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM parts WHERE host <> '')
  UNION ALL
  SELECT page_id, url, fetched_at, i * 1000 + len(l), host || '/' || array_to_string(p[1 : i], '/')
  FROM (SELECT *, unnest(range(1, least(len(p), 2) + 1)) AS i FROM parts WHERE host <> '')
), hits AS (
  SELECT o.page_id, o.pattern, v.act, v.since,
         row_number() OVER (PARTITION BY o.page_id ORDER BY o.rank DESC) AS r
  FROM offers o JOIN valid v ON o.pattern = v.pattern AND o.fetched_at >= v.since AND o.fetched_at < v.until
  WHERE v.act < 2
)
SELECT c.page_id, c.url, coalesce(h.act = 0, false) AS blocked, h.pattern,
       CASE h.act WHEN 0 THEN 'block' WHEN 1 THEN 'allow' END AS action, strftime(h.since, '%Y-%m-%d') AS since
FROM cap c LEFT JOIN hits h ON c.page_id = h.page_id AND h.r = 1
"""


@query("op7_url_filters", OP7_SQL)
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = judge_captures(captures(pages), list_entries(pages), "page_id", "url", "fetched_at")
    return judged.select("page_id", "url", "blocked", "pattern", "action", F.date_format("since", "yyyy-MM-dd").alias("since"))


OP9_SQL = f"""
WITH h AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(31) || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT d AS depth, h >> ({HASH_BITS} - d) AS bucket, sum(bytes) AS b, count(*) AS n
  FROM h, (SELECT unnest(range(0, {HASH_BITS} + 1)) AS d) GROUP BY ALL
), leaf AS (
  SELECT doc_id, bytes, h, min(depth) AS depth
  FROM h, s WHERE h.h >> ({HASH_BITS} - s.depth) = s.bucket AND (b <= {SHARD_BYTES} OR n = 1) GROUP BY ALL
)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, CAST(depth AS BIGINT) AS depth, CAST(0 AS BIGINT) AS page,
       CASE WHEN depth = 0 THEN '' ELSE substr(right(repeat('0', {HASH_BITS}) || bin(h), {HASH_BITS}), 1, depth) END AS shard
FROM leaf
"""


@query("op9_extendible_shards", OP9_SQL)
def op9_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = assign_shards(table(spark, sf_dir, "documents"), "doc_id", "text", SHARD_BYTES)
    return shards.select("doc_id", "bytes", F.col("depth").cast("long").alias("depth"), "page", "shard")
