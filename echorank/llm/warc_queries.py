"""Registered query of the archive operator, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echorank.llm.registry import query
from echorank.llm.tables import table
from echorank.llm.warc import read_archives, write_archives
from echorank.session import scratch_path

OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), h AS (SELECT d, max(page_id) AS holder FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN h ON p.d = h.d
"""


@query("op3_zstd_warc", OP3_SQL)
def op3_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "llm-warc"))
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return read_archives(manifest).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        "problem",
    )
