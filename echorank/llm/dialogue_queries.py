"""The registered query of the conversation repair."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echorank.llm.dialogue import digests, repair
from echorank.llm.registry import query
from echorank.llm.tables import table

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given another role, by a checksum."""
    filled = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    draw = F.pmod(F.crc32(F.concat(names[0], F.lit(":"), names[1])), F.lit(20))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", *filled, draw.alias("draw"))
        .where("draw <> 0")
        .withColumn("n", F.explode(F.array_repeat(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))))
        .select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
    )


def _next(state: str) -> str:
    return "a" if state == "u" else "u"


def _options(state: str) -> str:
    """The cheapest way on from a state at one row without an insert, as a struct of cost and audit."""
    keeps = {"n": [("s", "s"), ("u", "u")], "s": [("u", "u")], "u": [("a", "a")], "a": [("u", "u")]}[state]
    out = [f"{{'c': 4 + p.{state}.c, 'e': 'D' || p.{state}.e}}"]
    out += [f"CASE WHEN r.fault NOT IN (1, 2) AND r.initial = '{i}' THEN {{'c': cut + p.{to}.c, 'e': 'K' || p.{to}.e}} END" for i, to in keeps]
    to = _next(state)
    out.append(f"CASE WHEN r.fault NOT IN (1, 2) THEN {{'c': 3 + cut + p.{to}.c, 'e': 'R' || p.{to}.e}} END")
    return f"list_min([{', '.join(out)}])"


def _inserts(state: str) -> str:
    """The same with one or two inserts before the row."""
    to, then = _next(state), _next(_next(state))
    return f"list_min([{state}, {{'c': 3 + {to}.c, 'e': 'I' || {to}.e}}, {{'c': 6 + {then}.c, 'e': 'II' || {then}.e}}])"


_CRC = """list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda t: ascii(t)::BIGINT), lambda c, b:
      list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"""

OP12_SQL = rf"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}, 4294967295) % 20 AS draw
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 32), md5(text)) AS i FROM damaged
), rows_ AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial,
         CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 3 ELSE 0 END AS fault
  FROM placed
), counted AS (SELECT conv_id, max(i) AS n FROM rows_ GROUP BY conv_id
), best AS (
  SELECT conv_id, n AS i, {{'c': 0, 'e': ''}} AS n, {{'c': 6, 'e': 'II'}} AS s, {{'c': 3, 'e': 'I'}} AS u, {{'c': 0, 'e': ''}} AS a FROM counted
  UNION ALL
  SELECT conv_id, i, {_inserts("n")}, {_inserts("s")}, {_inserts("u")}, {_inserts("a")}
  FROM (
    SELECT p.conv_id, p.i - 1 AS i, {_options("n")} AS n, {_options("s")} AS s, {_options("u")} AS u, {_options("a")} AS a
    FROM (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS cut FROM rows_) AS r JOIN best AS p ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i)
), chosen AS (SELECT conv_id, n.c AS cost, n.e AS audit FROM best WHERE i = 0
), letters AS (
  SELECT conv_id, k, audit[k] AS e, sum(CASE WHEN audit[k] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS i
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM chosen)
), said AS (
  SELECT l.conv_id, l.k, l.e, r.role, r.text, r.initial, l.e = 'K' AND r.initial = 's' AS opening,
         row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k) AS spot
  FROM letters AS l LEFT JOIN rows_ AS r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.i = r.i AND l.e <> 'I' WHERE l.e <> 'D'
), parity AS (SELECT *, bool_or(opening) OVER (PARTITION BY conv_id) AS opened FROM said
), fixed AS (
  SELECT conv_id, sha256(string_agg(CASE e WHEN 'K' THEN role ELSE CASE WHEN (spot - opened::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END
                                    || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha
  FROM parity GROUP BY conv_id
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
         count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM rows_) GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen ON chosen.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op12_block_table_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    facts, fixed = repair(damaged(rows), "conv_id", "turn", "role", "text")
    parts = facts.unionByName(digests(fixed), allowMissingColumns=True)
    parts = parts.unionByName(rows.select(F.col("conv_id").alias("conv")).distinct(), allowMissingColumns=True)
    nothing = hashlib.sha256(b"").hexdigest()
    return parts.groupBy(F.col("conv").alias("conv_id")).agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.lit(nothing)).alias("repaired_sha256"),
    )
