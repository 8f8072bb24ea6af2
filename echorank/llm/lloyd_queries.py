"""The registered query of the dimension-sharded clustering."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echorank.llm.lloyd import lloyd, seeds, usable
from echorank.llm.registry import query
from echorank.llm.tables import table

DIMS, CENTROIDS, ROUNDS, SCALE, SALT = 64, 40, 5, 256, "2:"

_ROUND = """
, a{r} AS (
  SELECT i, cluster, distance FROM (
    SELECT i, cluster, distance, row_number() OVER (PARTITION BY i ORDER BY distance, cluster) AS n
    FROM (SELECT x.i, c.cluster, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
          FROM x CROSS JOIN c{r} AS c)) WHERE n = 1
)"""
_MEANS = """
, m{r} AS (
  SELECT cluster, pos, sum(v)::BIGINT AS s, count(*) AS n
  FROM (SELECT a.cluster, unnest(x.v) AS v, unnest(range(len(x.v))) AS pos FROM x JOIN a{r} AS a USING (i)) GROUP BY cluster, pos
), c{next} AS (
  SELECT c.cluster, coalesce(m.v, c.v) AS v
  FROM c{r} AS c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM m{r} GROUP BY cluster) AS m USING (cluster)
)"""

OP13_SQL = (
    f"""
WITH x AS (
  SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id) NULLS LAST, embedding) - 1 AS i, vec_id,
         list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMS}
), c0 AS (SELECT i AS cluster, v FROM x WHERE i < {CENTROIDS})"""
    + "".join(_ROUND.format(r=r) + _MEANS.format(r=r, next=r + 1) for r in range(ROUNDS))
    + _ROUND.format(r=ROUNDS)
    + f"""
SELECT x.vec_id, a.cluster::INTEGER AS cluster, a.distance,
       (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN x USING (i) JOIN c{ROUNDS} AS c ON c.cluster = a.cluster
"""
)


@query("op13_sharded_lloyd", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(usable(F.col("embedding"), DIMS))
    assigned, centroids = lloyd(rows, "vec_id", "embedding", seeds(rows, "vec_id", "embedding", CENTROIDS, SALT, SCALE), ROUNDS, SCALE)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    model = [
        (c, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
        for c, v in enumerate(centroids)
        if c in sums
    ]
    facts = spark.createDataFrame(model, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.withColumn("distance", F.col("distance").cast("long")).join(F.broadcast(facts), "cluster")
