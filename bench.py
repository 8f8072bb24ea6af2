"""Headline rankings and jobs at $BENCH_SF_DIR: warm, median of several runs.

Prints one JSON line. BENCH_RUNS sets the number of timed runs (default 3),
BENCH_ITEMS a synthetic catalogue made by Spark for the scale-out query (0 = off).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from echorank.operators.ordering import top_k
from echorank.operators.pairing import ALL_FEATURES
from echorank.plans import ranking as R
from echorank.plans.refine import BH_FIRST, CHROMA_FIRST, rank_filter_refine
from echorank.session import build_session, materialize
from workload import catalogue as C
from workload import features, formats, signals

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ITEMS = int(os.environ.get("BENCH_ITEMS", "0"))


def synthetic(spark, items: int):
    """A catalogue of ``items`` rows with the shape of the derived one."""
    e = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.sin(F.col("n") * k * 0.7310585 + k))
    base = spark.range(items).select(F.col("id").alias("n")).withColumn("e", e)
    return base.select(
        F.concat(F.lit("song"), "n").alias("id"),
        F.slice("e", 1, 24).alias("rp"),
        F.slice("e", 25, 12).alias("rh"),
        (F.col("n") % 120 + 60).cast("double").alias("bpm"),
        F.slice("e", 37, 8).alias("bh"),
        F.transform(F.slice("e", 41, 24), F.abs).alias("chroma"),
        C.model_vector(F.col("e")).alias("mfcc"),
    )


def main() -> None:
    spark = build_session(
        "echorank-bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The features are stored once, as a user would; the rankings read the tables.
    wide = materialize(C.wide_table(spark, SF_DIR), "wide")
    tables = {name: materialize(df, name) for name, df in C.feature_tables(spark, SF_DIR).items()}
    hundred = [f"song{n}" for n in range(100)]
    jobs = {
        "rank_full": lambda: R.rank_full(tables, C.SONG),
        "rank_fast": lambda: R.rank_fast(tables, C.SONG),
        "rank_precise": lambda: R.rank_precise(tables, C.SONG),
        "rank_merged": lambda: R.rank_merged(wide, C.SONG, unique_ids=True),
        "rank_filter_refine_chroma_first": lambda: rank_filter_refine(wide, C.SONG, CHROMA_FIRST, unique_ids=True),
        "rank_filter_refine_bh_first": lambda: rank_filter_refine(wide, C.SONG, BH_FIRST, unique_ids=True),
        "rank_batch_100": lambda: R.rank_batch(wide, hundred, unique_ids=True),
        "top_20_of_100": lambda: top_k(R.rank_batch(wide, hundred, unique_ids=True), 20, by=["query_id"]),
        "gaussian_model": lambda: features.gaussian_model_query(spark, SF_DIR),
        "beat_chroma": lambda: features.beat_chroma(spark, SF_DIR),
        "tempo_histogram": lambda: features.tempo_histogram(spark, SF_DIR),
        "moments7": lambda: features.moments7(spark, SF_DIR),
        "signal_rh": lambda: signals.QUERIES["signal_rh"](spark, SF_DIR),
        "signal_rp": lambda: signals.QUERIES["signal_rp"](spark, SF_DIR),
        "features_csv": lambda: formats.QUERIES["features_csv"](spark, SF_DIR),
    }
    if ITEMS:
        big = materialize(synthetic(spark, ITEMS), "synthetic")
        vector_features = tuple(f for f in ALL_FEATURES if f != "notes")
        jobs[f"rank_merged_{ITEMS}"] = lambda: R.rank_merged(big, C.SONG, vector_features, unique_ids=True)

    timings = {}
    for name, job in jobs.items():
        runs = []
        for n in range(RUNS + 1):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            if n:
                runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
