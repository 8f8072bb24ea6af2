"""Gaussian models of frame vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def gaussian_model(frames: DataFrame, d: int = 13, key: str = "id", vec: str = "v") -> DataFrame:
    """Mean, population variance, sample covariance and its upper triangle per item.

    ``(id, mean, var, cov, cov_ut, mfcc)``, where ``mfcc`` is mean ++ covariance,
    the vector the timbre distances take. Only mergeable aggregates: an item with
    very many frames is one partial row per partition in the shuffle.
    """
    x = [F.col(vec)[i] for i in range(d)]
    stats = [F.avg(x[i]).alias(f"m{i}") for i in range(d)] + [F.var_pop(x[i]).alias(f"v{i}") for i in range(d)]
    stats += [F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    wide = frames.groupBy(key).agg(*stats)
    cov = F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)])
    mean = F.array(*[F.col(f"m{i}") for i in range(d)])
    return wide.select(
        key,
        mean.alias("mean"),
        F.array(*[F.col(f"v{i}") for i in range(d)]).alias("var"),
        cov.alias("cov"),
        F.array(*[F.col(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).alias("cov_ut"),
        F.concat(mean, cov).alias("mfcc"),
    )
