"""Metrics between predicted and recorded trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, by: list[str], x: str, width: int) -> DataFrame:
    """n, mean and sample covariance (width * width numbers) of the vectors of each group, from sums that are
    pre-aggregated; vectors are shifted by each group's first-order mean for accuracy."""
    mean = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col(x)[k]) for k in range(width)]).alias("mean"))
    centred = df.join(mean, by).select(*by, F.zip_with(x, "mean", lambda a, m: a - m).alias("_c"))
    sums = centred.groupBy(*by).agg(*[F.sum(F.col("_c")[i] * F.col("_c")[j]).alias(f"_{i}_{j}") for i in range(width) for j in range(i, width)])
    cov = F.array(*[F.col(f"_{min(i, j)}_{max(i, j)}") / F.greatest(F.col("n") - 1, F.lit(1)) for i in range(width) for j in range(width)])
    return mean.join(sums, by).select(*by, "n", "mean", cov.alias("cov"))


def frechet(left: DataFrame, right: DataFrame, by: list[str], eps: float = 1e-6) -> DataFrame:
    """Frechet distance between the Gaussians of two moments() tables: only one row for each group reaches Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for m, n, c, d in zip(b["m1"], b["m2"], b["c1"], b["c2"], strict=True):
                w = len(m)
                one, two = (np.reshape(v, (w, w)) + eps * np.eye(w) for v in (c, d))
                e, v = np.linalg.eigh(two)
                root = v @ np.diag(np.sqrt(np.maximum(e, eps))) @ v.T
                inner = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ one @ root), eps)).sum()
                out.append(np.sqrt(max(0.0, float(((np.asarray(m) - n) ** 2).sum() + np.trace(one) + np.trace(two) - 2 * inner))))
            yield b[by].assign(distance=out)

    both = left.select(*by, F.col("mean").alias("m1"), F.col("cov").alias("c1")).join(right.select(*by, F.col("mean").alias("m2"), F.col("cov").alias("c2")), by)
    return both.mapInPandas(run, ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in by) + ", distance double")


def suite(pairs: DataFrame, by: list[str], truth: str, guess: str, tolerance: float) -> DataFrame:
    """All metrics of predicted chunks (arrays of steps of numbers) in one pass and one aggregation: n, mse and mae over all
    numbers, final_mse over the last step, worst difference, and mismatch, the share of chunks with one above tolerance."""
    errors = F.zip_with(truth, guess, lambda a, b: F.zip_with(a, b, lambda x, y: x - y))
    df = pairs.select(*by, errors.alias("_e")).withColumn("_all", F.flatten("_e"))
    mean = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x)) / F.size(a)
    worst = F.array_max(F.transform("_all", lambda x: F.abs(x)))
    each = df.select(*by, mean(F.col("_all"), lambda x: x * x).alias("mse"), mean(F.col("_all"), lambda x: F.abs(x)).alias("mae"), mean(F.element_at("_e", -1), lambda x: x * x).alias("last"), worst.alias("worst"))
    return each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.avg("last").alias("final_mse"), F.max("worst").alias("worst"),
        F.avg((F.col("worst") > tolerance).cast("double")).alias("mismatch"),
    )


def reverse_kl(samples: DataFrame, by: str, x: str, target: str) -> DataFrame:
    """For each group of samples of one target: mean of log q - log p with unit Gaussians around the samples and the target.
    Every sample meets the others of its group, which is the estimator's definition; a group is one prediction's samples."""
    a = samples.groupBy(by, F.col(x).alias("_x"), F.col(target).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))  # equal samples count each
    b = samples.select(by, F.col(x).alias("_y"))
    square = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    pairs = a.join(b, by).select(by, "_x", "_t", "_n", (-0.5 * square("_x", "_y")).alias("_d"))
    each = pairs.groupBy(by, "_x", "_t", "_n").agg(F.max("_d").alias("_m"), F.collect_list("_d").alias("_l"))
    log_q = F.col("_m") + F.log(F.aggregate("_l", F.lit(0.0), lambda s, d: s + F.exp(d - F.col("_m")))) - F.log(F.size("_l"))
    return each.groupBy(by).agg((F.sum((log_q + 0.5 * square("_x", "_t")) * F.col("_n")) / F.sum("_n")).alias("reverse_kl"))
