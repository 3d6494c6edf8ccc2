"""Thresholds, empirical p-values, score normalisers and aggregators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.functions.columns import col, mean, total
from driftlane.operators import univariate


def percentile_threshold(df: DataFrame, score: str, percent: float) -> DataFrame:
    """One row, ``threshold``: the percentile with linear interpolation."""
    found = univariate.percentiles(df.select(F.col(score).alias("score")), ["score"], [percent / 100.0])
    return found.agg(F.max(F.get("edges", F.lit(0))).alias("threshold"))


def _ranks(values: DataFrame, counted: Column) -> DataFrame:
    """``v, before, upto, n`` of the distinct values of column ``v``, in ranges (see
    ``univariate.running``); ``counted`` is how often a row counts."""
    counts = values.where("v is not null").groupBy(F.lit("v").alias("feature"), F.col("v").alias("value")).agg(F.sum(counted).alias("ref"), F.lit(0).alias("test"))
    r = univariate.running(counts)
    return r.select(F.col("value").alias("v"), (F.col("ref_upto") - F.col("ref")).alias("before"), F.col("ref_upto").alias("upto"), F.col("n_ref").alias("n"))


def higher_threshold(df: DataFrame, score: str, fpr: float) -> DataFrame:
    """One row, ``threshold``: the order statistic at ceil((N - 1)(1 - fpr)), from 0.
    ``fpr`` must be 1/N at least and below 1, else the result is empty."""
    at = F.ceil((F.col("n") - 1) * (1 - fpr))
    r = _ranks(df.select(F.col(score).cast("double").alias("v")), F.lit(1))
    ok = (F.lit(fpr) >= 1.0 / F.col("n")) & F.lit(fpr < 1)
    return r.where((F.col("before") <= at) & (at < F.col("upto")) & ok).select(F.col("v").alias("threshold"))


def quantile(df: DataFrame, column: str, p: float, kind: int = 7) -> DataFrame:
    """One row, ``quantile``, of Hyndman and Fan's types 6, 7 and 8; empty unless
    1/N <= p <= (N-1)/N. Type 7 is Spark's own exact percentile."""
    shift = {6: p, 7: 1 - p, 8: (p + 1) / 3}[kind]
    spot = F.col("n") * p + shift - 1
    low = F.floor(spot)
    r = _ranks(df.select(F.col(column).cast("double").alias("v")), F.lit(1)).where((F.lit(p) >= 1.0 / F.col("n")) & (F.lit(p) <= (F.col("n") - 1) / F.col("n")))
    holds = lambda i: (F.col("before") <= i) & (i < F.col("upto"))
    last = F.least(low + 1, F.col("n") - 1)
    ends = r.where(holds(low) | holds(last)).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.max(spot - low).alias("part"))
    return ends.where("a is not null").select((F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("quantile"))


def empirical_p_value(df: DataFrame, validation: DataFrame, score: str, extra: int = 0) -> DataFrame:
    """Adds ``p_value`` = (1 + validation scores above the score) / (N + extra).

    Scores are joined to the validation scores by rank over their union, so
    neither side is collected: a running count from above gives the number.
    """
    both = validation.select(F.col(score).cast("double").alias("v"), F.lit(1).alias("c")).unionAll(df.select(F.col(score).cast("double").alias("v"), F.lit(0).alias("c")))
    ranks = _ranks(both, F.col("c")).select(F.col("v").alias("__s"), F.try_divide(1 + F.col("n") - F.col("upto"), F.col("n") + extra).alias("p_value"))
    return df.join(ranks, df[score].cast("double") == ranks["__s"], "left").drop("__s")


#: Rows of a calibration set that travel with an expression at most.
MAX_CALIBRATION = 1 << 20


def p_value_normaliser(validation: DataFrame, scores: str, limit: int = MAX_CALIBRATION):
    """A function of a column of score arrays: per detector 1 - (1 + #{val > s}) /
    (N + 1). The sorted validation scores travel with the expression; more than
    ``limit`` raise ValueError, and ``empirical_p_value`` ranks any number of them."""
    rows = validation.select(scores).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} calibration scores")
    rows = np.array([r[0] for r in rows], float)
    held = np.sort(rows, axis=0)

    @F.pandas_udf("array<double>")
    def normalise(s: pd.Series) -> pd.Series:
        x = np.stack(s.to_numpy()).astype(float)
        n = len(held)
        above = np.stack([n - np.searchsorted(held[:, j], x[:, j], side="right") for j in range(x.shape[1])], 1)
        return pd.Series(list(1 - (1 + above) / (n + 1)))

    return normalise


def shift_scale_normaliser(validation: DataFrame, scores: str):
    """A function of a column of score arrays: z-scores by the validation mean and
    sample deviation of each detector."""
    k = validation.select(F.size(scores)).first()[0]
    stats = validation.agg(*[f(F.get(F.col(scores), F.lit(j))).alias(f"{n}{j}") for j in range(k) for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))]).first()
    means, devs = (F.array(*[F.lit(float(stats[f"{n}{j}"])) for j in range(k)]) for n in "ms")
    return lambda c: F.zip_with(F.zip_with(col(c), means, lambda x, m: x - m), devs, lambda x, s: F.try_divide(x, s))


def average(scores: str | Column, weights: list[float] | None = None) -> Column:
    if weights is None:
        return mean(scores)
    if not math.isclose(sum(weights), 1, abs_tol=1e-6):
        raise ValueError("weights must sum to 1")
    return total(F.zip_with(col(scores), F.array(*map(F.lit, weights)), lambda x, w: x * w))


def top_k_mean(scores: str | Column, k: int | None = None) -> Column:
    """Mean of the k largest; half of them, rounded up, by default."""
    at = F.lit(k) if k else F.ceil(F.size(col(scores)) / 2).cast("int")
    return mean(F.slice(F.sort_array(col(scores), asc=False), F.lit(1), at))


def maximum(scores: str | Column) -> Column:
    return F.array_max(col(scores))


def minimum(scores: str | Column) -> Column:
    return F.array_min(col(scores))


AGGREGATORS = {"average": average, "max": maximum, "min": minimum, "top_k": top_k_mean}


def flag_outliers(df: DataFrame, score: str, threshold: float | Column) -> DataFrame:
    """Adds ``threshold`` and ``is_outlier``: the score is strictly above."""
    return df.withColumn("threshold", threshold if isinstance(threshold, Column) else F.lit(float(threshold))).withColumn("is_outlier", (F.col(score) > F.col("threshold")).cast("int"))
