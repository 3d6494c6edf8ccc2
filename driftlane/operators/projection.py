"""Scores from the covariance of a reference: Mahalanobis and PCA."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector(features: list[str] | str) -> Column:
    """A double array from a list of columns, or from one array column."""
    return F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(f).cast("double") for f in features])


def moments(df: DataFrame, features: list[str] | str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, sample covariance), by one aggregate of products: d (d + 3) / 2
    sums reach the driver, never rows. Products are of values less the first row's,
    which keeps digits."""
    v = df.select(vector(features).alias("v")).where("v is not null")
    first = v.first()
    if first is None:
        raise ValueError("no rows")
    base = F.array(*[F.lit(float(x)) for x in first.v])
    d = len(first.v)
    c = v.select(F.zip_with("v", base, lambda x, b: x - b).alias("v")).select(*[F.get("v", F.lit(i)).alias(f"x{i}") for i in range(d)])
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    r = c.agg(F.count(F.lit(1)).alias("n"), *sums, *products).first()
    n = r.n
    s = np.array([r[f"s{i}"] for i in range(d)])
    p = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            p[i, j] = p[j, i] = r[f"p{i}_{j}"]
    mean = s / n
    return n, mean + np.array(first.v), (p - n * np.outer(mean, mean)) / max(n - 1, 1)


def project(v: str | Column, mean: np.ndarray, components: np.ndarray) -> Column:
    """Coordinates of a row along the columns of ``components``."""
    v = F.col(v) if isinstance(v, str) else v
    centred = F.zip_with(v, F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
    each = []
    for c in components.T.tolist():
        w = F.array(*map(F.lit, c))
        each.append(F.aggregate(F.zip_with(centred, w, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))
    return F.array(*each)


def squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def mahalanobis(df: DataFrame, ref: DataFrame, features: list[str] | str, floor: float = 1e-6) -> DataFrame:
    """Adds ``score``: the sum of squared whitened coordinates; directions whose
    variance in the reference is ``floor`` or less are left out."""
    _, mean, cov = moments(ref, features)
    value, vec = np.linalg.eigh(cov)
    on = value > floor
    return df.withColumn("score", squares(project(vector(features), mean, vec[:, on] / np.sqrt(value[on]))))


def pca(df: DataFrame, ref: DataFrame, features: list[str] | str, n_components: int) -> DataFrame:
    """Adds ``score``: the squared length along the components of least variance,
    those beyond the ``n_components`` largest."""
    _, mean, cov = moments(ref, features)
    _, vec = np.linalg.eigh(cov)
    if not 0 < n_components < len(mean):
        raise ValueError("n_components must lie between 1 and the number of features less 1")
    return df.withColumn("score", squares(project(vector(features), mean, vec[:, : len(mean) - n_components])))


#: Scored rows whose kernel values are held at a time, whatever the size of an Arrow batch.
STRIP = 256


def kernel_pca(df: DataFrame, ref: DataFrame, features: list[str] | str, n_components: int, kernel: Callable, limit: int = 2000, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Adds ``score`` = -2 mean k(x, ref) - sum of squared projections on the leading
    centred kernel components. The kernel matrix of the reference is dense, so
    ``limit`` rows drawn by hash stand for a larger one. Test rows are centred by
    the reference's means alone."""
    held = ref.select(F.col(id_col).alias("i"), vector(features).alias("v")).orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(limit).collect()
    x = np.array([r.v for r in held])
    k = kernel(x, x)
    rows, whole = k.mean(0), k.mean()
    value, vec = np.linalg.eigh(k - rows[None] - rows[:, None] + whole)
    lead = np.argsort(-value)[:n_components]
    axes = vec[:, lead] / np.sqrt(np.maximum(value[lead], 1e-12))

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        out = np.empty(len(v))
        for start in range(0, len(v), STRIP):
            kx = kernel(np.stack(v.iloc[start : start + STRIP].to_numpy()).astype(float), x)
            z = (kx - kx.mean(1, keepdims=True) - rows[None] + whole) @ axes
            out[start : start + STRIP] = -2 * kx.mean(1) - (z**2).sum(1)
        return pd.Series(out)

    return df.withColumn("score", score(vector(features)))
