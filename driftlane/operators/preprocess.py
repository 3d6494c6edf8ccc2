"""What goes before a detector: encoders, batched models, repeated evaluations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlane.functions.columns import bind, col, deviation, mean


class Layers:
    """A stack of (weights, bias) with ReLU between; plain arrays that go with tasks."""

    def __init__(self, params: list[tuple[np.ndarray, np.ndarray]]):
        self.params = params

    def __call__(self, x: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None) -> np.ndarray:
        for i, (w, b) in enumerate(self.params):
            x = x @ w + b
            if i < len(self.params) - 1:
                x = np.maximum(x, 0)
                if drop:
                    x = x * (rng.uniform(size=x.shape) >= drop) / (1 - drop)
        return x

    def hidden(self, layer: int = -1) -> Layers:
        """The stack up to a layer, as a model of its own: -1 is all but the last."""
        return Layers(self.params[: layer if layer < 0 else layer + 1])


def untrained_encoder(dim: int, encoding: int, seed: int = 0) -> Layers:
    """Random layers of widths d, e + 2s, e + s, e with s = (d - e) / 3."""
    step = int((dim - encoding) / 3)
    sizes = [dim, encoding + 2 * step, encoding + step, encoding]
    rng = np.random.default_rng(seed)
    return Layers([(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)) for a, b in zip(sizes, sizes[1:])])


def apply_model(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], vec_col: str, out: str = "encoded") -> DataFrame:
    """Adds the model's output as an array, in Arrow batches. Null vectors stay null.
    A column named ``out`` is replaced."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(v: pd.Series) -> pd.Series:
        on = np.flatnonzero(v.notna().to_numpy())
        got: list = [None] * len(v)
        if len(on):
            for i, y in zip(on.tolist(), np.asarray(model(np.stack(v.to_numpy()[on]).astype(float)), float)):
                got[i] = y.tolist()
        return pd.Series(got, dtype=object)

    return df.withColumn(out, run(F.col(vec_col).cast("array<double>")))


def dropout_evaluations(df: DataFrame, model: Layers, vec_col: str, n_evals: int = 25, rate: float = 0.5, key: str = "id", seed: int = 0, out: str = "evaluations") -> DataFrame:
    """Adds ``n_evals`` first outputs of a model whose dropout stays on. Masks come
    from a hash of each row's key, so they repeat whatever the batches."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(v: pd.Series, k: pd.Series) -> pd.Series:
        rows = []
        for x, h in zip(v, k):
            rng = np.random.default_rng([seed, int(h) & 0x7FFFFFFFFFFFFFFF])
            rows.append(None if x is None else model(np.repeat(np.asarray(x, float)[None], n_evals, 0), rate, rng)[:, 0].tolist())
        return pd.Series(rows)

    return df.withColumn(out, run(F.col(vec_col).cast("array<double>"), F.xxhash64(key)))


def layer_mean(layers: str | Column) -> Column:
    """Mean of several layers' vectors: an array of arrays to one array."""
    a = col(layers)
    n = F.size(a)
    total = F.aggregate(F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))), F.get(a, F.lit(0)), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    return F.transform(total, lambda x: x / n)


def scale_by_instance(v: str | Column, eps: float = 1e-12) -> Column:
    """Each row to mean 0 and population deviation 1."""
    of = F.struct(mean(v).alias("mean"), deviation(v).alias("dev"))
    return bind(of, lambda m: F.transform(col(v), lambda x: (x - m["mean"]) / (m["dev"] + eps)))


def scale_minmax(df: DataFrame, features: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Features to a range by their least and largest value, one aggregate; a
    constant feature goes to ``low``."""
    m = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    return df.withColumns({c: low + (high - low) * F.coalesce(F.try_divide(F.col(c) - m[f"lo_{c}"], F.lit(m[f"hi_{c}"] - m[f"lo_{c}"])), F.lit(0.0)) for c in features})


def standardise(df: DataFrame, features: list[str], eps: float = 1e-12) -> DataFrame:
    """Features less their mean over their sample deviation, by one aggregate."""
    m = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))]).first()
    return df.withColumns({c: (F.col(c) - m[f"m_{c}"]) / F.lit((m[f"s_{c}"] or 0.0) + eps) for c in features})


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of a sample whose key another sample hasn't."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def split_by_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(normal, outlier) rows of a 0/1 label."""
    return df.where(F.col(label) == 0), df.where(F.col(label) == 1)
