"""Scores of ordered series: spectral residual, next-step prediction, forecasts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.operators import networks


def pad_same(x: np.ndarray, width: int, method: str = "reflect", side: str = "bilateral") -> np.ndarray:
    """``width - 1`` more values; on both sides the left one gets the odd one."""
    n = width - 1
    left = {"bilateral": n - n // 2, "left": n, "right": 0}[side]
    mode = {"constant": "constant", "replicate": "edge", "reflect": "reflect"}[method]
    return np.pad(x, (left, n - left), mode=mode)


def gradient_estimate(x: np.ndarray, t: np.ndarray, lookback: int) -> float:
    """The value ``lookback`` places from the end plus the mean slope from earlier
    values to the last one times the mean of those distances in time."""
    gap = t[-1] - t[-lookback - 1 : -1]
    return float(x[-lookback] + ((x[-1] - x[-lookback - 1 : -1]) / gap).mean() * gap.mean())


def saliency(x: np.ndarray, window: int, method: str = "reflect") -> np.ndarray:
    """|IFFT| of the log amplitude less its local mean, the phase kept."""
    if len(x) <= window:
        raise ValueError("the series must be longer than the amplitude window")
    spectrum = np.fft.fft(x)
    log = np.log(np.abs(spectrum) + 1e-8)
    half = (len(log) - 1 + 1) // 2
    positive = log[1 : 1 + half]
    smooth = np.convolve(pad_same(positive, window, method), np.ones(window) / window, "valid")
    mirror = smooth[::-1][1:] if (len(log) - 1) % 2 else smooth[::-1]
    average = np.concatenate([log[:1], smooth, mirror])
    return np.abs(np.fft.ifft(np.exp(log - average + 1j * np.angle(spectrum))))


def residual_scores(x: np.ndarray, t: np.ndarray, window_amp: int = 20, window_local: int = 20, n_est_points: int = 10, n_grad_points: int = 5, method: str = "reflect") -> np.ndarray:
    """(saliency - local mean) / local mean; the mean is of earlier points alone."""
    if len(x) <= max(window_amp, window_local):
        raise ValueError("the series must be longer than its windows")
    longer = np.concatenate([x, np.full(n_est_points, gradient_estimate(x, t, n_grad_points))]) if n_est_points else x
    s = saliency(longer, window_amp, method)[: len(x)]
    kernel = np.ones(window_local + 1) / window_local
    kernel[0] = 0.0  # leaves out the point itself
    mean = np.convolve(pad_same(s, window_local + 1, method, "left"), kernel, "valid")
    return (s - mean) / (mean + 1e-8)


def spectral_residual(df: DataFrame, value: str, order: str, series: str | None = None, window_amp: int = 20, window_local: int = 20, n_est_points: int = 10, n_grad_points: int = 5, method: str = "reflect") -> DataFrame:
    """``series, order, value, score`` per series. A transform needs the whole
    series, so a series is one task; series run side by side."""
    held = df.select((F.col(series).cast("string") if series else F.lit("all")).alias("series"), F.col(order).cast("double").alias("t"), F.col(value).cast("double").alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        x, t = pdf["x"].to_numpy(), pdf["t"].to_numpy()
        score = residual_scores(x, t, window_amp, window_local, n_est_points, n_grad_points, method) if len(x) > max(window_amp, window_local) else np.full(len(x), np.nan)
        return pdf.assign(score=score)

    return held.groupBy("series").applyInPandas(run, "series string, t double, x double, score double")


def last_sums(df: DataFrame, value: str, order: str, length: int, series: str, out: str = "total") -> DataFrame:
    """Adds the sum of the last ``length`` values of each series, fewer at its start."""
    w = Window.partitionBy(series).orderBy(order).rowsBetween(1 - length, 0)
    return df.withColumn(out, F.sum(value).over(w))


def local_deviation(value: str, order: str, before: int, after: int, series: str) -> Column:
    """Population deviation of the values from ``before`` places earlier to ``after``
    later in a series."""
    return F.stddev_pop(value).over(Window.partitionBy(series).orderBy(order).rowsBetween(-before, after))


def windows(df: DataFrame, value: str, order: str, length: int, series: str) -> DataFrame:
    """``series, window, values, targets``: windows of ``length`` values without
    overlap and the values one step on. A rest at the end makes no window."""
    w = Window.partitionBy(series).orderBy(order)
    n = df.select(F.col(series).alias("series"), F.col(value).cast("double").alias("x"), F.lead(F.col(value).cast("double")).over(w).alias("y"), (F.row_number().over(w) - 1).alias("i"))
    cut = n.groupBy("series", F.floor(F.col("i") / length).alias("window")).agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("r")).where(F.size("r") == length)
    return cut.select("series", "window", F.transform("r", lambda r: r["x"]).alias("values"), F.transform("r", lambda r: r["y"]).alias("targets"))


def forecast_errors(df: DataFrame, value: str, order: str, series: str, lags: int, ridge: float = 1e-3, train_share: float = 0.5) -> DataFrame:
    """``series, t, x, prediction, error``: squared errors of a linear next-step
    model of each series on its last ``lags`` values, fitted on its first part: a
    stand-in for a recurrent encoder and decoder."""
    held = df.select(F.col(series).cast("string").alias("series"), F.col(order).cast("double").alias("t"), F.col(value).cast("double").alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        x = pdf["x"].to_numpy()
        pred = np.full(len(x), np.nan)
        if len(x) > lags + 1:
            past = np.column_stack([np.ones(len(x) - lags), np.lib.stride_tricks.sliding_window_view(x, lags)[:-1]])
            fit = max(lags + 2, int(len(past) * train_share))
            a, b = past[:fit], x[lags:][:fit]
            pred[lags:] = past @ np.linalg.solve(a.T @ a + ridge * np.eye(lags + 1), a.T @ b)
        return pdf.assign(prediction=pred, error=(x - pred) ** 2)

    return held.groupBy("series").applyInPandas(run, "series string, t double, x double, prediction double, error double")


#: Windows on which a recurrent network is fitted at most, drawn by hash.
WINDOWS = 5000


def sequence_errors(df: DataFrame, value: str, order: str, series: str, length: int = 20, hidden: int = 16, ref: DataFrame | None = None, epochs: int = 40, limit: int = WINDOWS, seed: int = 0, **training) -> DataFrame:
    """``series, window, step, x, prediction, error, estimate``: a recurrent network reads
    windows of each series and predicts their next values; with its squared errors come
    its own estimates of them. It is fitted on windows of ``ref`` (``df`` itself unless
    given). A window is scored by itself, so a long series spreads over tasks; a rest
    at a series' end makes no window, and the step after the last value no row."""
    fit = windows(df if ref is None else ref, value, order, length, series)
    held = fit.orderBy(F.xxhash64(F.lit(seed), F.col("series").cast("string"), "window"), "window").limit(limit).collect()
    if not held:
        raise ValueError("no series has a whole window")
    x, y = (np.array([[np.nan if v is None else v for v in r[c]] for r in held]) for c in ("values", "targets"))
    mean, dev = x.mean(), x.std() + 1e-9
    net = networks.Recurrent.make(hidden, seed).fit((x - mean) / dev, (y - mean) / dev, epochs, seed, **training)

    @F.pandas_udf("array<struct<prediction:double,estimate:double>>")
    def predict(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        p, e = net((np.stack(v.to_numpy()).astype(float) - mean) / dev)
        return pd.Series([[{"prediction": a, "estimate": b} for a, b in zip(*r)] for r in zip((p * dev + mean).tolist(), (e * dev * dev).tolist())])

    scored = windows(df, value, order, length, series).withColumn("p", predict("values"))
    rows = scored.select("series", "window", F.posexplode(F.arrays_zip("targets", "p")).alias("step", "r")).select("series", "window", "step", F.col("r.targets").alias("x"), "r.p.*").where("x is not null")
    return rows.select("series", "window", "step", "x", "prediction", F.pow(F.col("x") - F.col("prediction"), 2).alias("error"), "estimate")


def interval_scores(df: DataFrame) -> DataFrame:
    """Adds ``score`` and ``is_outlier`` to rows with ``y, yhat, yhat_lower,
    yhat_upper``: how far beyond the bound on its side a value lies."""
    y, up = F.col("y"), F.col("y") >= F.col("yhat")
    return df.withColumn("score", F.when(up, y - F.col("yhat_upper")).otherwise(F.col("yhat_lower") - y)).withColumn("is_outlier", (F.col("score") > 0).cast("int"))


def trend_forecast(train: DataFrame, test: DataFrame, interval: float = 0.8) -> DataFrame:
    """Forecast of ``ds`` (number), ``y`` by a straight line, with an interval of
    the residuals' normal quantile: all by aggregates, for one long series."""
    fit = train.agg(F.regr_slope("y", "ds").alias("b"), F.regr_intercept("y", "ds").alias("a"), F.sqrt(F.regr_syy("y", "ds") * (1 - F.regr_r2("y", "ds")) / F.count("y")).alias("sd"))
    z = _normal_quantile(0.5 + interval / 2)
    yhat = F.col("a") + F.col("b") * F.col("ds")
    out = test.crossJoin(F.broadcast(fit)).select(*test.columns, yhat.alias("yhat"), (yhat - z * F.col("sd")).alias("yhat_lower"), (yhat + z * F.col("sd")).alias("yhat_upper"))  # one row
    return interval_scores(out)


def _normal_quantile(p: float) -> float:
    low, high = -10.0, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


def _design(t: np.ndarray, start: float, span: float, periods: dict[float, int], knots: np.ndarray) -> np.ndarray:
    u = (t - start) / span
    cols = [np.ones_like(u), u, *[np.maximum(0, u - k) for k in knots]]
    for period, order in periods.items():
        for k in range(1, order + 1):
            a = 2 * math.pi * k * t / period
            cols += [np.sin(a), np.cos(a)]
    return np.column_stack(cols)


def seasonal_forecast(train: DataFrame, test: DataFrame, series: str = "series", periods: dict[float, int] | None = None, knots: int = 5, growth: str = "linear", interval: float = 0.8, ridge: float = 1e-2) -> DataFrame:
    """Per series: a trend with changes of slope and Fourier seasons by ridge
    regression; the interval is the residuals' quantiles. ``ds`` counts days.
    ``growth="logistic"`` models the logit of y / cap and needs ``cap``. Deviation
    from sampled posteriors: the interval holds no uncertainty of the trend.
    """
    periods = {7.0: 3, 365.25: 10} if periods is None else periods
    cap = ["cap"] if growth == "logistic" else []
    cols = [series, "ds", "y", *cap]
    both = train.select(*cols, F.lit(1).alias("is_train")).unionByName(test.select(*cols, F.lit(0).alias("is_train")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds", kind="stable")
        fit = pdf[pdf["is_train"] == 1]
        t = fit["ds"].to_numpy(float)
        start, span = (t.min(), max(t.max() - t.min(), 1.0)) if len(t) else (0.0, 1.0)
        bends = np.linspace(0, 0.8, knots + 2)[1:-1]
        usable = {p: k for p, k in periods.items() if span >= 2 * p}
        to = (lambda y, c: np.log(np.clip(y / c, 1e-6, 1 - 1e-6) / (1 - np.clip(y / c, 1e-6, 1 - 1e-6)))) if cap else (lambda y, c: y)
        back = (lambda z, c: c / (1 + np.exp(-z))) if cap else (lambda z, c: z)
        out = pdf[pdf["is_train"] == 0].copy()
        if not len(fit):
            return out.assign(yhat=np.nan, yhat_lower=np.nan, yhat_upper=np.nan)[[series, "ds", "y", "yhat", "yhat_lower", "yhat_upper"]]
        x = _design(t, start, span, usable, bends)
        y = to(fit["y"].to_numpy(float), fit["cap"].to_numpy(float) if cap else None)
        penalty = ridge * np.eye(x.shape[1])
        penalty[:2, :2] = 1e-9 * np.eye(2)
        w = np.linalg.solve(x.T @ x + penalty, x.T @ y)
        low, high = np.quantile(y - x @ w, [(1 - interval) / 2, (1 + interval) / 2])
        z = _design(out["ds"].to_numpy(float), start, span, usable, bends) @ w
        c = out["cap"].to_numpy(float) if cap else None
        return out.assign(yhat=back(z, c), yhat_lower=back(z + low, c), yhat_upper=back(z + high, c))[[series, "ds", "y", "yhat", "yhat_lower", "yhat_upper"]]

    kind = dict(train.dtypes)[series]
    return interval_scores(both.groupBy(series).applyInPandas(run, f"{series} {kind}, ds double, y double, yhat double, yhat_lower double, yhat_upper double"))
