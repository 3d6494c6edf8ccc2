"""Density, margin and isolation scores: Gaussian mixture, one-class SVM, isolation forest."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.functions.frames import spread
from driftlane.operators.projection import moments, vector


def gaussian_energy(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """-log of a mixture's density for each row."""
    d = x.shape[1]
    logs = []
    for w, m, c in zip(weights, means, covs):
        low = np.linalg.cholesky(c + eps * np.eye(d))
        z = np.linalg.solve(low, (x - m).T)
        logs.append(math.log(max(w, 1e-300)) - 0.5 * (z**2).sum(0) - np.log(np.diag(low)).sum() - 0.5 * d * math.log(2 * math.pi))
    logs = np.stack(logs)
    top = logs.max(0)
    return -(top + np.log(np.exp(logs - top).sum(0)))


def gmm(df: DataFrame, ref: DataFrame, features: list[str] | str, n_components: int = 2, seed: int = 0) -> DataFrame:
    """Adds ``score``: minus the log density under a mixture fitted on the reference."""
    if n_components == 1:
        _, mean, cov = moments(ref, features)
        weights, means, covs = np.ones(1), mean[None], cov[None]
    else:
        weights, means, covs = _fit_gmm(ref, features, n_components, seed)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(gaussian_energy(np.stack(v.to_numpy()).astype(float), weights, means, covs, 1e-9))

    return spread(df).withColumn("score", score(vector(features)))


def _fit_gmm(ref: DataFrame, features: list[str] | str, n_components: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = spread(ref).select(array_to_vector(vector(features)).alias("__v")).persist()  # read again in each round
    fitted = GaussianMixture(k=n_components, seed=seed, featuresCol="__v").fit(rows)
    rows.unpersist()
    params = fitted.gaussiansDF.collect()
    return np.array(fitted.weights), np.array([r.mean.toArray() for r in params]), np.array([r.cov.toArray() for r in params])


def svm(df: DataFrame, ref: DataFrame, features: list[str] | str, nu: float, n_components: int = 50, kernel: Callable | None = None, id_col: str = "id", steps: int = 60, seed: int = 0) -> DataFrame:
    """Adds ``score``: minus the margin of a one-class SVM in Nystroem features.

    Landmarks are ``n_components`` reference rows drawn by hash. Weights descend
    the loss nu-hinge of the reference by full gradients, an aggregate over the
    reference's features in each step; the best of log-spaced step sizes is taken.
    """
    from driftlane.operators.kernels import GaussianRBF, squared_distances

    held = ref.select(F.col(id_col).alias("i"), vector(features).alias("v")).orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(n_components).collect()
    z = np.array([r.v for r in held])
    if kernel is None:
        d = squared_distances(z, z)[np.triu_indices(len(z), 1)]
        kernel = GaussianRBF((float(np.sqrt(np.median(d) / 2)) if len(d) else 1.0,))
    u, s, vt = np.linalg.svd(kernel(z, z))
    half = (u / np.sqrt(np.maximum(s, 1e-12))) @ vt

    def gradients(w: np.ndarray, rho: float) -> tuple[float, np.ndarray, float, int]:
        def part(batches):
            for b in batches:
                phi = kernel(np.stack(b["v"].to_numpy()).astype(float), z) @ half
                m = rho - phi @ w
                on = m > 0
                yield pd.DataFrame([{"n": len(phi), "loss": float(m[on].sum()), "rho": int(on.sum()), "g": phi[on].sum(0).tolist()}])

        out = rows.mapInPandas(part, "n long, loss double, rho long, g array<double>")
        r = out.agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum("rho").alias("rho"), *[F.sum(F.get("g", F.lit(i))).alias(f"g{i}") for i in range(len(z))]).first()
        n = r.n
        loss = 0.5 * w @ w - rho + r.loss / (nu * n)
        return loss, w - np.array([r[f"g{i}"] for i in range(len(z))]) / (nu * n), -1 + r.rho / (nu * n), n

    rows = ref.select(vector(features).alias("v")).persist()
    w, rho = np.full(len(z), 1e-3), 0.0
    loss, gw, gr, _ = gradients(w, rho)
    step = 1.0
    for _ in range(steps):
        tried = gradients(w - step * gw, rho - step * gr)
        if tried[0] < loss - 1e-12:
            w, rho = w - step * gw, rho - step * gr
            done = loss - tried[0] < 1e-6 * max(1.0, abs(loss))
            loss, gw, gr = tried[:3]
            step *= 1.5
            if done:
                break
        else:
            step /= 4
            if step < 1e-6:
                break
    rows.unpersist()
    unit = w / max(np.linalg.norm(w), 1e-12)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(-(kernel(np.stack(v.to_numpy()).astype(float), z) @ half) @ unit)

    return df.withColumn("score", score(vector(features)))


def _harmonic(n: float) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """An isolation tree as arrays (feature or -1, cut or depth, left, right)."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, depth + _harmonic(len(rows)), -1, -1])
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if depth < limit and len(spread):
            f = int(rng.choice(spread))
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            left = rows[:, f] <= cut
            nodes[at] = [f, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)]
        return at

    grow(x, 0)
    return tuple(np.array(nodes).T)


def isolation_forest(df: DataFrame, ref: DataFrame, features: list[str] | str, n_estimators: int = 100, max_samples: int = 256, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Adds ``score`` = 2 ** (-mean path / c(sample)) - 0.5; above 0 is unusual.

    Each tree draws its ``max_samples`` reference rows by a hash of its own, as the
    least of a partial sort, and grows in its own task; the trees, of bounded
    size, go with the scoring function.
    """
    pool = ref.select(F.col(id_col).alias("i"), vector(features).alias("v"))
    n = pool.count()
    size = min(max_samples, n)
    share = min(1.0, (size + 8 * math.sqrt(size) + 16) / max(n, 1))
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, "i"), F.lit(1 << 40))
    trees_of = F.filter(F.sequence(F.lit(0), F.lit(n_estimators - 1)), lambda t: draw(t) < share * (1 << 40))  # a row makes rows for these alone
    drawn = pool.withColumn("t", F.explode(trees_of)).withColumn("o", draw(F.col("t")))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(pdf.sort_values(["o", "i"])["v"].to_numpy()[:size])
        tree = grow_tree(rows.astype(float), np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame([{"t": int(key[0]), **{k: a.tolist() for k, a in zip("fclr", tree)}}])

    trees = drawn.groupBy("t").applyInPandas(grow, "t int, f array<double>, c array<double>, l array<double>, r array<double>").orderBy("t").collect()
    forest = [tuple(np.array(r[k]) for k in "fclr") for r in trees]
    scale = max(_harmonic(size), 1e-12)

    # all trees in one table of nodes: two children each, those of a leaf are itself
    offset = np.cumsum([0, *(len(t[0]) for t in forest)])
    feature, cut, left, right = (np.concatenate(c) for c in zip(*forest)) if forest else (np.zeros(0),) * 4
    add, own = np.repeat(offset[:-1], np.diff(offset)), np.arange(len(feature))
    kids = np.stack([np.where(feature >= 0, x + add, own) for x in (right, left)], 1).ravel().astype(np.int32)
    feature = np.maximum(feature, 0).astype(np.int32)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, 1))
        flat, start, depth = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
        for root in offset[:-1].tolist():
            at = np.full(len(x), root, np.int32)
            while True:
                after = kids.take(2 * at + (flat.take(start + feature.take(at)) <= cut.take(at)))
                if (after == at).all():
                    break
                at = after
            depth += cut.take(at)
        return pd.Series(2 ** (-depth / max(len(forest), 1) / scale) - 0.5)

    return spread(df).withColumn("score", score(vector(features)))
