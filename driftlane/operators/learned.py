"""Drift by trained models: classifiers, learned kernels, contexts, uncertainty."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.functions import stats
from driftlane.functions.columns import deviation, entropy, margin, softmax
from driftlane.functions.frames import kept, spread
from driftlane.operators import kernels, networks, univariate
from driftlane.operators.projection import vector


def folds(k: int, *keys: str, seed: int = 0) -> Column:
    """A fold from 0 to k - 1 that a row's keys determine."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(k)).cast("int")


def classifier(kind: str = "lr", seed: int = 0, **params) -> Estimator:
    made = {"lr": LogisticRegression, "rf": RandomForestClassifier, "gbt": GBTClassifier, "svc": LinearSVC, "mlp": MultilayerPerceptronClassifier}[kind]
    if kind in ("rf", "gbt", "mlp"):
        params = {"seed": seed} | params
    return made(featuresCol="__v", labelCol="__y", **params)


#: Cells of binned features up to which boosted trees are fitted on cells and not on rows.
CELLS = 1 << 20


def bin_cuts(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Of each feature the values up to which its bins reach: each distinct value has a
    bin if there are ``bins`` at most, else they are quantiles."""
    x = [F.col(f).cast("double") for f in features]
    shares = [i / bins for i in range(1, bins)]
    found = list(df.agg(*[F.approx_count_distinct(c, 0.02) for c in x], *[F.percentile_approx(c, shares, 10_000) for c in x]).first())
    few = [i for i, n in enumerate(found[: len(x)]) if n <= 2 * bins]  # an estimate; sets of so few values are small
    held = dict(zip(few, df.agg(*[F.collect_set(x[i]) for i in few]).first())) if few else {}
    exact = {i: sorted(v)[:-1] for i, v in held.items() if len(v) <= bins}
    return [exact.get(i, sorted(set(q or []))) for i, q in enumerate(found[len(x) :])]


def _of_cells(both: DataFrame, features: list[str], cuts: list[list[float]], held: range | list[int], est: Estimator) -> DataFrame:
    """As ``out_of_fold``, from trees fitted on cells with the number of their rows as
    weight. Trees see bins alone, so these are the trees of all rows, and work of a
    fit follows the cells."""
    sizes = [len(c) + 1 for c in cuts]
    strides = np.cumprod([1, *sizes[:-1]]).tolist()

    @F.pandas_udf("long")
    def place(*x: pd.Series) -> pd.Series:
        return pd.Series(sum(np.searchsorted(c, v.to_numpy(float)) * s for v, c, s in zip(x, cuts, strides)), dtype="int64")

    whole = functools.reduce(Column.__and__, [F.col(f).isNotNull() for f in features])
    cell = F.when(whole, place(*[F.col(f).cast("double") for f in features]))
    rows = kept(both.select("key", "is_ref", "fold", "__y", cell.alias("cell")))
    counts = kept(rows.groupBy("fold", "__y", "cell").agg(F.count(F.lit(1)).cast("double").alias("__w")))
    v = array_to_vector(F.array(*[F.pmod(F.floor(F.col("cell") / s), F.lit(n)).cast("double") for s, n in zip(strides, sizes)])).alias("__v")
    est, parts = est.copy({est.weightCol: "__w"}), []
    for f in held:
        train = counts.where(F.col("fold") != f).groupBy("__y", "cell").agg(F.sum("__w").alias("__w"))
        fitted = est.fit(train.select("__y", "__w", v))
        out = fitted.transform(counts.where(F.col("fold") == f).select("cell").distinct().select("cell", v))
        parts.append(out.select(F.lit(f).alias("fold"), "cell", F.get(vector_to_array("probability"), F.lit(1)).alias("prob")))
    probs = kept(functools.reduce(DataFrame.unionAll, parts))
    return rows.join(F.broadcast(probs), ["fold", "cell"]).select("key", "is_ref", "fold", "prob")  # a row per fold and cell


def out_of_fold(ref: DataFrame, test: DataFrame, features: list[str] | str, key: str, model: str | Estimator = "lr", n_folds: int | None = 5, train_size: float = 0.75, seed: int = 0) -> DataFrame:
    """``key, is_ref, fold, prob``: probability (or score) of the test sample for
    rows whose model has not seen them: k folds, or one held-out share."""
    named = [features] if isinstance(features, str) else list(features)
    x = [F.col(f).alias(f"__x{i}") for i, f in enumerate(named)]
    both = ref.select(F.col(key).alias("key"), F.lit(1).alias("is_ref"), *x).unionByName(test.select(F.col(key).alias("key"), F.lit(0).alias("is_ref"), *x))
    both = both.withColumn("__y", (1 - F.col("is_ref")).cast("double"))
    if n_folds:
        both, held = both.withColumn("fold", folds(n_folds, "key", "is_ref", seed=seed)), range(n_folds)
    else:
        share = F.pmod(F.xxhash64(F.lit(seed), "key", "is_ref"), F.lit(1 << 40)) < train_size * (1 << 40)
        both, held = both.withColumn("fold", F.when(share, 1).otherwise(0)), [0]
    est = classifier(model, seed) if isinstance(model, str) else model
    named = [f"__x{i}" for i in range(len(named))]
    if isinstance(model, str) and model == "gbt" and not isinstance(features, str):
        both = kept(spread(both))  # passes over it are long: they use all cores
        cuts = bin_cuts(both, named, est.getMaxBins())
        if math.prod(len(c) + 1 for c in cuts) <= CELLS:
            return _of_cells(both, named, cuts, held, est)
    v = array_to_vector(vector(named[0] if isinstance(features, str) else named)).alias("__v")
    both = kept(both.select("key", "is_ref", "__y", "fold", v))
    parts = []
    for f in held:
        fitted = est.fit(both.where(F.col("fold") != f))
        out = fitted.transform(both.where(F.col("fold") == f))
        raw = "probability" if "probability" in out.columns else "rawPrediction"
        parts.append(out.select("key", "is_ref", "fold", F.get(vector_to_array(raw), F.lit(1)).alias("prob")))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def calibrated(probs: DataFrame) -> DataFrame:
    """Rows of ``out_of_fold`` with probabilities that a logistic regression of the
    label on the score makes; a fold's comes from the scores of the other folds (from
    its own, if there is one fold)."""
    held = kept(probs.withColumn("__y", (1 - F.col("is_ref")).cast("double")).withColumn("__v", array_to_vector(F.array("prob"))))
    names = sorted(r.fold for r in held.select("fold").distinct().collect())
    parts = []
    for f in names:
        fitted = classifier("lr").fit(held.where(F.col("fold") != f) if len(names) > 1 else held)
        out = fitted.transform(held.where(F.col("fold") == f).drop("prob"))
        parts.append(out.select("key", "is_ref", "fold", F.get(vector_to_array("probability"), F.lit(1)).alias("prob")))
    return functools.reduce(DataFrame.unionAll, parts)


def out_of_bag(ref: DataFrame, test: DataFrame, features: list[str] | str, key: str, model: str | Estimator | None = None, bags: int = 10, share: float = 0.632, seed: int = 0) -> DataFrame:
    """``key, is_ref, fold, prob``: the mean over the models whose bag a row isn't in.
    A bag is a ``share`` of the rows by a hash of its own; the model is a decision
    tree unless given. Rows that are in every bag are left out."""
    v = array_to_vector(vector(features)).alias("__v")
    both = ref.select(F.col(key).alias("key"), F.lit(1).alias("is_ref"), v).unionByName(test.select(F.col(key).alias("key"), F.lit(0).alias("is_ref"), v))
    both = kept(both.withColumn("__y", (1 - F.col("is_ref")).cast("double")))
    est = classifier(model, seed) if isinstance(model, str) else model or DecisionTreeClassifier(featuresCol="__v", labelCol="__y", maxDepth=8, seed=seed)
    parts = []
    for b in range(bags):
        inside = F.pmod(F.xxhash64(F.lit(seed), F.lit(b), "key", "is_ref"), F.lit(1 << 40)) < int(share * (1 << 40))
        out = est.fit(both.where(inside)).transform(both.where(~inside))
        parts.append(out.select("key", "is_ref", F.get(vector_to_array("probability"), F.lit(1)).alias("prob")))
    return functools.reduce(DataFrame.unionAll, parts).groupBy("key", "is_ref").agg(F.avg("prob").alias("prob")).withColumn("fold", F.lit(0))


def soft_test(probs: DataFrame) -> DataFrame:
    """KS test that the test sample's probabilities lie higher: ``distance, p_val``."""
    return univariate.ks(probs, ["prob"], "greater", exact=True).select("distance", "p_val")


def hard_test(probs: DataFrame) -> DataFrame:
    """Binomial test that the classifier beats the share of the larger sample.

    ``accuracy, distance, p_val``; the distance is 1 - (1 - acc) / (1 - share), 0
    at least."""
    right = ((F.col("prob") > 0.5).cast("int") == 1 - F.col("is_ref")).cast("long")
    c = probs.agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("correct"), F.greatest(F.sum("is_ref"), F.sum(1 - F.col("is_ref"))).alias("most"))
    base, acc = F.try_divide("most", "n"), F.try_divide("correct", "n")

    @F.pandas_udf("double")
    def p_value(k: pd.Series, n: pd.Series, share: pd.Series) -> pd.Series:
        return pd.Series([stats.binom_sf(int(a), int(b), float(s)) if b else None for a, b, s in zip(k, n, share)], dtype="float64")

    return c.select(acc.alias("accuracy"), F.greatest(F.lit(0.0), 1 - F.try_divide(1 - acc, 1 - base)).alias("distance"), p_value("correct", "n", base).alias("p_val"))


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row, ``accuracy``: the share of rows whose prediction is their label."""
    right = (F.col(label).cast("double") == F.col(predicted).cast("double")).cast("int")
    return df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).agg(F.avg(right).alias("accuracy"))


def classifier_drift(ref: DataFrame, test: DataFrame, features: list[str] | str, key: str, model: str | Estimator = "lr", p_val: float = 0.05, binarise: bool = False, n_folds: int | None = 5, seed: int = 0, calibrate: bool = False, use_oob: bool = False) -> DataFrame:
    """One row: ``distance, p_val, threshold, is_drift``. ``use_oob`` takes scores
    out of bags instead of folds; ``calibrate`` makes scores probabilities."""
    probs = out_of_bag(ref, test, features, key, None if model == "rf" else model, seed=seed) if use_oob else out_of_fold(ref, test, features, key, model, n_folds, seed=seed)
    probs = calibrated(probs) if calibrate else probs
    out = hard_test(probs) if binarise else soft_test(probs)
    return univariate.feature_decision(out.select("distance", "p_val"), p_val)


def classifier_uncertainty(probs: str | Column, kind: str = "entropy", width: float = 0.1, logits: bool = False) -> Column:
    p = softmax(probs) if logits else probs
    return entropy(p) if kind == "entropy" else margin(p, width)


def regressor_uncertainty(evaluations: str | Column) -> Column:
    """Population deviation over repeated evaluations of a row."""
    return deviation(evaluations)


def classifier_uncertainty_drift(pairs: DataFrame, probs: str, kind: str = "entropy", width: float = 0.1, logits: bool = False, flag: str = "is_ref") -> DataFrame:
    u = pairs.select(flag, classifier_uncertainty(probs, kind, width, logits).alias("uncertainty"))
    return univariate.ks(u, ["uncertainty"], flag=flag) if kind == "entropy" else univariate.chi2(u, ["uncertainty"], flag=flag)


def regressor_uncertainty_drift(pairs: DataFrame, evaluations: str, flag: str = "is_ref") -> DataFrame:
    return univariate.ks(pairs.select(flag, regressor_uncertainty(evaluations).alias("uncertainty")), ["uncertainty"], flag=flag)


# -- kernels that are trained --------------------------------------------------


def _h(kernel: np.ndarray, n: int) -> np.ndarray:
    """h_ij = k(x_i,x_j) + k(y_i,y_j) - k(x_i,y_j) - k(y_i,x_j) of paired halves."""
    return kernel[:n, :n] + kernel[n:, n:] - kernel[:n, n:] - kernel[n:, :n]


def signal(kernel: np.ndarray, var_reg: float = 1e-5) -> tuple[float, np.ndarray]:
    """Estimate of MMD^2 over its deviation, what makes a kernel powerful, from the
    kernel matrix of two samples of one size, and its gradient by that matrix."""
    n = len(kernel) // 2
    h = _h(kernel, n)
    rows, whole = h.sum(1), h.sum()
    mmd = (whole - np.trace(h)) / (n * (n - 1))
    var = 4 * ((rows**2).sum() / n**3 - (whole / n**2) ** 2)
    dev = np.sqrt(max(var, 0) + var_reg)
    by_h = (1 - np.eye(n)) / (n * (n - 1)) / dev
    if var > 0:
        by_h = by_h - mmd / (2 * dev**3) * 8 * (rows[:, None] / n**3 - whole / n**4)
    return float(mmd / dev), np.block([[by_h, -by_h], [-by_h, by_h]])


def train_kernel(x: np.ndarray, y: np.ndarray, projection_dims: int = 4, hidden: int = 16, var_reg: float = 1e-5, epochs: int = 20, batch: int = 128, rate: float = 1e-2, seed: int = 0, optimiser: Callable = networks.Adam) -> tuple[kernels.DeepKernel, list[float]]:
    """A deep kernel whose projection network, two bandwidths and mixing share climb
    the signal on batches of both samples; and the mean loss, minus the signal, of
    each epoch. Rows are standardised before the network."""
    both = np.concatenate([x, y])
    net = networks.Network.make([x.shape[1], hidden, projection_dims], seed)
    net.weights[0] /= both.std(0)[:, None] + 1e-9
    net.biases[0] -= both.mean(0) @ net.weights[0]
    d = kernels.squared_distances(both[:1000], both[:1000])[np.triu_indices(min(len(both), 1000), 1)]
    p = net(both[:1000])
    near = kernels.squared_distances(p, p)[np.triu_indices(len(p), 1)]
    width = lambda v: np.array([0.5 * np.log(max(float(np.median(v)), 1e-12) / 2)])
    free = [width(near), width(d), np.zeros(1)]  # log bandwidths, logit of the share of the kernel on whole rows
    n = min(len(x), len(y))

    def loss(at: np.ndarray, rng: np.random.Generator) -> tuple[float, list[np.ndarray]]:
        z = np.concatenate([x[at], y[rng.permutation(len(y))[: len(at)]]])
        outs = net.layers(z)
        p, (sa, sb, logit) = outs[-1], free
        eps = 1 / (1 + np.exp(-logit[0]))
        da, db = kernels.squared_distances(p, p), kernels.squared_distances(z, z)
        va, vb = np.exp(2 * sa[0]), np.exp(2 * sb[0])
        ka, kb = np.exp(-da / (2 * va)), np.exp(-db / (2 * vb))
        value, g = signal((1 - eps) * ka + eps * kb, var_reg)
        w = -g * (1 - eps) * ka / (2 * va)
        w = w + w.T
        to_p = 2 * (w.sum(1)[:, None] * p - w @ p)
        own = [np.array([(g * (1 - eps) * ka * da).sum() / va]), np.array([(g * eps * kb * db).sum() / vb]), np.array([(g * (kb - ka)).sum() * eps * (1 - eps)])]
        return -value, [-q for q in [*net.back(to_p, outs)[0], *own]]

    losses = networks.train([*net.params, *free], loss, n, epochs, min(batch, n), rate, seed, optimiser)
    rbf = lambda s: kernels.GaussianRBF((float(np.exp(s[0])),))
    return kernels.DeepKernel(net, rbf(free[0]), rbf(free[1]), float(1 / (1 + np.exp(-free[2][0])))), losses


def learned_kernel_drift(ref: DataFrame, test: DataFrame, vec_col: str, id_col: str, p_val: float = 0.05, permutations: int = 100, train_size: float = 0.75, limit: int = 5000, seed: int = 0, **training) -> dict:
    """Trains a kernel on a share of both samples (``limit`` rows each at most) and
    tests with it on all the rest, by permutations over tiles."""
    share = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 40)) < train_size * (1 << 40)
    order = F.xxhash64(F.lit(seed + 1), id_col)
    held = []
    for df in (ref, test):
        rows = df.where(share).select(F.col(vec_col).cast("array<double>").alias("v"), order.alias("o")).orderBy("o").limit(limit).collect()
        held.append(np.array([r.v for r in rows]))
    kernel, _ = train_kernel(*held, seed=seed, **training)
    return kernels.mmd(ref.where(~share), test.where(~share), kernel, p_val, permutations, vec_col, id_col, seed)


class Linear:
    """A projection that can be sent to tasks."""

    def __init__(self, w: np.ndarray):
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w


def spot_the_diff(x: np.ndarray, y: np.ndarray, n_diffs: int = 1, l1: float = 0.01, epochs: int = 100, rate: float = 0.05, seed: int = 0) -> tuple[dict, Callable[[np.ndarray], np.ndarray]]:
    """An interpretable classifier of reference ``x`` and test ``y``.

    Its logit is b + sum_j c_j k(z, mean(x) + diff_j); P(test) is the logistic of
    twice that. Returns the diffs and their coefficients, and the function of rows
    that gives P(test)."""
    rng = np.random.default_rng(seed)
    z = np.concatenate([x, y])
    target = np.concatenate([np.zeros(len(x)), np.ones(len(y))])
    mean, d = x.mean(0), kernels.squared_distances(z[:1000], z[:1000])
    var = float(np.median(d[np.triu_indices(len(d), 1)])) or 1.0
    diffs, coeffs, bias = rng.normal(size=(n_diffs, x.shape[1])) * x.std(0) * 0.1 + (y.mean(0) - mean), np.full(n_diffs, 0.1), 0.0
    m = [np.zeros_like(diffs), np.zeros_like(coeffs), 0.0]
    v = [np.zeros_like(diffs), np.zeros_like(coeffs), 0.0]
    for t in range(1, epochs + 1):
        k = np.exp(-kernels.squared_distances(z, mean + diffs) / var)
        err = (1 / (1 + np.exp(-2 * (bias + k @ coeffs))) - target) * 2 / len(z)
        pull = z[:, None] - mean - diffs[None]
        grads = [np.einsum("n,nj,njd->jd", err, k * coeffs, pull) * 2 / var + l1 * np.sign(diffs) / diffs.size, k.T @ err, err.sum()]
        new = []
        for i, (p, g) in enumerate(zip((diffs, coeffs, bias), grads)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            new.append(p - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8))
        diffs, coeffs, bias = new

    def prob(w: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * (bias + np.exp(-kernels.squared_distances(w, mean + diffs) / var) @ coeffs)))

    return {"diffs": diffs, "diff_coeffs": coeffs}, prob


def spot_the_diff_drift(ref: DataFrame, test: DataFrame, vec_col: str, id_col: str, p_val: float = 0.05, n_diffs: int = 1, train_size: float = 0.75, limit: int = 5000, seed: int = 0) -> dict:
    """Fits on a share of both samples (``limit`` rows each at most, drawn by hash) and
    tests the probabilities of all held-out rows."""
    share = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 40)) < train_size * (1 << 40)
    order = F.xxhash64(F.lit(seed + 1), id_col)
    vec = F.col(vec_col).cast("array<double>").alias("v")

    def rows(df: DataFrame) -> np.ndarray:
        got = df.where(share).select(vec, order.alias("o")).orderBy("o").limit(limit).collect()
        return np.array([r.v for r in got])

    found, prob = spot_the_diff(rows(ref), rows(test), n_diffs, seed=seed)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(prob(np.stack(v.to_numpy()).astype(float)) if len(v) else np.zeros(0))

    held = ref.where(~share).select(vec, F.lit(1).alias("is_ref")).unionByName(test.where(~share).select(vec, F.lit(0).alias("is_ref")))
    out = soft_test(spread(held).select("is_ref", score("v").alias("prob"))).first()
    return {"is_drift": int(out.p_val < p_val), "distance": out.distance, "p_val": out.p_val, "threshold": p_val} | found


# -- drift given a context -----------------------------------------------------


def kernel_logistic(k: np.ndarray, target: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Coefficients of ridge logistic regression on the rows of a kernel: rounds end
    where only rounding moves them."""
    a = np.zeros(len(k))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-k @ a))
        w = np.maximum(p * (1 - p), 1e-6)
        left = k.copy()
        left[np.diag_indices(len(k))] += ridge / w
        a, old = np.linalg.solve(left, k @ a + (target - p) / w), a
        if np.abs(a - old).max(initial=0) <= 1e-12 * np.abs(a).max(initial=0):
            break
    return a


def pick_lambda(l_mat: np.ndarray, k: np.ndarray, n_folds: int = 5, seed: int = 0) -> float:
    """The regulariser 2**-i of a conditional mean embedding with least loss over folds.

    A fold's kernel is brought to its eigenvectors once; each regulariser then costs a
    product with a vector of its eigenvalues."""
    order = np.random.default_rng(seed).permutation(len(k))
    lams, totals = 2.0 ** -np.arange(20), np.zeros(20)
    for part in np.array_split(order, n_folds):
        rest = np.setdiff1d(order, part)
        values, q = np.linalg.eigh(l_mat[np.ix_(rest, rest)])
        at = q.T @ l_mat[np.ix_(rest, part)]
        both = (q.T @ k[np.ix_(rest, rest)] @ q) * (at @ at.T)
        cross = ((q.T @ k[np.ix_(rest, part)]) * at).sum(1)
        scale = 1 / (values + lams[:, None] * len(rest))
        totals += np.trace(k[np.ix_(part, part)]) + ((scale @ both) * scale).sum(1) - 2 * scale @ cross
    return min(zip(totals.tolist(), lams.tolist()))[1]


def conditional_mmd(k: np.ndarray, l_mat: np.ndarray, l_held: np.ndarray, is_test: np.ndarray, lams: tuple[float, float], couplings: bool = True) -> tuple[float, dict]:
    """Squared MMD of the two conditional embeddings, mean over held-out contexts,
    and the couplings of rows if asked for."""
    a, on = {}, {t: np.flatnonzero(is_test == t) for t in (0, 1)}
    for t, lam in zip((0, 1), lams):
        left = l_mat[np.ix_(on[t], on[t])]
        left[np.diag_indices(len(left))] += lam * len(left)
        a[t] = np.linalg.solve(left, l_held[on[t]])
    n = l_held.shape[1]
    inner = lambda s, t: (a[s] * (k[np.ix_(on[s], on[t])] @ a[t])).sum() / n
    value = inner(0, 0) + inner(1, 1) - 2 * inner(0, 1)
    return float(value), {f"{'xy'[s]}{'xy'[t]}": a[s] @ a[t].T / n for s, t in ((0, 0), (1, 1), (0, 1))} if couplings else {}


def context_mmd(x: np.ndarray, c: np.ndarray, is_test: np.ndarray, p_val: float = 0.05, permutations: int = 100, held_share: float = 0.25, n_folds: int = 5, seed: int = 0) -> dict:
    """Test of drift in x beyond what its context c explains.

    Test contexts are held out for the mean; memberships are redrawn from the
    estimated probability of a row's context to be a test context. Regularisers are
    picked once per test. Cubic in the rows: for one segment of a few thousand.
    """
    rng = np.random.default_rng(seed)
    test = np.flatnonzero(is_test == 1)
    held = rng.choice(test, max(1, int(held_share * len(test))), replace=False)
    keep = np.setdiff1d(np.arange(len(x)), held)
    xs, cs, t = x[keep], c[keep], is_test[keep]

    def rbf(z: np.ndarray) -> kernels.GaussianRBF:
        d = kernels.squared_distances(z, z).ravel()
        return kernels.GaussianRBF((float(np.sqrt(np.partition(d, len(d) // 2)[len(d) // 2] / 2)) or 1.0,))

    kx, kc = rbf(xs), rbf(cs)
    k, l_mat, l_held = kx(xs, xs), kc(cs, cs), kc(cs, c[held])
    lams = tuple(pick_lambda(l_mat[np.ix_(on, on)], k[np.ix_(on, on)], n_folds, seed) for on in (np.flatnonzero(t == 0), np.flatnonzero(t == 1)))
    value, w = conditional_mmd(k, l_mat, l_held, t, lams)
    p_test = np.clip(1 / (1 + np.exp(-l_mat @ kernel_logistic(l_mat, t.astype(float)))), 1e-3, 1 - 1e-3)
    null = np.array([conditional_mmd(k, l_mat, l_held, _draw(rng, p_test), lams, couplings=False)[0] for _ in range(permutations)])
    return kernels.permutation_report(np.concatenate([[value], null]), p_val) | {"coupling_xx": w["xx"], "coupling_yy": w["yy"], "coupling_xy": w["xy"]}


def _draw(rng: np.random.Generator, p: np.ndarray) -> np.ndarray:
    while True:
        t = (rng.uniform(size=len(p)) < p).astype(int)
        if 1 < t.sum() < len(t) - 1:
            return t


def context_mmd_drift(pairs: DataFrame, vec_col: str, ctx_col: str, segment: str | None = None, p_val: float = 0.05, permutations: int = 100, seed: int = 0, flag: str = "is_ref") -> DataFrame:
    """A report per segment; each is one task."""
    held = pairs.select(*([segment] if segment else []), F.col(vec_col).cast("array<double>").alias("x"), F.col(ctx_col).cast("array<double>").alias("c"), (1 - F.col(flag)).alias("t"))

    def run(pdf: pd.DataFrame) -> dict:
        pdf = pdf.assign(o=pdf["x"].map(tuple)).sort_values(["t", "o"], kind="stable")
        out = context_mmd(np.stack(pdf["x"]), np.stack(pdf["c"]), pdf["t"].to_numpy(), p_val, permutations, seed=seed)
        return {k: v for k, v in out.items() if not k.startswith("coupling")}

    return kernels.one_segment(held, segment, run, "is_drift int, distance double, p_val double, threshold double, distance_threshold double")
