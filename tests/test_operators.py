"""Behaviour of the monitoring operators on seeded tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlane import detectors as D
from driftlane.functions import columns as C
from driftlane.operators import adversarial, categorical, inject, kernels, learned, mixture, neighbours, networks, projection, recon, thresholds, timeseries, univariate
from driftlane.sources import readers, spec

RNG = np.random.default_rng(0)


def wide(spark, x, **extra):
    cols = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))


def arrays(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


@pytest.fixture(scope="module")
def normal(spark):
    return wide(spark, RNG.normal(size=(500, 3)))


# -- drift ---------------------------------------------------------------------


@pytest.mark.parametrize("test", [D.KSDrift, D.CVMDrift])
def test_copies_and_shifts(spark, normal, test):
    det = test(normal, ("f0", "f1", "f2"))
    assert det.predict(normal).first().is_drift == 0
    moved = normal.withColumn("f1", F.col("f1") * 5 + 5)
    assert det.predict(moved).first().is_drift == 1
    by = {r.feature: r.is_drift for r in det.predict(moved, "feature").collect()}
    assert by == {"f0": 0, "f1": 1, "f2": 0}
    assert det.predict(normal).first().threshold == pytest.approx(0.05 / 3)


@pytest.mark.parametrize(("shift", "alternative", "drift"), [(5, "two-sided", 1), (5, "greater", 1), (5, "less", 0), (-5, "greater", 0), (-5, "less", 1)])
def test_ks_sides(normal, shift, alternative, drift):
    moved = normal.withColumn("f0", F.col("f0") + shift)
    assert D.KSDrift(normal, ("f0",), alternative=alternative).predict(moved).first().is_drift == drift


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(spark, normal, parts):
    moved = normal.withColumn("f0", F.round(F.col("f0") + 0.2, 1))
    want = sorted(univariate.ks_statistic(univariate.pair(normal, moved, ["f0", "f1"]), ["f0", "f1"]).collect())
    got = sorted(univariate.ks_statistic(univariate.pair(normal.repartition(parts), moved.repartition(parts), ["f0", "f1"]), ["f0", "f1"]).collect())
    assert got == want


def test_statistics_by_brute_force(spark):
    a, b = np.round(RNG.normal(size=180), 1), np.round(RNG.normal(0.3, 1, size=130), 1)
    pair = univariate.pair(wide(spark, a[:, None]), wide(spark, b[:, None]), ["f0"])
    at = np.unique(np.concatenate([a, b]))
    gap = np.array([(a <= v).mean() - (b <= v).mean() for v in at])
    assert univariate.ks_statistic(pair, ["f0"]).first().distance == pytest.approx(np.abs(gap).max())
    pooled = np.concatenate([np.sort(a), np.sort(b)])
    rank = np.array([(pooled < v).sum() + ((pooled == v).sum() + 1) / 2 for v in pooled])
    n, m = len(a), len(b)
    u = n * ((rank[:n] - np.arange(1, n + 1)) ** 2).sum() + m * ((rank[n:] - np.arange(1, m + 1)) ** 2).sum()
    assert univariate.cvm_statistic(pair, ["f0"]).first().distance == pytest.approx(u / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m)))


def test_empty_and_null_samples(spark, normal):
    pair = univariate.pair(normal, normal.where("false"), ["f0"])
    assert univariate.ks(pair, ["f0"]).first().p_val is None
    nulls = normal.withColumn("f0", F.when(F.col("id") % 2 == 0, F.col("f0")))
    assert univariate.ks_statistic(univariate.pair(normal, nulls, ["f0"]), ["f0"]).first().n_test == 250
    assert univariate.ks_statistic(pair.where("false"), ["f0"]).collect() == []


def test_chi2_domain_and_new_category(spark):
    codes = np.tile(np.arange(5), (6, 20)).T
    ref = wide(spark, codes)
    det = D.ChiSquareDrift(ref, tuple(f"f{i}" for i in range(6)))
    assert det.predict(ref).first().is_drift == 0
    assert det.predict(ref.withColumn("f0", F.col("f0") + 1)).first().is_drift == 1
    mixed = D.TabularDrift(ref, ("f0", "f1"), categories={"f1": None})
    assert {r.feature: r.test for r in mixed.score(ref).collect()} == {"f0": "ks", "f1": "chi2"}


def test_fet(spark):
    ref, test = (RNG.uniform(size=(500, 2)) < 0.5).astype(int), (RNG.uniform(size=(200, 2)) < 0.8).astype(int)
    out = {r.feature: r for r in univariate.fet_statistic(univariate.pair(wide(spark, ref), wide(spark, test), ["f0", "f1"]), ["f0", "f1"]).collect()}
    for i in range(2):
        a, b = test[:, i].sum(), ref[:, i].sum()
        assert out[f"f{i}"].distance == pytest.approx(a * (500 - b) / (b * (200 - a)), rel=1e-9) and out[f"f{i}"].p_val < 0.01
    with pytest.raises(Exception, match="values must be"):
        univariate.fet_table(univariate.pair(wide(spark, ref * 2), wide(spark, test), ["f0"]), ["f0"]).collect()


def test_reference_updates(spark, normal):
    det = D.KSDrift(normal, ("f0",), update={"last": 100}, key=("id",))
    later = normal.withColumn("id", F.col("id") + 1000)
    new = det.updated(later)
    assert new.n == 1000 and sorted(r.id for r in new.ref.collect()) == list(range(1400, 1500))
    pool = D.KSDrift(normal, ("f0",), update={"reservoir": 300}, key=("id",)).updated(later)
    assert pool.ref.count() == 300 and 90 < pool.ref.where("id >= 1000").count() < 210


@pytest.fixture(scope="module")
def vec_pair(spark):
    x = RNG.normal(size=(150, 5))
    return arrays(spark, x), arrays(spark, RNG.normal(size=(120, 5)), 1000), arrays(spark, RNG.normal(1.0, 1, size=(120, 5)), 1000)


def test_mmd(spark, vec_pair):
    ref, same, moved = vec_pair
    assert D.MMDDrift(ref, n_permutations=50).predict(same)["is_drift"] == 0
    out = D.MMDDrift(ref, n_permutations=50).predict(moved)
    assert out["is_drift"] == 1 and out["distance"] > out["distance_threshold"] and (out["p_val"] * 50) % 1 == 0
    kernel = kernels.GaussianRBF((1.5,))
    whole = kernels.tile_sums(kernels.numbered(ref, moved), kernel, 3, 1)
    tiled = kernels.tile_sums(kernels.numbered(ref, moved, size=40), kernel, 3, 1)
    assert tiled[0] == pytest.approx(whole[0]) and tiled.sum(1) + tiled[:, 2] == pytest.approx([whole[0].sum() + whole[0, 2]] * 4)
    marks = [kernels.tile_labels(t, 150, 120, kernels.tile_shares(150, 120, 5, 0, 40)[t], 0, 40) for t in range(7)]
    assert np.concatenate(marks).sum(0).tolist() == [120] * 6 and np.concatenate(marks)[:150, 0].sum() == 0
    x, y = (np.array([r.features for r in d.orderBy("id").collect()]) for d in (ref, moved))
    kx, ky, kxy = kernel(x, x), kernel(y, y), kernel(x, y)
    n, m = len(x), len(y)
    want = (kx.sum() - n) / (n * (n - 1)) + (ky.sum() - m) / (m * (m - 1)) - 2 * kxy.mean()
    assert kernels.mmd2(whole, n, m)[0] == pytest.approx(want)


def test_median_bandwidth_of_all_pairs_in_tiles(vec_pair):
    ref, _, moved = vec_pair
    x = np.array([r.features for r in ref.unionByName(moved).collect()])
    d = np.sort(((x[:, None] - x[None]) ** 2).sum(2)[np.triu_indices(len(x), 1)])
    n = len(x)
    want = np.sqrt(d[((n * n - n) // 2 - 1) // 2] / 2)
    assert kernels.sigma_median(ref, moved).first().sigma == pytest.approx(want)
    assert kernels.sigma_median(ref, moved, local=20, size=64).first().sigma == pytest.approx(want)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(kernels, "FEW", 3)
        m.setattr(kernels, "BINS", 8)
        assert kernels.sigma_median(ref, moved, local=20, size=64).first().sigma == pytest.approx(want)
        same = ref.withColumn("features", F.array(F.lit(1.0), F.lit(2.0))).withColumn("id", F.col("id"))
        assert kernels.sigma_median(same.union(ref.limit(1).withColumn("features", F.array(F.lit(4.0), F.lit(6.0)))), local=20, size=64).first().sigma == pytest.approx(np.sqrt(1e-30 / 2))


def test_lsdd_centres_are_bounded(vec_pair):
    with pytest.raises(ValueError, match="centres"):
        kernels.lsdd(vec_pair[0], vec_pair[1], centres=kernels.MAX_CENTRES + 1)


def test_lsdd(vec_pair):
    ref, same, moved = vec_pair
    assert D.LSDDDrift(ref, n_permutations=40).predict(same)["is_drift"] == 0
    assert D.LSDDDrift(ref, n_permutations=40).predict(moved)["is_drift"] == 1


def test_learned_kernel_and_spot_the_diff(vec_pair):
    ref, same, moved = vec_pair
    assert D.LearnedKernelDrift(ref, n_permutations=40).predict(moved)["is_drift"] == 1
    out = D.SpotTheDiffDrift(ref).predict(moved)
    assert out["is_drift"] == 1 and out["diffs"].shape == (1, 5)
    assert D.SpotTheDiffDrift(ref).predict(same)["is_drift"] == 0


def test_context(spark):
    rng = np.random.default_rng(1)

    def rows(n, mean, extra=0.0):
        c = rng.normal(mean, 1, size=(n, 1))
        return [(x.tolist(), k.tolist()) for x, k in zip(c + rng.normal(extra, 0.5, size=(n, 1)), c)]

    schema = "features array<double>, context array<double>"
    ref = spark.createDataFrame(rows(200, 0), schema)
    det = D.ContextMMDDrift(ref, n_permutations=60)
    assert det.predict(spark.createDataFrame(rows(120, 0.7), schema)).first().is_drift == 0  # the context explains it
    assert det.predict(spark.createDataFrame(rows(120, 0, 1.5), schema)).first().is_drift == 1


def test_classifier_drift(spark):
    ref = wide(spark, RNG.normal(size=(600, 4)))
    f = [f"f{i}" for i in range(4)]
    same, moved = wide(spark, RNG.normal(size=(400, 4))), wide(spark, RNG.normal(1, 1, size=(400, 4)))
    low, high = (D.ClassifierDrift(ref, f, "id", n_folds=2).predict(t).first() for t in (same, moved))
    assert high.distance > low.distance and high.is_drift == 1
    assert D.ClassifierDrift(ref, f, "id", binarize_preds=True, n_folds=None).predict(moved).first().is_drift == 1
    probs = learned.out_of_fold(ref, same, f, "id", n_folds=3)
    assert probs.count() == 1000 and probs.select("fold").distinct().count() == 3


def test_uncertainty(spark):
    def table(scale):
        z = np.exp(RNG.normal(size=(300, 3)) * scale)
        return spark.createDataFrame([(p.tolist(),) for p in z / z.sum(1, keepdims=True)], "probs array<double>")

    ref = table(1.0)
    assert D.ClassifierUncertaintyDrift(ref).predict(table(1.0)).first().is_drift == 0
    assert D.ClassifierUncertaintyDrift(ref).predict(table(5.0)).first().is_drift == 1
    one = spark.createDataFrame([([0.5, 0.5, 0.0], [1.0, 3.0])], "p array<double>, e array<double>")
    r = one.select(C.entropy("p").alias("h"), C.margin("p").alias("m"), learned.regressor_uncertainty("e").alias("s")).first()
    assert (r.h, r.m, r.s) == (pytest.approx(np.log(2)), 1, 1.0)


def test_permutation_test():
    x = RNG.normal(size=(100, 2))
    metric = lambda a, b: float(np.abs(a.mean(0) - b.mean(0)).sum())
    p, d = kernels.permutation_test(x, x * 5 + 3, metric, 20)
    assert p == 0 and d > 1
    assert kernels.permutation_test(x, x, metric, 20)[0] == 1


# -- outliers ------------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    x = RNG.normal(size=(300, 2))
    return arrays(spark, x), arrays(spark, np.array([[0, 10.0], [0.1, 0.0]]), 5000), x


@pytest.mark.parametrize("det", [D.KNN(k=10), D.KNN(k=(3, 10)), D.LOF(k=10), D.Mahalanobis(), D.GMM(n_components=1), D.IForest(n_estimators=50), D.OutlierAE(latent=1, epochs=10), D.OutlierAEGMM(latent=1, epochs=10)])
def test_far_points_score_higher(blobs, det):
    ref, queries, _ = blobs
    det = det.fit(ref)
    s = {r.id: r.score for r in det.score(queries).collect()}
    assert s[5000] > s[5001]


@pytest.mark.parametrize("det", [D.KNN(k=5), D.Mahalanobis(), D.IForest(n_estimators=30)])
def test_thresholds_hold_their_rate(blobs, det):
    ref, queries, x = blobs
    det = det.fit(ref)
    assert det.predict(queries).first().is_outlier is None
    with pytest.raises(D.NoThreshold):
        det.outliers(queries)
    det = det.infer_threshold(ref, 0.1)
    out = det.predict(ref)
    assert out.agg(F.avg("is_outlier")).first()[0] == pytest.approx(0.1, abs=0.02)
    far = {r.id: (r.is_outlier, r.p_value) for r in det.predict(queries).collect()}
    assert far[5000][0] == 1 and far[5000][1] <= 0.1 and far[5001][0] == 0
    assert isinstance(det, D.IForest) or far[5000][1] == pytest.approx(1 / 300)
    with pytest.raises(ValueError):
        det.infer_threshold(ref, 0.001)


def test_unfitted():
    with pytest.raises(D.NotFitted):
        D.KNN().score(None)


def test_neighbours_far_from_the_origin_and_among_equal_rows(spark):
    x = np.array([[1e8 + i * 1e-3] for i in range(200)])
    ref = arrays(spark, x, 0)
    got = sorted((r["rank"], r.neighbour, r.distance) for r in neighbours.neighbours(arrays(spark, x[50:51], 900), ref, 5).collect())
    d = np.abs(x - x[50])[:, 0]
    want = np.lexsort((np.arange(200), d))[:5]
    assert [(j, v) for _, j, v in got] == [(int(j), float(d[j])) for j in want]
    assert kernels.GaussianRBF((1e-3,))(x[:50], x[:50]) == pytest.approx(np.exp(-((x[:50] - x[:50].T) ** 2) / 2e-6))
    same = arrays(spark, np.ones((3000, 4)), 0)
    for block in (4096, 700):
        rows = neighbours.neighbours(arrays(spark, np.zeros((3, 4)), 9000), same, 5, block=block).collect()
        assert {(r.id, r["rank"], r.neighbour) for r in rows} == {(9000 + q, k + 1, k) for q in range(3) for k in range(5)}
    own = neighbours.neighbours(same.where("id < 40"), same, 3, skip_self=True).where("id in (0, 7)").collect()
    assert sorted((r.id, r.neighbour) for r in own) == [(0, 1), (0, 2), (0, 3), (7, 0), (7, 1), (7, 2)]


def test_neighbours_by_brute_force(spark, blobs):
    ref, _, x = blobs
    y = RNG.normal(size=(40, 2))
    q = arrays(spark, y, 9000)
    d = np.sqrt(((y[:, None] - x[None]) ** 2).sum(2))
    for block in (4096, 50):
        got = {(r.id - 9000, r.rank): (r.neighbour, r.distance) for r in neighbours.neighbours(q, ref, 3, block=block).collect()}
        for i in range(40):
            for k, j in enumerate(np.argsort(d[i], kind="stable")[:3]):
                assert got[i, k + 1] == (j, pytest.approx(d[i, j]))


def test_lof_marks_scaled_row(spark):
    x = RNG.normal(size=(300, 10))
    q = RNG.normal(size=(3, 10))
    q[2] *= 100
    s = [r.score for r in neighbours.lof_scores(arrays(spark, q, 1000), arrays(spark, x), 10).orderBy("id").collect()]
    assert s[2] > 10 * max(s[:2])


def test_whitening_and_pca(spark, blobs):
    ref, _, x = blobs
    got = np.array([r.score for r in projection.mahalanobis(ref, ref, "features").orderBy("id").collect()])
    c = x - x.mean(0)
    assert got == pytest.approx(np.einsum("ni,ij,nj->n", c, np.linalg.inv(np.cov(x.T)), c))
    res = np.array([r.score for r in projection.pca(ref, ref, "features", 1).orderBy("id").collect()])
    top = np.linalg.eigh(np.cov(x.T))[1][:, 1]
    assert res == pytest.approx((c**2).sum(1) - (c @ top) ** 2)


def test_kernel_pca_and_svm_on_moons(spark):
    t = RNG.uniform(0, np.pi, 400)
    moons = np.concatenate([np.c_[np.cos(t[:200]), np.sin(t[:200])], np.c_[1 - np.cos(t[200:]), 0.5 - np.sin(t[200:])]]) + RNG.normal(size=(400, 2)) * 0.05
    q = arrays(spark, np.array([[0.0, -3.0], moons[0]]), 1000)
    for out in (projection.kernel_pca(q, arrays(spark, moons), "features", 10, kernels.GaussianRBF((0.4,))), mixture.svm(q, arrays(spark, moons), "features", 0.1, 40)):
        s = [r.score for r in out.orderBy("id").collect()]
        assert s[0] > s[1]


def test_ensembles(spark):
    val, q = RNG.normal(size=(64, 10)), RNG.normal(size=(3, 10))
    v, d = (spark.createDataFrame([(r.tolist(),) for r in m], "s array<double>") for m in (val, q))
    got = np.array([r.p for r in d.select(thresholds.p_value_normaliser(v, "s")("s").alias("p")).collect()])
    assert got == pytest.approx(1 - (1 + (val[None] > q[:, None]).sum(1)) / 65)
    z = np.array([r.z for r in d.select(thresholds.shift_scale_normaliser(v, "s")("s").alias("z")).collect()])
    assert z == pytest.approx((q - val.mean(0)) / val.std(0, ddof=1))
    top = [r.t for r in d.select(thresholds.top_k_mean("s").alias("t")).collect()]
    assert top == pytest.approx(np.sort(q, 1)[:, -5:].mean(1))
    with pytest.raises(ValueError):
        thresholds.average("s", [0.5, 0.4])


# -- series --------------------------------------------------------------------


def test_padding():
    for _ in range(100):
        n, w = RNG.integers(30, 90), int(RNG.integers(2, 25))
        x = RNG.normal(size=n)
        for method in ("constant", "replicate", "reflect"):
            for side in ("bilateral", "left", "right"):
                p = timeseries.pad_same(x, w, method, side)
                assert len(p) == n + w - 1 and len(np.convolve(p, np.ones(w), "valid")) == n
    assert timeseries.pad_same(np.array([1.0, 2, 3]), 4, "constant").tolist() == [0, 0, 1, 2, 3, 0]


def test_spectral_residual(spark):
    t = np.linspace(0, 0.5, 1000)
    x = np.sin(80 * np.pi * t) + 0.5 * np.sin(180 * np.pi * t)
    bad = RNG.choice(np.arange(50, 950), 10, replace=False)
    y = x.copy()
    y[bad] = 10
    det = D.SpectralResidual(threshold=6.0)
    df = spark.createDataFrame([(s, float(a), float(v)) for s, z in (("clean", x), ("bad", y)) for a, v in zip(t, z)], "s string, t double, v double")
    n = {r.series: r.n for r in det.predict(df, "v", "t", "s").groupBy("series").agg(F.sum("is_outlier").alias("n")).collect()}
    assert n["clean"] <= 2 and n["bad"] >= 8


def test_forecasts(spark):
    days = np.arange(200.0)
    y = 3 + 0.1 * days + np.sin(2 * np.pi * days / 7) + RNG.normal(size=200) * 0.1
    rows = [("a", float(d), float(v), 100.0) for d, v in zip(days, y)]
    df = spark.createDataFrame(rows, "series string, ds double, y double, cap double")
    out = timeseries.seasonal_forecast(df.where("ds < 150"), df.where("ds >= 150"))
    assert out.agg(F.max(F.abs(F.col("y") - F.col("yhat")))).first()[0] < 1
    odd = df.where("ds >= 150").withColumn("y", F.when(F.col("ds") == 170, 50.0).otherwise(F.col("y")))
    assert timeseries.seasonal_forecast(df.where("ds < 150"), odd).where("ds = 170").first().score > 10
    assert timeseries.seasonal_forecast(df.where("ds < 150"), df.where("ds >= 150"), growth="logistic").agg(F.max("yhat")).first()[0] < 100
    errors = timeseries.forecast_errors(df, "y", "ds", "series", 7)
    assert errors.where("error is not null").count() == 193
    seq = D.OutlierSeq2Seq(7).infer_threshold(df, "y", "ds", "series", 90)
    assert seq.predict(df, "y", "ds", "series").agg(F.sum("is_outlier")).first()[0] == pytest.approx(20, abs=3)


# -- data ----------------------------------------------------------------------


def test_category_distances_by_brute_force(spark):
    rows = [("abcd"[int(a)], "xyz"[int(b)] if a != 3 else "w", int(y)) for a, b, y in RNG.integers(0, 3, size=(200, 3))] + [("e", "only", 9), (None, "x", 1)]
    df = spark.createDataFrame(rows, "c string, o string, y int")
    rows = rows[:-1]
    share = lambda col, v, c: sum(r[0] == c and r[col] == v for r in rows) / sum(r[0] == c for r in rows)
    for got, cols, term in ((categorical.abdm(df, "c", ["o", "y"]), (1, 2), lambda p, q: (p - q) * np.log((p + 1e-12) / (q + 1e-12))), (categorical.mvdm(df, "c", "y", 2.0), (2,), lambda p, q: abs(p - q) ** 2)):
        m = {(r.a, r.b): r.distance for r in got.collect()}
        cats = {r[0] for r in rows}
        assert set(m) == {(a, b) for a in cats for b in cats}
        for a, b in m:
            assert m[a, b] == pytest.approx(sum(term(share(c, v, a), share(c, v, b)) for c in cols for v in {r[c] for r in rows}), abs=1e-9)
    with pytest.raises(ValueError, match="categories"):
        categorical.abdm(df, "c", ["o"], limit=2)


def test_calibration_set_is_bounded(spark):
    v = spark.createDataFrame([([float(i)],) for i in range(20)], "s array<double>")
    with pytest.raises(ValueError, match="calibration"):
        thresholds.p_value_normaliser(v, "s", limit=19)


def test_encodings(spark):
    df = spark.createDataFrame([(0, 0.35), (2, -1.0)], "c int, v double")
    r = df.select(categorical.ord2ohe("c", 3).alias("o"), categorical.ord2num("c", {0: 0.5, 2: 0.7}).alias("n"), categorical.num2ord("v", {0: 0.3, 1: 0.5, 2: -0.9}).alias("k")).collect()
    assert [list(x.o) for x in r] == [[1, 0, 0], [0, 0, 1]] and [x.n for x in r] == [0.5, 0.7] and [x.k for x in r] == [0, 2]
    bad = spark.createDataFrame([(1, 1)], "a int, b int")
    with pytest.raises(Exception, match="one-hot"):
        bad.select(categorical.ohe2ord(["a", "b"])).collect()


def test_discretiser(spark, normal):
    edges = categorical.bin_edges(normal, ["f0"], [10 * i for i in range(1, 10)])
    got = categorical.discretise(normal, edges).agg(F.min("f0"), F.max("f0")).first()
    assert tuple(got) == (0, 9)
    on = spark.createDataFrame([(edges["f0"][0],)], "f0 double")
    assert categorical.discretise(on, edges).first().f0 == 0
    assert categorical.bin_labels("f", [1.0, 2.0]) == ["f <= 1.00", "1.00 < f <= 2.00", "f > 2.00"]


def test_category_distances(spark):
    rows = [(int(a), int(b), int(y)) for a, b, y in RNG.integers(0, 3, size=(300, 3))]
    df = spark.createDataFrame(rows, "c int, o int, y int")
    for d in (categorical.mvdm(df, "c", "y"), categorical.abdm(df, "c", ["o", "y"])):
        m = {(r.a, r.b): r.distance for r in d.collect()}
        assert len(m) == 9 and all(m[a, b] == pytest.approx(m[b, a]) and m[a, a] == pytest.approx(0) for a, b in m)
        scaled = categorical.multidimensional_scaling(d)
        assert len(scaled) == 3 and min(scaled.values()) == pytest.approx(0)
    assert np.std(list(categorical.scale_numbers({"a": 1.0, "b": 2.0, "c": 5.0}, std=3.0).values())) == pytest.approx(3)


def test_pick_takes_the_least_hashes(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.lit("x").alias("b"), F.lit(1).alias("o"))
    order = [r.k for r in df.orderBy(inject.uniform(5, "k"), "k").collect()]
    for n in (0, 1, 17, 2999, 3000, 5000):
        out = inject.pick(df, n, "k", 5)
        assert out.columns == ["k", "b", "o", "picked"]
        assert {r.k for r in out.where("picked = 1").collect()} == set(order[:n])
    two = inject.outlier_batch(df.withColumn("y", (F.col("k") % 10 == 0).cast("int")), "y", 3600, 25, "k", 1).groupBy("k", "y").count().collect()
    assert sum(r["count"] for r in two if r.y) == 900 and sum(r["count"] for r in two if not r.y) == 2700 and {r["count"] for r in two if r.y} == {3}


def test_pick_splits_rows_that_share_a_key(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else i // 7, i % 3, {"i": 1}) for i in range(70)], "k long, x long, m map<string,int>")
    for n in (0, 1, 5, 23, 36, 69, 70, 90):
        out = [inject.pick(d, n, "k", 5).groupBy("k", "x").agg(F.sum("picked").alias("s"), F.count("m").alias("c")).collect() for d in (df, df.repartition(7))]
        assert sum(r.s for r in out[0]) == min(n, 70) and sum(r.c for r in out[0]) == 70
        assert {tuple(r) for r in out[0]} == {tuple(r) for r in out[1]}


@pytest.mark.parametrize("percent", [0, 10, 20])
def test_injection(spark, normal, percent):
    out = inject.inject_tabular(normal.withColumn("was", F.col("f0")), ["f0"], percent, 3, 1, "id", 1)
    n, moved = out.agg(F.sum("is_outlier"), F.sum((F.col("f0") != F.col("was")).cast("int"))).first()
    assert n == moved == 5 * percent
    ts = inject.inject_ts(normal.withColumn("was", F.col("f0")).withColumn("s", F.lit(1)), "f0", "id", percent, 3, 1, "s", seed=2)
    assert ts.agg(F.sum("is_outlier")).first()[0] == 5 * percent
    again = inject.inject_tabular(normal.repartition(5).withColumn("was", F.col("f0")), ["f0"], percent, 3, 1, "id", 1)
    assert sorted(r.f0 for r in again.collect()) == sorted(r.f0 for r in out.collect())


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "id long, target int")
    for n, p in ((50, 10), (100, 50), (120, 50)):
        out = inject.outlier_batch(df, "target", n, p, "id")
        assert out.count() == n and out.agg(F.sum("target")).first()[0] == n * p // 100
    m = df.select("target", inject.mutate("target", 0.5, 3, "id").alias("m"))
    assert m.where("m between 0 and 3").count() == 100 and 25 < m.where("m <> target").count() < 75


@pytest.mark.parametrize("kind", inject.CORRUPTIONS)
def test_corruptions(kind):
    strength = {"shot_noise": 20, "zoom_blur": 0.1, "contrast": 0.4, "brightness": 0.2, "saturate": 0.3, "pixelate": 0.5, "defocus_blur": 3, "elastic": 2.0, "jpeg": 40.0}.get(kind, 0.5)
    x = np.random.default_rng(0).uniform(0, 255, (20, 24, 3))
    y = inject.corrupt_image(x, kind, strength, np.random.default_rng(1))
    assert y.shape == x.shape and y.min() >= 0 and y.max() <= 255 and np.abs(y - x).max() > 0.1
    with pytest.raises(ValueError):
        inject.corrupt_image(x, "rain", 1, np.random.default_rng(1))


def test_masks():
    x = np.full((20, 20, 3), 100.0)
    y = inject.mask_image(x, (2, 2), 1, "zero", 0, np.random.default_rng(0))
    assert (y == 0).sum() == 12 and (x == 100).all()


def test_colours_round_trip():
    x = np.random.default_rng(0).uniform(size=(5, 6, 3))
    assert inject._rgb(inject._hsv(x)) == pytest.approx(x)


def test_likelihood_ratio(spark):
    normal = spark.createDataFrame([(i, "ababab") for i in range(50)], "doc_id long, text string")
    odd = spark.createDataFrame([(1, "ababab"), (2, "aaaaaa"), (3, "a"), (4, None)], "doc_id long, text string")
    mixed = normal.unionByName(spark.createDataFrame([(99, "aaaaaaaaaaaaabbbbbbbbbbba")], "doc_id long, text string"))
    s = {r.doc_id: r.score for r in D.LLR().fit(normal, mixed).score(odd).collect()}
    assert s[2] > s[1] and set(s) == {1, 2}


def test_autoencoder_reconstruction(spark, blobs):
    ref, _, x = blobs
    got = np.array([r.recon for r in recon.pca_reconstruction(ref, ref, "features", 2).orderBy("id").collect()])
    assert got == pytest.approx(x)


# -- sources -------------------------------------------------------------------


def test_readers(spark, tmp_path):
    (tmp_path / "kdd.csv").write_text("\n".join(",".join(["0", "tcp", "http", "SF", *["1"] * 37, t]) for t in ("normal.", "smurf.", "spy.", "odd.")))
    rows = readers.read_kdd(spark, str(tmp_path / "kdd.csv"), ["dos"]).collect()
    assert sorted((r.category, r.target) for r in rows) == [("dos", 1), ("normal", 0)]
    (tmp_path / "e.arff").write_text("% note\n@relation x\n@attribute a real\n@data\n\n1.5, ?, 'n'\n2,3,1\n")
    rows = readers.read_arff(spark, str(tmp_path / "e.arff")).collect()
    assert [(r.features, r.label) for r in rows] == [([1.5, None], "n"), ([2.0, 3.0], "1")]
    np.save(tmp_path / "c.npy", np.arange(24).reshape(6, 2, 2))
    rows = readers.severity_slice(readers.read_npy(spark, str(tmp_path / "c.npy")), 2, 2).orderBy("row").collect()
    assert [r.values for r in rows] == [[8, 9, 10, 11], [12, 13, 14, 15]] and list(rows[0].shape) == [2, 2]
    np.savez(tmp_path / "g.npz", x_test=np.ones((3, 4)), x_test_ood=np.zeros((2, 4)))
    rows = readers.read_sequences(spark, str(tmp_path / "g.npz"), {"test": ("x_test", "x_test_ood")}).collect()
    assert sum(r.is_outlier for r in rows) == 2 and len(rows) == 5
    (tmp_path / "s.csv").write_text("timestamp,value\n2020-01-01 00:00:00,1\n2020-01-01 01:00:00,2\n")
    (tmp_path / "l.json").write_text(json.dumps({"s": ["2020-01-01 01:00:00"]}))
    rows = readers.read_labelled_series(spark, str(tmp_path / "s.csv"), str(tmp_path / "l.json"), "s").orderBy("ts").collect()
    assert [r.is_outlier for r in rows] == [0, 1]
    (tmp_path / "b.xml").write_text("<a><Key>m/x.npy</Key><Key>m/y.txt</Key><Key>n/z.npy</Key></a>")
    assert [r.key for r in readers.list_bucket(spark, str(tmp_path / "b.xml"), "m/", ".npy").collect()] == ["m/x.npy"]
    assert readers.join_url("http://h/", ["a/", "/b"]) == "http://h/a/b"


def test_specs(spark, normal, tmp_path):
    path = str(tmp_path / "det")
    s = spec.Spec("KSDrift", {"features": ["f0", "f1"], "alternative": "less"})
    spec.save(s, normal, path)
    loaded, ref = spec.load(spark, path, D.KNOWN)
    det = D.from_spec(loaded, ref)
    assert det.alternative == "less" and det.predict(normal).first().is_drift == 0
    with pytest.raises(FileExistsError):
        spec.save(s, normal, path)
    with pytest.raises(ValueError):
        spec.Spec("KSDrift", {"nonsense": 1}).check(D.KNOWN)
    with pytest.raises(ValueError):
        spec.Spec("Nothing").check(D.KNOWN)


# -- before a detector ---------------------------------------------------------


def test_models(spark):
    from driftlane.operators import preprocess

    model = preprocess.untrained_encoder(10, 4)
    assert [w.shape for w, _ in model.params] == [(10, 8), (8, 6), (6, 4)] and len(model.hidden().params) == 2
    x = RNG.normal(size=(5, 10))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9, None)], "id long, v array<double>")
    got = {r.id: r.encoded for r in preprocess.apply_model(df, model, "v").collect()}
    assert got[9] is None and np.allclose([got[i] for i in range(5)], model(x))
    a, b = ({r.id: r.evaluations for r in preprocess.dropout_evaluations(d, model, "v", 7).collect()} for d in (df, df.repartition(3)))
    assert a == b and len(a[0]) == 7 and len(set(a[0])) > 1 and a[9] is None
    scaled = np.array([r.s for r in df.where("id < 9").select(preprocess.scale_by_instance("v").alias("s")).orderBy("id").collect()])
    assert np.allclose(scaled.mean(1), 0) and np.allclose(scaled.std(1), 1)


def test_category_numbers(spark):
    rows = [(a, b) for a, b in zip("aabbccaab", "xyxyxyxxy")]
    df = spark.createDataFrame(rows, "c string, o string").withColumn("y", (F.col("c") == "a").cast("int"))
    for method in ("abdm", "mvdm", "abdm-mvdm"):
        numbers = categorical.fit_categories(df, ["c", "o"], method, "y", std=2.0)
        assert set(numbers["c"]) == {"a", "b", "c"} and np.std(list(numbers["c"].values())) == pytest.approx(2)
    coded = categorical.encode_categories(df, numbers)
    assert dict(coded.dtypes)["c"] == "double" and coded.where("c is null").count() == 0
    assert {r.category for r in categorical.farthest_categories(categorical.mvdm(df, "c", "y")).collect()} == {"a", "b", "c"}


def test_array_functions(spark):
    r = spark.createDataFrame([([0.5, 0.5], [1.0, 0.0], [], [0.0, 0.0])], "p array<double>, q array<double>, e array<double>, z array<double>")
    got = r.select(C.kl("p", "q").alias("k"), C.kl("q", "p").alias("l"), C.cross_entropy("p", "q").alias("x"), C.mean("e").alias("m"), C.cosine("p", "z").alias("c"), C.softmax("z").alias("s"), C.sharpen("q", 0.5).alias("t")).first()
    assert got.k == float("inf") and got.l == pytest.approx(np.log(2)) and got.x == float("inf") and got.m is None and got.c is None
    assert list(got.s) == [0.5, 0.5] and list(got.t) == [1.0, 0.0]


def test_segments(spark, normal):
    df = univariate.pair(normal.withColumn("s", F.when(F.col("id") % 3 > 0, F.col("id") % 3)), normal.withColumn("s", F.when(F.col("id") % 3 > 0, F.col("id") % 3)).withColumn("f0", F.when(F.col("s") == 1, F.col("f0") + 3).otherwise(F.col("f0"))), ["s", "f0", "f1"])
    got = {(r.segment, r.feature): r.distance for r in univariate.by_segment(df, "s", ["f0", "f1"]).collect()}
    assert set(got) == {(s, f) for s in ("1", "2", None) for f in ("f0", "f1")}
    assert got["1", "f0"] > 0.5 and got["2", "f0"] == got[None, "f0"] == got["1", "f1"] == 0
    assert univariate.by_segment(df, "s", ["f0"], univariate.cvm_statistic).count() == 3


def test_adversarial_detectors(spark):
    rows = [([0.9, 0.1], [0.8, 0.2])] * 99 + [([0.9, 0.1], [0.1, 0.9])]
    df = spark.createDataFrame(rows, "probs array<double>, recon_probs array<double>")
    for det in (D.AdversarialAE(temperature=0.5), D.ModelDistillation(loss_type="xent")):
        with pytest.raises(D.NoThreshold):
            det.predict(df)
        det = det.infer_threshold(df, 95, 0.1)
        assert det.predict(df).agg(F.sum("is_adversarial")).first()[0] == 1
        bad = det.correct(df).where("is_adversarial = 1").first()
        assert (bad.no_defense, bad.defense, bad.corrected) == (0, 1, 1)


# -- networks ------------------------------------------------------------------


def _numeric(value, params, grads, eps=1e-6):
    """Largest gap between gradients and differences of a loss."""
    worst = 0.0
    for p, g in zip(params, grads):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 5)]:
            keep = p[at]
            p[at] = keep + eps
            up = value()
            p[at] = keep - eps
            down = value()
            p[at] = keep
            worst = max(worst, abs((up - down) / (2 * eps) - g[at]))
    return worst


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 4))
    for sigma in (None, 0.7):
        auto = networks.Autoencoder.make(x, 5, 2, sigma, 0.5)
        z, at = auto.scaled(x), lambda: np.random.default_rng(3)
        assert _numeric(lambda: auto.loss(z, at())[0], auto.params, auto.loss(z, at())[1]) < 1e-5

    def differences(run, plain=lambda params: None):
        """Gradients that a training sees against differences of its first loss."""
        seen = {}

        def at(k=0, place=None, eps=0.0):
            def optimiser(params, rate):
                plain(params)
                if place is not None:
                    params[k][place] += eps
                seen.update(params=params)
                return type("Steps", (), {"step": lambda _, grads: seen.update(grads=[g.copy() for g in grads])})()

            return run(optimiser)[0]

        at()
        grads, shapes, worst = seen["grads"], [p.shape for p in seen["params"]], 0.0
        for k, shape in enumerate(shapes):
            for place in list(np.ndindex(shape))[::3]:
                worst = max(worst, abs((at(k, place, 1e-6) - at(k, place, -1e-6)) / 2e-6 - grads[k][place]))
        return worst

    model, seqs = networks.Network.make([4, 6, 3], 2), rng.normal(size=(6, 5))
    assert differences(lambda o: networks.defender(x, model, 5, 2, w_recon=0.3, temperature=0.7, epochs=1, batch=99, optimiser=o).losses) < 1e-5
    target = np.where(np.arange(5) == 4, np.nan, np.roll(seqs, -1, 1))

    def no_estimates(params):  # their gradient isn't that of the loss that is told
        params[3][:, 1], params[4][1] = 0.0, 0.0

    def recurrent(o):
        net = networks.Recurrent.make(4)
        return net.fit(seqs, target, 1, batch=99, optimiser=lambda p, r: o(p[:3], r) if not no_estimates(p) else None).losses

    assert differences(recurrent) < 1e-5
    other = rng.normal(size=(12, 4)) * 1.5
    assert differences(lambda o: learned.train_kernel(x, other, 2, 5, epochs=1, batch=12, optimiser=o)[1]) < 1e-4


def test_training_a_kernel_raises_its_signal():
    """Samples that differ in one direction of little spread."""
    rng = np.random.default_rng(6)
    draw = lambda n, s: rng.normal(size=(n, 6)) * np.array([s, 5, 5, 5, 5, 5])
    kernel, losses = learned.train_kernel(draw(600, 1.0), draw(600, 2.0), epochs=40, seed=1)
    assert losses[-1] < losses[0] - 0.05
    fresh = np.concatenate([draw(300, 1.0), draw(300, 2.0)])
    plain = kernels.GaussianRBF((float(np.sqrt(np.median(kernels.squared_distances(fresh, fresh)) / 2)),))
    assert learned.signal(kernel(fresh, fresh))[0] > learned.signal(plain(fresh, fresh))[0] + 0.05


@pytest.mark.parametrize("seed", [0, 1])
def test_training_lowers_its_own_loss(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 6)) + 0.05 * rng.normal(size=(400, 6))
    far = rng.normal(size=(40, 6)) * 4
    for auto in (networks.Autoencoder.make(x, 12, 2, seed=seed), networks.Autoencoder.make(x, 12, 2, 0.3, seed=seed)):
        auto.fit(x, 60, seed)
        assert auto.losses[-1] < 0.5 * auto.losses[0]
        err = lambda r: ((auto.reconstructions(r, 4) - r[:, None]) ** 2).mean((1, 2))
        assert np.median(err(far)) > 5 * np.median(err(x))
        assert (auto.reconstructions(x[:7], 3)[2:] == auto.reconstructions(x[2:7], 3)).all()  # whatever the batch
    for sigma in (None, 0.3):
        model = networks.DensityAutoencoder(networks.Autoencoder.make(x, 12, 2, sigma, seed=seed), networks.Network.make([4, 8, 2], seed))
        model.fit(x, 60, seed)
        assert model.losses[-1] < model.losses[0]
        assert np.median(model.energy(far, 3)) > np.quantile(model.energy(x, 3), 0.95)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0)
    model = networks.classifier(x, y, epochs=80, seed=seed)
    assert (model(x).argmax(1) == y).mean() > 0.9
    auto = networks.defender(x, model, 12, 3, seed=seed)
    assert auto.losses[-1] < 0.5 * auto.losses[0]
    assert (model(auto.reconstructions(x)[:, 0]).argmax(1) == model(x).argmax(1)).mean() > 0.85
    student = networks.distilled(x, model, seed=seed)
    assert (student(x).argmax(1) == model(x).argmax(1)).mean() > 0.85


def test_trained_adversarial_detectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)) + np.repeat(np.array([[3.0, 0, 0, 0], [-3.0, 0, 0, 0]]), 250, 0)
    ref = arrays(spark, x, 0).withColumn("y", (F.col("id") >= 250).cast("int"))
    model = adversarial.fit_classifier(ref, "features", "y", epochs=40)
    attacked = arrays(spark, np.array([[0.4, 6.0, -6.0, 6.0]] * 3), 9000)
    for det in (D.AdversarialAE(epochs=40), D.ModelDistillation(epochs=40)):
        det = det.fit(ref, model).infer_threshold(ref, 95)
        out = det.predict(ref)
        assert out.agg(F.avg("is_adversarial")).first()[0] == pytest.approx(0.05, abs=0.01)
        assert det.predict(attacked).count() == 3
        assert {"no_defense", "defense", "corrected"} <= set(det.correct(ref).columns)


def test_recurrent_detector_marks_breaks(spark):
    rng = np.random.default_rng(5)
    rows = [(s, t, float(np.sin(0.6 * t + s) + 0.05 * rng.normal())) for s in range(4) for t in range(401)]
    df = spark.createDataFrame(rows, "s long, t long, x double")
    det = D.OutlierSeq2Seq(length=20, hidden=16, epochs=60).fit(df).infer_threshold(df, "x", "t", "s", 99)
    scored = det.score(df, "x", "t", "s")
    assert scored.count() == 4 * 400
    assert scored.where("step > 5").agg(F.avg("error")).first()[0] < 0.1
    broken = df.withColumn("x", F.when((F.col("t") == 215), F.col("x") + 3).otherwise(F.col("x")))
    hits = det.predict(broken, "x", "t", "s").where("is_outlier = 1 and window = 10 and step = 14").count()
    assert hits == 4


def test_classifier_out_of_bag_and_calibrated(spark):
    rng = np.random.default_rng(4)
    ref, same, moved = (arrays(spark, rng.normal(size=(300, 2)) + shift, start) for shift, start in ((0, 0), (0, 1000), (1.5, 2000)))
    for kw in ({"use_oob": True, "model": "rf"}, {"calibrate": True}):
        det = D.ClassifierDrift(ref, "features", "id", n_folds=2, **kw)
        assert det.predict(moved).first().is_drift == 1
        assert det.predict(same).first().p_val > 0.001
    probs = learned.calibrated(learned.out_of_fold(ref, moved, "features", "id", "lr", 2))
    r = probs.agg(F.min("prob"), F.max("prob"), F.avg("prob"), F.count("prob")).first()
    assert 0 <= r[0] < r[1] <= 1 and r[2] == pytest.approx(0.5, abs=0.05) and r[3] == 600
    assert learned.out_of_bag(ref, moved, "features", "id", bags=6).count() > 500


def test_likelihood_ratio_with_mutated_background(spark, tmp_path):
    rows = [(i, "the sea and the boats " * (2 + i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    moved = {r.doc_id: r.text for r in recon.mutated(df, "doc_id", "text", 0.3).collect()}
    changed = np.mean([a != b for i, t in rows for a, b in zip(t, moved[i])])
    assert all(len(moved[i]) == len(t) for i, t in rows) and 0.2 < changed < 0.35
    assert [r.text for r in recon.mutated(df, "doc_id", "text", 0.0).orderBy("doc_id").collect()] == [t for _, t in rows]
    llr = D.LLR().fit(df, mutation_rate=0.3)
    own = spark.createDataFrame([(1, "the boats and the sea"), (2, "xqz vjk wqx zzk"), (3, "a")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in llr.score(own).collect()}
    assert score[1] < score[2]
    with pytest.raises(D.NoThreshold):
        llr.predict(own)
    fitted, path = llr.infer_threshold(df, 99), str(tmp_path / "llr")
    assert {r.doc_id: r.is_outlier for r in fitted.predict(own).collect()}[2] == 1
    spec.save(spec.Spec("LLR", {"threshold": fitted.threshold}), None, path, semantic=fitted.semantic, background=fitted.background)
    back = D.from_spec(spec.load(spark, path, D.KNOWN)[0], None, **{t: spec.load_table(spark, path, t) for t in ("semantic", "background")})
    assert back.threshold == fitted.threshold and {r.doc_id: r.score for r in back.score(own).collect()} == pytest.approx(score)
    steps = recon.likelihood_ratio_steps(own, llr.semantic, llr.background).groupBy("doc_id").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.doc_id: r.n for r in steps} == {1: 20, 2: 14} and all(r.s == pytest.approx(score[r.doc_id]) for r in steps)


def test_extension_points(vec_pair):
    ref, _, moved = vec_pair
    given = D.MMDDrift(ref, n_permutations=5, init_sigma=lambda r, t, v, i: kernels.sigma_mean(r.unionByName(t), v)).predict(moved)
    sigma = kernels.sigma_mean(ref.unionByName(moved)).first().sigma
    assert given["distance"] == pytest.approx(D.MMDDrift(ref, n_permutations=5, sigma=(sigma,)).predict(moved)["distance"])
    out = recon.outlier_aegmm(moved, ref, "features", epochs=3, recon_features=lambda x, code, y: np.column_stack([code, ((x - y) ** 2).sum(1)]))
    assert out.where("score is null").count() == 0
