"""What a task holds or a shuffle sends doesn't follow the size of a table."""

import numpy as np
from pyspark.sql import functions as F

from driftlane.operators import adversarial, categorical, kernels, learned, projection, recon, thresholds


def frame(spark, x: np.ndarray):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")


def test_percentiles_hold_no_feature_in_a_task(spark):
    x = np.round(np.random.default_rng(0).normal(size=(501, 2)), 1)
    df = spark.createDataFrame(x.tolist() + [[None, None]], "a double, b double")
    for p in (0, 12.5, 95, 100):
        plan = thresholds.percentile_threshold(df, "a", p)
        assert abs(plan.first()[0] - np.percentile(x[:, 0], p)) < 1e-12
        assert "percentile(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    edges = categorical.bin_edges(df, ["a", "b"])
    assert all(np.allclose(edges[f], np.percentile(x[:, i], [25, 50, 75])) for i, f in enumerate("ab"))
    assert thresholds.percentile_threshold(df.limit(0), "a", 50).first()[0] is None
    assert abs(adversarial.threshold_with_margin(df, "a", 90, 0.5).first()[0] - np.percentile(x[:, 0], 90) - 0.5) < 1e-12


def test_kernel_pca_scores_few_rows_at_a_time(spark):
    class Widest:
        """A kernel that refuses more than some rows at a time."""

        def __call__(self, x, y):
            assert len(x) <= 512 or len(x) == len(y)
            return kernels.GaussianRBF((1.0,))(x, y)

    x = np.random.default_rng(1).normal(size=(1500, 3))
    got = projection.kernel_pca(frame(spark, x).coalesce(1), frame(spark, x[:40]), "features", 2, Widest()).select("score").collect()
    assert len(got) == 1500


def test_blocks_of_tiles_give_the_sums_of_all_pairs(spark):
    x = np.random.default_rng(2).normal(size=(330, 4))
    df = frame(spark, x)
    ref, test = df.where("id < 150"), df.where("id >= 150")
    s = kernels.numbered(ref, test, order="id", size=5)  # 66 tiles in blocks of 4
    sums = kernels.tile_sums(s, kernels.GaussianRBF((1.0,)), permutations=3)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    k = np.exp(-d / 2) - np.eye(330)
    want = [k[:150, :150].sum(), k[150:, 150:].sum(), k[:150, 150:].sum()]
    assert np.allclose(sums[0], want) and np.allclose(sums.sum(1) + sums[:, 2], k.sum())
    sigma = kernels.sigma_median(ref, test, local=50, size=5).first().sigma
    flat = np.sort(d[np.triu_indices(330, 1)])
    assert abs(sigma - np.sqrt(flat[((330 * 330 - 330) // 2 - 1) // 2] / 2)) < 1e-9


def test_rows_go_to_a_bounded_number_of_blocks(spark):
    s = kernels.numbered(frame(spark, np.zeros((400, 2))), frame(spark, np.zeros((0, 2))), order="id", size=4)
    groups = kernels._block_pairs(s).applyInArrow(lambda a, b: a.group_by("i").aggregate([("n", "count")]).select(["n_count"]).rename_columns(["n"]), "n long").toPandas()
    assert groups["n"].sum() <= 400 * 18  # each row once for each block, not for each of 100 tiles


def test_regularisers_share_a_decomposition(monkeypatch):
    rng = np.random.default_rng(4)
    c, x = rng.normal(size=(60, 2)), rng.normal(size=(60, 3))
    l_mat, k = kernels.GaussianRBF((1.0,))(c, c), kernels.GaussianRBF((1.0,))(x, x)
    losses = []
    for i in range(20):
        total = 0.0
        for part in np.array_split(np.random.default_rng(0).permutation(60), 5):
            rest = np.setdiff1d(np.arange(60), part)
            w = np.linalg.solve(l_mat[np.ix_(rest, rest)] + 2.0**-i * len(rest) * np.eye(len(rest)), l_mat[np.ix_(rest, part)])
            total += np.trace(k[np.ix_(part, part)]) + (w * (k[np.ix_(rest, rest)] @ w)).sum() - 2 * (k[np.ix_(rest, part)] * w).sum()
        losses.append((total, 2.0**-i))
    monkeypatch.setattr(np.linalg, "inv", None)  # an inverse for each regulariser and fold took all the time
    assert learned.pick_lambda(l_mat, k) == min(losses)[1]


def test_boosted_trees_are_fitted_on_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 6, 900), rng.choice([0.5, -1.0, 7.0], 900)]).astype(float)
    df = spark.createDataFrame([(i, *v, float(rng.normal())) for i, v in enumerate(x.tolist())], "id long, a double, b double, c double")
    ref, test, sizes = df.where("id < 500"), df.where("id >= 500").withColumn("a", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("a"))), []
    fit = learned.GBTClassifier.fit
    monkeypatch.setattr(learned.GBTClassifier, "fit", lambda self, d, *a: (sizes.append(d.count()), fit(self, d, *a))[1])
    for n_folds in (2, None):
        cells, rows = (learned.out_of_fold(ref, test, ["a", "b"], "id", m, n_folds) for m in ("gbt", learned.classifier("gbt")))
        got, want = ({(r.key, r.is_ref): (r.fold, r.prob) for r in f.collect()} for f in (cells, rows))
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    assert max(sizes[:2]) <= 36 and sizes[2] > 400  # 18 cells of two labels, not the rows
    cuts = learned.bin_cuts(df, ["a", "b", "c"], 32)
    assert cuts[:2] == [[0, 1, 2, 3, 4], [-1.0, 0.5]] and 29 <= len(cuts[2]) <= 31
    assert learned.out_of_fold(ref, test, ["a", "b", "c"], "id", "gbt", 2).count() == 900


def test_character_pairs_are_no_rows(spark, monkeypatch):
    wide = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 1500))
    rows = [(1, "abab\U0001f600b"), (1, "ba"), (2, "a"), (3, None), (4, ""), (5, "xyé"), (6, wide), (7, "ab\0a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {(r.prev, r.next): r.c for r in recon.pair_counts(df, "text").collect()}
    assert counts == {(r.prev, r.next): r["count"] for r in recon.bigrams(df, "doc_id", "text").groupBy("prev", "next").count().collect()}
    a, b = (recon.bigram_model(recon.pair_counts(d, "text")) for d in (df.where("doc_id = 1"), df.where("doc_id < 6")))
    out = recon.likelihood_ratio(df, a, b)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # the pairs of a text were rows
    monkeypatch.setattr(recon, "PAIRS", 1)
    got, want = ({r.doc_id: r.score for r in d.collect()} for d in (out, recon.likelihood_ratio(df, a, b)))
    assert got.keys() == want.keys() == {1, 5, 6, 7} and all(abs(got[k] - want[k]) < 1e-9 for k in want)
