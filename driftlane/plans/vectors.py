"""Queries over vectors: kernels, neighbours, projections, reconstructions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.functions import columns as C
from driftlane.functions import frames
from driftlane.operators import adversarial, kernels, learned, mixture, neighbours, projection, recon, thresholds
from driftlane.plans.drift import SOFT
from driftlane.plans.registry import query, r6, row, table


def vecs(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), (F.col("vec_id") % 2 == 0).cast("int").alias("is_ref"))


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    v = vecs(spark, d)
    return v.where("is_ref = 1"), v.where("is_ref = 0")


V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CAST(vec_id % 2 = 0 AS INTEGER) AS is_ref FROM embeddings)"
PAIRS = f"{V}, p AS (SELECT a.is_ref AS fa, b.is_ref AS fb, list_distance(a.x, b.x) ** 2 AS d2 FROM v a JOIN v b ON a.id < b.id)"


@query(f"""WITH {PAIRS}, s AS (SELECT sum(CASE WHEN fa = 1 AND fb = 1 THEN exp(-d2 / 2) END) AS xx, sum(CASE WHEN fa = 0 AND fb = 0 THEN exp(-d2 / 2) END) AS yy, sum(CASE WHEN fa <> fb THEN exp(-d2 / 2) END) AS xy FROM p),
c AS (SELECT CAST(sum(is_ref) AS DOUBLE) AS n, CAST(sum(1 - is_ref) AS DOUBLE) AS m FROM v)
SELECT round(2 * xx / (n * (n - 1)) + 2 * yy / (m * (m - 1)) - 2 * xy / (n * m), 9) AS mmd2 FROM s, c""")
def mmd2_fixed_sigma(spark, d):
    """The tiled sums with a set bandwidth."""
    s = kernels.numbered(*halves(spark, d), order="id")
    value = kernels.mmd2(kernels.tile_sums(s, kernels.GaussianRBF((1.0,))), s.n_ref, s.n_test)[0]
    return spark.createDataFrame([(round(float(value), 9) + 0.0,)], "mmd2 double")


@query(f"""WITH {V}, p AS (SELECT a.is_ref AS fa, b.is_ref AS fb, 0.8 * exp(-(list_distance(a.x[1:4], b.x[1:4]) ** 2) * 2) + 0.2 * exp(-(list_distance(a.x, b.x) ** 2) / 2) AS k FROM v a JOIN v b ON a.id < b.id),
s AS (SELECT sum(CASE WHEN fa = 1 AND fb = 1 THEN k END) AS xx, sum(CASE WHEN fa = 0 AND fb = 0 THEN k END) AS yy, sum(CASE WHEN fa <> fb THEN k END) AS xy FROM p),
c AS (SELECT CAST(sum(is_ref) AS DOUBLE) AS n, CAST(sum(1 - is_ref) AS DOUBLE) AS m FROM v)
SELECT round(2 * xx / (n * (n - 1)) + 2 * yy / (m * (m - 1)) - 2 * xy / (n * m), 9) AS mmd2 FROM s, c""")
def mmd2_deep_kernel(spark, d):
    """A kernel on a projection, mixed with one on the whole vectors."""
    s = kernels.numbered(*halves(spark, d), order="id")
    kernel = kernels.DeepKernel(learned.Linear(np.eye(64)[:, :4]), kernels.GaussianRBF((0.5,)), kernels.GaussianRBF((1.0,)), 0.2)
    value = kernels.mmd2(kernels.tile_sums(s, kernel), s.n_ref, s.n_test)[0]
    return spark.createDataFrame([(round(float(value), 9) + 0.0,)], "mmd2 double")


@query(f"WITH {PAIRS}, r AS (SELECT d2, row_number() OVER (ORDER BY d2) - 1 AS i, count(*) OVER () AS n FROM p) SELECT round(sqrt(d2 / 2), 6) AS sigma FROM r WHERE i = (n - 1) // 2")
def sigma_median(spark, d):
    return kernels.sigma_median(*halves(spark, d)).select(r6("sigma").alias("sigma"))


@query(f"WITH {PAIRS} SELECT round(sqrt(avg(d2) / 2), 6) AS sigma FROM p")
def sigma_mean(spark, d):
    return kernels.sigma_mean(vecs(spark, d)).select(r6("sigma").alias("sigma"))


@query(f"""WITH {PAIRS}, r AS (SELECT d2, row_number() OVER (ORDER BY d2) - 1 AS i, count(*) OVER () AS n FROM p), g AS (SELECT d2 AS s FROM r WHERE i = (n - 1) // 2),
s AS (SELECT sum(CASE WHEN fa = 1 AND fb = 1 THEN exp(-d2 / s) END) AS xx, sum(CASE WHEN fa = 0 AND fb = 0 THEN exp(-d2 / s) END) AS yy, sum(CASE WHEN fa <> fb THEN exp(-d2 / s) END) AS xy FROM p, g),
c AS (SELECT CAST(sum(is_ref) AS DOUBLE) AS n, CAST(sum(1 - is_ref) AS DOUBLE) AS m FROM v)
SELECT round(2 * xx / (n * (n - 1)) + 2 * yy / (m * (m - 1)) - 2 * xy / (n * m), 9) AS distance FROM s, c""")
def mmd_distance(spark, d):
    """The distance of the test with its own bandwidth, the median of all pairs."""
    value = kernels.mmd(*halves(spark, d), permutations=1)["distance"]
    return spark.createDataFrame([(round(value, 9) + 0.0,)], "distance double")


@query()
def mmd_report(spark, d):
    return row(spark, kernels.mmd(*halves(spark, d), permutations=100))


@query()
def lsdd_report(spark, d):
    return row(spark, kernels.lsdd(*halves(spark, d), permutations=50))


@query(f"WITH {V}, c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS centre, x AS c FROM v ORDER BY id LIMIT 8) SELECT CAST(centre AS INTEGER) AS centre, round(avg(CASE WHEN is_ref = 1 THEN exp(-(list_distance(x, c) ** 2) / 2) END) - avg(CASE WHEN is_ref = 0 THEN exp(-(list_distance(x, c) ** 2) / 2) END), 6) AS h FROM v, c GROUP BY centre")
def lsdd_h_vector(spark, d):
    v = vecs(spark, d)
    centres = np.array([r.features for r in v.orderBy("id").limit(8).collect()])
    return kernels.lsdd_h(v, centres, 1.0).select("centre", r6("h").alias("h"))


@query()
def context_mmd_report(spark, d):
    """The last 60 components given a context of the first four, by a segment of the labels."""
    e = table(spark, d, "embeddings")
    x = F.col("embedding").cast("array<double>")
    pair = e.select((F.col("label") % 2).alias("segment"), F.slice(x, 5, 60).alias("x"), F.slice(x, 1, 4).alias("c"), (F.col("vec_id") % 2 == 0).cast("int").alias("is_ref"))
    return learned.context_mmd_drift(pair, "x", "c", "segment", permutations=20)


@query()
def learned_kernel_report(spark, d):
    ref, test = halves(spark, d)
    return row(spark, learned.learned_kernel_drift(ref, test, "features", "id", permutations=50))


@query()
def spot_the_diff_report(spark, d):
    ref, test = halves(spark, d)
    return row(spark, learned.spot_the_diff_drift(ref, test, "features", "id"))


# -- distances and neighbours --------------------------------------------------

FIRST = f"WITH {V}, f AS (SELECT x AS y FROM v ORDER BY id LIMIT 1)"


@query(f"{FIRST} SELECT id, round(list_sum([abs(x[i] - y[i]) FOR i IN range(1, 65)]), 6) AS l1, round(list_distance(x, y), 6) AS l2, round(list_sum([abs(x[i] - y[i]) ** 3 FOR i IN range(1, 65)]) ** (1 / 3.0), 6) AS l3 FROM v, f")
def pairwise_distance(spark, d):
    """One row against all others, by three norms."""
    v = vecs(spark, d)
    y = F.array(*map(F.lit, v.orderBy("id").first().features))
    return v.select("id", r6(C.cityblock("features", y)).alias("l1"), r6(C.minkowski("features", y)).alias("l2"), r6(C.minkowski("features", y, 3)).alias("l3"))


NEAR = f"{V}, n AS (SELECT q.id, r.id AS nb, list_distance(q.x, r.x) AS dist, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.x, r.x), r.id) AS rk FROM v q JOIN v r ON q.is_ref = 0 AND r.is_ref = 1)"


@query(f"WITH {NEAR} SELECT id, nb AS neighbour, CAST(rk AS INTEGER) AS rank, round(dist, 6) AS distance FROM n WHERE rk <= 5")
def knn_join(spark, d):
    ref, test = halves(spark, d)
    return neighbours.neighbours(test, ref, 5).select("id", "neighbour", "rank", r6("distance").alias("distance"))


@query(f"WITH {NEAR} SELECT id, round(dist, 6) AS score FROM n WHERE rk = 5")
def knn_distance(spark, d):
    ref, test = halves(spark, d)
    return neighbours.knn_scores(test, ref, 5).select("id", r6("score").alias("score"))


ENS = f"{NEAR}, s AS (SELECT id, list(dist ORDER BY rk) AS s FROM n WHERE rk IN (1, 5, 10) GROUP BY id)"


def ensemble(spark, d) -> DataFrame:
    ref, test = halves(spark, d)
    return neighbours.knn_scores(test, ref, [1, 5, 10])


@query(f"WITH {ENS} SELECT id, round(list_avg(s), 6) AS avg_score, round(list_max(s), 6) AS max_score, round(list_min(s), 6) AS min_score, round((s[2] + s[3]) / 2, 6) AS top_score, round(0.5 * s[1] + 0.25 * s[2] + 0.25 * s[3], 6) AS weighted FROM s")
def knn_ensemble(spark, d):
    s = ensemble(spark, d)
    A = thresholds.AGGREGATORS
    return s.select("id", r6(A["average"]("scores")).alias("avg_score"), r6(A["max"]("scores")).alias("max_score"), r6(A["min"]("scores")).alias("min_score"), r6(A["top_k"]("scores")).alias("top_score"), r6(thresholds.average("scores", [0.5, 0.25, 0.25])).alias("weighted"))


@query(f"WITH {ENS} SELECT id, round(1 - (1 + (SELECT count(*) FROM s o WHERE o.s[1] > s.s[1] AND o.id % 4 = 1)) / (1.0 + (SELECT count(*) FROM s o WHERE o.id % 4 = 1)), 6) AS p1 FROM s")
def pval_normaliser(spark, d):
    s = frames.kept(ensemble(spark, d))
    norm = thresholds.p_value_normaliser(s.where("id % 4 = 1"), "scores")
    return s.select("id", r6(F.get(norm("scores"), F.lit(0))).alias("p1"))


@query(f"WITH {ENS}, m AS (SELECT avg(s[1]) AS m, stddev_samp(s[1]) AS sd FROM s) SELECT id, round((s[1] - m) / sd, 6) AS z1 FROM s, m")
def zscore_normaliser(spark, d):
    s = frames.kept(ensemble(spark, d))
    norm = thresholds.shift_scale_normaliser(s, "scores")
    return s.select("id", r6(F.get(norm("scores"), F.lit(0))).alias("z1"))


@query(f"""WITH {V}, own AS (SELECT q.id, r.id AS nb, list_distance(q.x, r.x) AS dist, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.x, r.x), r.id) AS rk FROM v q JOIN v r ON q.is_ref = 1 AND r.is_ref = 1 AND q.id <> r.id),
kd AS (SELECT id, max(dist) AS kd FROM own WHERE rk <= 5 GROUP BY id), ar AS (SELECT o.id, avg(greatest(dist, kd)) AS ar FROM own o JOIN kd ON kd.id = o.nb WHERE rk <= 5 GROUP BY o.id),
q AS (SELECT q.id, r.id AS nb, list_distance(q.x, r.x) AS dist, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.x, r.x), r.id) AS rk FROM v q JOIN v r ON q.is_ref = 0 AND r.is_ref = 1)
SELECT q.id, round(avg(greatest(dist, kd)) * avg(1 / ar), 6) AS score FROM q JOIN kd ON kd.id = nb JOIN ar ON ar.id = nb WHERE rk <= 5 GROUP BY q.id""")
def lof_score(spark, d):
    ref, test = halves(spark, d)
    return neighbours.lof_scores(test, ref, 5).select("id", r6("score").alias("score"))


# -- covariance ----------------------------------------------------------------

XY = "l AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y, CAST(l_orderkey % 2 = 0 AS INTEGER) AS is_ref FROM lineitem), m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM l WHERE is_ref = 1)"


def lines_2d(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


@query(f"WITH {XY} SELECT l_orderkey, l_linenumber, round((c * (x - mx) ** 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ** 2) / (a * c - b * b), 6) AS score FROM l, m")
def mahalanobis_2d(spark, d):
    l = lines_2d(spark, d)
    return projection.mahalanobis(l, l.where("l_orderkey % 2 = 0"), ["x", "y"]).select("l_orderkey", "l_linenumber", r6("score").alias("score"))


@query(f"WITH {XY}, e AS (SELECT mx, my, a, b, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS lo FROM m) SELECT l_orderkey, l_linenumber, round(((x - mx) * b + (y - my) * (lo - a)) ** 2 / (b * b + (lo - a) ** 2), 6) AS score FROM l, e")
def pca_residual_2d(spark, d):
    l = lines_2d(spark, d)
    return projection.pca(l, l.where("l_orderkey % 2 = 0"), ["x", "y"], 1).select("l_orderkey", "l_linenumber", r6("score").alias("score"))


@query(f"WITH {XY} SELECT round(mx, 6) AS mean_x, round(my, 6) AS mean_y, round(a, 6) AS var_x, round(b, 6) AS cov, round(c, 6) AS var_y FROM m")
def mean_covariance(spark, d):
    l = lines_2d(spark, d)
    _, mean, cov = projection.moments(l.where("l_orderkey % 2 = 0"), ["x", "y"])
    return spark.createDataFrame([tuple(round(float(v), 6) for v in (mean[0], mean[1], cov[0, 0], cov[0, 1], cov[1, 1]))], "mean_x double, mean_y double, var_x double, cov double, var_y double")


def _scored(df: DataFrame) -> DataFrame:
    return df.select("id", r6("score").alias("score"))


@query()
def kernel_pca_score(spark, d):
    ref, test = halves(spark, d)
    return _scored(projection.kernel_pca(test, ref, "features", 5, kernels.GaussianRBF((1.0,))))


@query(f"WITH {XY} SELECT l_orderkey, l_linenumber, round(0.5 * (c * (x - mx) ** 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ** 2) / (a * c - b * b) + 0.5 * ln(a * c - b * b) + ln(2 * pi()), 5) AS score FROM l, m")
def gaussian_score(spark, d):
    """Minus the log density under a mixture of one."""
    l = lines_2d(spark, d)
    return mixture.gmm(l, l.where("l_orderkey % 2 = 0"), ["x", "y"], 1).select("l_orderkey", "l_linenumber", F.round("score", 5).alias("score"))


@query()
def gmm_score(spark, d):
    l = lines_2d(spark, d)
    return _scored(mixture.gmm(l, l.where("l_orderkey % 2 = 0"), ["x", "y"], 3))


@query()
def svm_score(spark, d):
    ref, test = halves(spark, d)
    return _scored(mixture.svm(test, ref, "features", 0.1, 30))


@query()
def iforest_score(spark, d):
    l = lines_2d(spark, d)
    return _scored(mixture.isolation_forest(l, l.where("l_orderkey % 2 = 0"), ["x", "y"]))


# -- reconstructions and probabilities -----------------------------------------


@query(f"WITH {V}, m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(e) AS a FROM (SELECT unnest(x) AS e, unnest(range(1, 65)) AS i FROM v WHERE is_ref = 1) GROUP BY i)), e AS (SELECT id, list_reverse_sort([(x[i] - m[i]) ** 2 FOR i IN range(1, 65)]) AS e FROM v, m) SELECT id, round(list_avg(e), 6) AS score_all, round(list_avg(e[1:7]), 6) AS score_top FROM e")
def recon_instance_score(spark, d):
    """Errors against the reference's mean as the reconstruction."""
    v = vecs(spark, d)
    mean = v.where("is_ref = 1").select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    e = v.withColumn("e", recon.feature_error("features", F.array(*[F.lit(r.m) for r in mean])))
    return e.select("id", r6(recon.instance_score("e")).alias("score_all"), r6(recon.instance_score("e", 10)).alias("score_top"))


@query()
def outlier_ae_score(spark, d):
    ref, test = halves(spark, d)
    return _scored(recon.outlier_ae(test, ref, "features", epochs=20))


@query()
def outlier_vae_score(spark, d):
    ref, test = halves(spark, d)
    return _scored(recon.outlier_vae(test, ref, "features", epochs=20))


@query()
def outlier_aegmm_score(spark, d):
    ref, test = halves(spark, d)
    return _scored(recon.outlier_aegmm(test, ref, "features", epochs=20))


@query()
def outlier_vaegmm_score(spark, d):
    ref, test = halves(spark, d)
    return _scored(recon.outlier_vaegmm(test, ref, "features", epochs=20))


@query(f"WITH {V}, m AS (SELECT list(a ORDER BY i) AS y FROM (SELECT i, avg(e) AS a FROM (SELECT unnest(x) AS e, unnest(range(1, 65)) AS i FROM v) GROUP BY i)) SELECT id, round(1 - list_cosine_similarity(x, y), 6) AS cos_loss, round(least(100.0, list_distance(x, y) / (least(sqrt(list_inner_product(x, x)), sqrt(list_inner_product(y, y))) + 1e-12)), 6) AS rel FROM v, m")
def energy_features(spark, d):
    v = vecs(spark, d)
    mean = v.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    f = v.select("id", recon.energy_features("features", F.array(*[F.lit(r.m) for r in mean])).alias("f"))
    return f.select("id", r6(F.get("f", F.lit(0))).alias("cos_loss"), r6(F.get("f", F.lit(1))).alias("rel"))


TWO = SOFT + """, p2 AS (SELECT vec_id, [CAST(x AS DOUBLE) * 8 FOR x IN embedding[6:10]] AS z FROM embeddings),
q2 AS (SELECT vec_id, [exp(x - list_max(z)) FOR x IN z] AS e FROM p2), s2 AS (SELECT vec_id, [x / list_sum(e) FOR x IN e] AS q FROM q2), b AS (SELECT vec_id, p, q FROM s JOIN s2 USING (vec_id))"""


def two_models(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    soft = lambda a: C.softmax(F.transform(F.slice(F.col("embedding").cast("array<double>"), a, 5), lambda x: x * 8))
    return e.select("vec_id", soft(1).alias("p"), soft(6).alias("q"))


@query(f"WITH {TWO}, t AS (SELECT vec_id, q, [x ** 2 FOR x IN p] AS s FROM b), u AS (SELECT vec_id, q, [x / list_sum(s) FOR x IN s] AS p FROM t) SELECT vec_id, round(list_sum([p[i] * ln(p[i] / q[i]) FOR i IN range(1, 6)]), 6) AS score FROM u")
def kld_adversarial(spark, d):
    return two_models(spark, d).select("vec_id", r6(adversarial.adversarial_score("p", "q", 0.5)).alias("score"))


@query(f"WITH {TWO} SELECT vec_id, round(list_sum([-p[i] * ln(q[i]) FOR i IN range(1, 6)]), 6) AS score FROM b")
def xent_distillation(spark, d):
    return two_models(spark, d).select("vec_id", r6(adversarial.distillation_score("p", "q", "xent")).alias("score"))


@query(f"WITH {TWO}, k AS (SELECT vec_id, list_sum([p[i] * ln(p[i] / q[i]) FOR i IN range(1, 6)]) AS s, list_position(p, list_max(p)) - 1 AS a, list_position(q, list_max(q)) - 1 AS c FROM b) SELECT vec_id, CAST(s > 1.0 AS INTEGER) AS is_adversarial, CAST(a AS INTEGER) AS no_defense, CAST(c AS INTEGER) AS defense, CAST(CASE WHEN s > 1.0 THEN c ELSE a END AS INTEGER) AS corrected FROM k")
def adversarial_correct(spark, d):
    t = two_models(spark, d).withColumn("score", adversarial.adversarial_score("p", "q"))
    return adversarial.correct(t, "score", 1.0, "p", "q").select("vec_id", "is_adversarial", "no_defense", "defense", "corrected")


@query(f"WITH {TWO}, k AS (SELECT list_sum([p[i] * ln(p[i] / q[i]) FOR i IN range(1, 6)]) AS s FROM b) SELECT round(quantile_cont(s, 0.99) + 0.05, 6) AS threshold FROM k")
def adversarial_threshold(spark, d):
    t = two_models(spark, d).withColumn("score", adversarial.adversarial_score("p", "q"))
    return adversarial.threshold_with_margin(t, "score", 99, 0.05).select(r6("threshold").alias("threshold"))




def classes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Vectors of even number with three classes, and the others."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") % 3).cast("int").alias("y"))
    return e.where("id % 2 = 0 and y is not null"), e.where("id % 2 = 1")


@query()
def adversarial_ae_score(spark, d):
    ref, test = classes(spark, d)
    model = adversarial.fit_classifier(ref, "features", "y", epochs=20)
    return _scored(adversarial.adversarial_ae(test, ref, "features", model, epochs=20))


@query()
def model_distillation_score(spark, d):
    ref, test = classes(spark, d)
    model = adversarial.fit_classifier(ref, "features", "y", epochs=20)
    return _scored(adversarial.model_distillation(test, ref, "features", model, epochs=20))
