"""Queries of the univariate tests, thresholds and uncertainty detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.functions import columns as C
from driftlane.operators import learned, thresholds, univariate
from driftlane.plans.registry import query, r6, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAGS = ["l_returnflag", "l_linestatus"]
CUT = "TIMESTAMP '1998-07-01'"


def lineitem_pair(spark, d) -> DataFrame:
    """Lines by ship date: the earlier ones are the reference."""
    return table(spark, d, "lineitem").select(*NUMERIC, *FLAGS, F.expr(f"CAST(CAST(l_shipdate AS TIMESTAMP) < {CUT} AS INT)").alias("is_ref"))


def events_pair(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "value", "event_type", F.expr("CAST(CAST(ts AS TIMESTAMP) < TIMESTAMP '2024-01-16' AS INT)").alias("is_ref"))


def orders_flags(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), (F.col("o_orderstatus") == "F").cast("int").alias("finished"),
        F.expr("CAST(CAST(o_orderdate AS TIMESTAMP) < TIMESTAMP '1998-07-01' AS INT)").alias("is_ref"),
    )


# -- SQL pieces ----------------------------------------------------------------

LINE_LONG = f"""line AS (SELECT CAST(l_shipdate < {CUT} AS BIGINT) AS is_ref, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem),
num AS (SELECT is_ref, feature, value FROM line UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)))"""

ECDF = """g AS (SELECT feature, value, sum(is_ref) AS r, sum(1 - is_ref) AS t FROM num GROUP BY feature, value),
c AS (SELECT feature, value, r, t, sum(r) OVER w AS ru, sum(t) OVER w AS tu, sum(r) OVER (PARTITION BY feature) AS n, sum(t) OVER (PARTITION BY feature) AS m
      FROM g WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT feature, max(abs(CAST(ru AS DOUBLE) / n - CAST(tu AS DOUBLE) / m)) AS d, max(CAST(ru AS DOUBLE) / n - CAST(tu AS DOUBLE) / m) AS up,
       max(CAST(tu AS DOUBLE) / m - CAST(ru AS DOUBLE) / n) AS down, max(n) AS n, max(m) AS m FROM c GROUP BY feature)"""

CHI = """cat AS (SELECT is_ref, feature, value FROM line UNPIVOT (value FOR feature IN (l_returnflag, l_linestatus))),
k AS (SELECT feature, value, CAST(sum(is_ref) AS DOUBLE) AS r, CAST(sum(1 - is_ref) AS DOUBLE) AS t FROM cat GROUP BY feature, value),
e AS (SELECT feature, r, t, sum(r) OVER p AS n, sum(t) OVER p AS m, count(*) OVER p AS cats FROM k WINDOW p AS (PARTITION BY feature)),
o AS (SELECT feature, cats, abs(r - n * (r + t) / (n + m)) AS a, n * (r + t) / (n + m) AS ea, abs(t - m * (r + t) / (n + m)) AS b, m * (r + t) / (n + m) AS eb FROM e),
y AS (SELECT feature, cats, CASE WHEN cats = 2 THEN a - least(0.5, a) ELSE a END AS a, ea, CASE WHEN cats = 2 THEN b - least(0.5, b) ELSE b END AS b, eb FROM o),
chi AS (SELECT feature, sum(a * a / ea + b * b / eb) AS x, max(cats) - 1 AS dof FROM y GROUP BY feature)"""

#: Upper tail of chi-squared by the series of the lower incomplete gamma function.
CHI_SF = "greatest(0.0, 1 - CASE WHEN x <= 0 THEN 0 ELSE list_sum(list_transform(range(0, 400), lambda i: exp(-x / 2 + (dof / 2.0 + i) * ln(x / 2) - lgamma(dof / 2.0 + i + 1)))) END)"
#: Two-sided tail for more than 3000 effective rows.
KS_SF = """CASE WHEN en * d * d > 370 THEN 0 WHEN en * d * d > 18 THEN least(1, 2 * exp(-2 * d * d * en))
 ELSE least(1, greatest(0, CASE WHEN z < 1 THEN 1 - sqrt(2 * pi()) / z * list_sum(list_transform(range(1, 8), lambda k: exp(-((2 * k - 1) ** 2) * pi() ** 2 / (8 * z * z))))
   ELSE 2 * list_sum(list_transform(range(1, 12), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * z * z))) END)) END"""
KS_P = f"""eff AS (SELECT feature, d, round(CAST(n AS DOUBLE) * m / (n + m)) AS en FROM ks),
zed AS (SELECT feature, d, en, d * sqrt(en) + 1 / (6 * sqrt(en)) + (d * sqrt(en) - 1) / (4 * en) AS z FROM eff),
ksp AS (SELECT feature, d AS distance, {KS_SF} AS p_val FROM zed)"""
REPORT = f"WITH {LINE_LONG}, {ECDF}, {KS_P}, {CHI}, rep AS (SELECT feature, distance, p_val, 'ks' AS test FROM ksp UNION ALL SELECT feature, x, {CHI_SF}, 'chi2' FROM chi)"


@query(f"WITH {LINE_LONG}, {ECDF} SELECT feature, round(d, 6) AS distance FROM ks")
def ks_two_sided(spark, d):
    return univariate.ks_statistic(lineitem_pair(spark, d), NUMERIC).select("feature", r6("distance").alias("distance"))


@query(f"WITH {LINE_LONG}, {ECDF} SELECT feature, round(greatest(up, 0), 6) AS distance FROM ks")
def ks_greater(spark, d):
    return univariate.ks_statistic(lineitem_pair(spark, d), NUMERIC, "greater").select("feature", r6("distance").alias("distance"))


@query(f"WITH {LINE_LONG}, {ECDF} SELECT feature, round(greatest(down, 0), 6) AS distance FROM ks")
def ks_less(spark, d):
    return univariate.ks_statistic(lineitem_pair(spark, d), NUMERIC, "less").select("feature", r6("distance").alias("distance"))


@query(f"WITH {LINE_LONG}, {ECDF}, h AS (SELECT feature, greatest(up, 0) AS d, CAST(greatest(n, m) AS DOUBLE) AS a, CAST(least(n, m) AS DOUBLE) AS b FROM ks) SELECT feature, round(d, 6) AS distance, round(exp(-2 * d * d * a * b / (a + b) - 2 * sqrt(a * b / (a + b)) * d * (a + 2 * b) / sqrt(a * b * (a + b)) / 3), 6) AS p_val FROM h")
def ks_pvalue_one_sided(spark, d):
    return univariate.ks(lineitem_pair(spark, d), NUMERIC, "greater").select("feature", r6("distance").alias("distance"), r6("p_val").alias("p_val"))


@query(f"WITH {LINE_LONG}, {ECDF}, {KS_P} SELECT feature, round(distance, 6) AS distance, round(p_val, 6) AS p_val FROM ksp")
def ks_pvalue_two_sided(spark, d):
    return univariate.ks(lineitem_pair(spark, d), NUMERIC).select("feature", r6("distance").alias("distance"), r6("p_val").alias("p_val"))


@query(f"""WITH {LINE_LONG},
a AS (SELECT feature, value, is_ref, count(*) OVER (PARTITION BY feature, value) AS ties, rank() OVER (PARTITION BY feature ORDER BY value) AS rk,
      row_number() OVER (PARTITION BY feature, is_ref ORDER BY value) AS own FROM num),
s AS (SELECT feature, sum(CASE WHEN is_ref = 1 THEN (rk + (ties - 1) / 2.0 - own) ** 2 END) AS x, sum(CASE WHEN is_ref = 0 THEN (rk + (ties - 1) / 2.0 - own) ** 2 END) AS y,
      CAST(sum(is_ref) AS DOUBLE) AS n, CAST(sum(1 - is_ref) AS DOUBLE) AS m FROM a GROUP BY feature)
SELECT feature, round((n * x + m * y) / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m)), 6) AS distance FROM s""")
def cvm_statistic(spark, d):
    return univariate.cvm_statistic(lineitem_pair(spark, d), NUMERIC).select("feature", r6("distance").alias("distance"))


#: The limiting tail by its series; K_1/4 is the quadrature of its integral.
CVM_SF = """CASE WHEN x < 0.003 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - list_sum(list_transform(range(0, 25), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / (pi() ** 1.5 * sqrt(x)) * sqrt(4 * k + 1)
* list_sum(list_transform(range(0, 601), lambda i: (CASE WHEN i IN (0, 600) THEN 0.005 ELSE 0.01 END) * exp(-((4 * k + 1) ** 2 / (16 * x)) * (cosh(i * 0.01) + 1)) * cosh(0.25 * i * 0.01))))))) END"""


@query(f"""WITH {LINE_LONG},
a AS (SELECT feature, value, is_ref, count(*) OVER (PARTITION BY feature, value) AS ties, rank() OVER (PARTITION BY feature ORDER BY value) AS rk,
      row_number() OVER (PARTITION BY feature, is_ref ORDER BY value) AS own FROM num),
s AS (SELECT feature, sum(CASE WHEN is_ref = 1 THEN (rk + (ties - 1) / 2.0 - own) ** 2 END) AS x, sum(CASE WHEN is_ref = 0 THEN (rk + (ties - 1) / 2.0 - own) ** 2 END) AS y,
      CAST(sum(is_ref) AS DOUBLE) AS n, CAST(sum(1 - is_ref) AS DOUBLE) AS m FROM a GROUP BY feature),
t AS (SELECT feature, n, m, (n * x + m * y) / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m)) AS t FROM s),
z AS (SELECT feature, t, 1 / 6.0 + (t - (1 + 1 / (n + m)) / 6) / sqrt(45 * (n + m + 1) * (4 * n * m * (n + m) - 3 * (n * n + m * m) - 2 * n * m) / (45 * (n + m) ** 2 * 4 * n * m)) AS x FROM t)
SELECT feature, round(t, 6) AS distance, round({CVM_SF}, 6) AS p_val FROM z""")
def cvm_report(spark, d):
    return univariate.cvm(lineitem_pair(spark, d), NUMERIC).select("feature", r6("distance").alias("distance"), r6("p_val").alias("p_val"))


FET = """o AS (SELECT CAST(o_orderpriority = '1-URGENT' AS BIGINT) AS urgent, CAST(o_orderstatus = 'F' AS BIGINT) AS finished, CAST(o_orderdate < TIMESTAMP '1998-07-01' AS BIGINT) AS is_ref FROM orders),
l AS (SELECT is_ref, feature, value FROM o UNPIVOT (value FOR feature IN (urgent, finished))),
f AS (SELECT feature, sum((1 - is_ref) * value) AS a, sum(is_ref * value) AS b, sum((1 - is_ref) * (1 - value)) AS c, sum(is_ref * (1 - value)) AS d FROM l GROUP BY feature)"""
CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
PMF = f"exp({CHOOSE.format('(a + c)', 'k')} + {CHOOSE.format('(b + d)', '(a + b - k)')} - {CHOOSE.format('(a + b + c + d)', '(a + b)')})"


@query(f"WITH {FET} SELECT feature, round(CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c), 6) AS distance, CAST(a AS BIGINT) AS sum_test, CAST(b AS BIGINT) AS sum_ref FROM f")
def fet_odds_ratio(spark, d):
    t = univariate.fet_table(orders_flags(spark, d), ["urgent", "finished"])
    a, b = F.col("sum_test"), F.col("sum_ref")
    return t.select("feature", r6(a * (F.col("n_ref") - b) / (b * (F.col("n_test") - a))).alias("distance"), a, b)


def _fet_tail(low: str, high: str) -> str:
    return f"WITH {FET} SELECT feature, round(list_sum(list_transform(range(CAST({low} AS BIGINT), CAST({high} AS BIGINT) + 1), lambda k: {PMF})), 6) AS p_val FROM f"


@query(_fet_tail("a", "least(a + c, a + b)"))
def fet_pvalue_greater(spark, d):
    return univariate.fet_statistic(orders_flags(spark, d), ["urgent", "finished"], "greater").select("feature", r6("p_val").alias("p_val"))


@query(_fet_tail("greatest(0, a + b - (b + d))", "a"))
def fet_pvalue_less(spark, d):
    return univariate.fet_statistic(orders_flags(spark, d), ["urgent", "finished"], "less").select("feature", r6("p_val").alias("p_val"))


@query(f"WITH {LINE_LONG}, {CHI} SELECT feature, round(x, 6) AS distance, CAST(dof AS BIGINT) AS dof, round({CHI_SF}, 6) AS p_val FROM chi")
def chi2_statistic(spark, d):
    """With Yates' correction on the flag of two values."""
    return univariate.chi2(lineitem_pair(spark, d), FLAGS).select("feature", r6("distance").alias("distance"), F.col("dof").cast("long").alias("dof"), r6("p_val").alias("p_val"))


@query("""WITH line AS (SELECT CAST(ts < TIMESTAMP '2024-01-16' AS BIGINT) AS is_ref, CASE WHEN ts >= TIMESTAMP '2024-01-16' AND event_id % 10 = 0 THEN 'unheard' ELSE event_type END AS event_type FROM events),
""" + CHI.replace("UNPIVOT (value FOR feature IN (l_returnflag, l_linestatus))", "UNPIVOT (value FOR feature IN (event_type))") + " SELECT feature, round(x, 6) AS distance, CAST(dof AS BIGINT) AS dof FROM chi")
def chi2_new_category(spark, d):
    """A category that the reference doesn't know."""
    e = events_pair(spark, d)
    new = F.when((F.col("is_ref") == 0) & (F.col("event_id") % 10 == 0), "unheard").otherwise(F.col("event_type"))
    return univariate.chi2_statistic(e.withColumn("event_type", new), ["event_type"]).select("feature", r6("distance").alias("distance"), F.col("dof").cast("long").alias("dof"))


@query(f"{REPORT} SELECT feature, round(distance, 6) AS distance, round(p_val, 6) AS p_val, test FROM rep")
def tabular_report(spark, d):
    """KS on numeric and chi-squared on categorical features of the lines."""
    return univariate.tabular(lineitem_pair(spark, d), NUMERIC, FLAGS).select("feature", r6("distance").alias("distance"), r6("p_val").alias("p_val"), "test")


@query(f"{REPORT} SELECT feature, CAST(p_val < 0.05 AS INTEGER) AS is_drift FROM rep")
def feature_drift(spark, d):
    return univariate.feature_decision(univariate.tabular(lineitem_pair(spark, d), NUMERIC, FLAGS)).select("feature", "is_drift")


@query(f"{REPORT} SELECT round(min(p_val), 6) AS p_val, round(0.05 / count(*), 6) AS threshold, CAST(min(p_val) < 0.05 / count(*) AS INTEGER) AS is_drift FROM rep")
def bonferroni_decision(spark, d):
    out = univariate.batch_decision(univariate.tabular(lineitem_pair(spark, d), NUMERIC, FLAGS))
    return out.select(r6("p_val").alias("p_val"), r6("threshold").alias("threshold"), "is_drift")


@query(f"{REPORT}, s AS (SELECT p_val, row_number() OVER (ORDER BY p_val) AS i, count(*) OVER () AS n FROM rep) SELECT round(max(CASE WHEN p_val < 0.5 * i / n THEN 0.5 * i / n END), 6) AS threshold, CAST(coalesce(max(CASE WHEN p_val < 0.5 * i / n THEN 1 END), 0) AS INTEGER) AS is_drift FROM s")
def fdr_decision(spark, d):
    out = univariate.batch_decision(univariate.tabular(lineitem_pair(spark, d), NUMERIC, FLAGS), 0.5, "fdr")
    return out.select(r6("threshold").alias("threshold"), "is_drift")


TEXT_LONG = """num AS (SELECT CAST(source IN ('src0', 'src1', 'src2', 'src3', 'src4') AS BIGINT) AS is_ref, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS value FROM documents
UNION ALL SELECT CAST(source IN ('src0', 'src1', 'src2', 'src3', 'src4') AS BIGINT), 'n_lines', CAST(len(text) - len(replace(text, chr(10), '')) AS DOUBLE) FROM documents)"""


@query(f"WITH {TEXT_LONG}, {ECDF} SELECT feature, round(d, 6) AS distance FROM ks")
def text_drift(spark, d):
    """Length features of documents, by source."""
    t = table(spark, d, "documents")
    lines = (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))).cast("double")
    pair = t.select(F.col("n_chars").cast("double").alias("n_chars"), lines.alias("n_lines"), F.col("source").isin(*[f"src{i}" for i in range(5)]).cast("int").alias("is_ref"))
    return univariate.ks_statistic(pair, ["n_chars", "n_lines"]).select("feature", r6("distance").alias("distance"))


@query("""WITH num AS (SELECT CAST(ts < TIMESTAMP '2024-01-16' AS BIGINT) AS is_ref, event_type AS feature, value FROM events), """ + ECDF + " SELECT feature AS segment, 'value' AS feature, round(d, 6) AS distance FROM ks")
def ks_by_segment(spark, d):
    """A statistic per event type, in one plan."""
    return univariate.by_segment(events_pair(spark, d), "event_type", ["value"]).select("segment", "feature", r6("distance").alias("distance"))


# -- thresholds ----------------------------------------------------------------


@query("SELECT round(quantile_cont(l_extendedprice, 0.95), 6) AS threshold FROM lineitem")
def threshold_percentile(spark, d):
    return thresholds.percentile_threshold(table(spark, d, "lineitem"), "l_extendedprice", 95).select(r6("threshold").alias("threshold"))


@query("WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem) SELECT round(v, 6) AS threshold FROM s WHERE i = ceil((n - 1) * (1 - 0.05))")
def threshold_higher(spark, d):
    return thresholds.higher_threshold(table(spark, d, "lineitem"), "l_extendedprice", 0.05).select(r6("threshold").alias("threshold"))


@query("WITH v AS (SELECT c_acctbal AS s FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, round((1 + (SELECT count(*) FROM v WHERE v.s > c.c_acctbal)) / CAST((SELECT count(*) FROM v) AS DOUBLE), 6) AS p_value FROM customer c WHERE c_custkey % 2 = 1")
def empirical_p_value(spark, d):
    c = table(spark, d, "customer")
    out = thresholds.empirical_p_value(c.where("c_custkey % 2 = 1"), c.where("c_custkey % 2 = 0"), "c_acctbal")
    return out.select("c_custkey", r6("p_value").alias("p_value"))


def _quantile_sql(shift: str) -> str:
    return f"WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders), w AS (SELECT max(n) * 0.37 + {shift} - 1 AS spot FROM s) SELECT round(a.v + (spot - floor(spot)) * (b.v - a.v), 6) AS quantile FROM w JOIN s a ON a.i = floor(spot) JOIN s b ON b.i = floor(spot) + 1"


def _quantile(kind: int):
    def run(spark, d):
        return thresholds.quantile(table(spark, d, "orders"), "o_totalprice", 0.37, kind).select(r6("quantile").alias("quantile"))

    return run


for _kind, _shift in ((6, "0.37"), (7, "0.63"), (8, "(0.37 + 1) / 3.0")):
    query(_quantile_sql(_shift), name=f"quantile_type{_kind}")(_quantile(_kind))


@query("SELECT round(avg(CAST((quality = 1) = (n_chars > 1500) AS INTEGER)), 6) AS accuracy FROM labels JOIN documents USING (doc_id)")
def accuracy(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("told", (F.col("n_chars") > 1500).cast("int"))
    return learned.accuracy(j, "quality", "told").select(r6("accuracy").alias("accuracy"))


# -- uncertainty ---------------------------------------------------------------

SOFT = """p AS (SELECT vec_id, [CAST(x AS DOUBLE) * 8 FOR x IN embedding[1:5]] AS z FROM embeddings),
q AS (SELECT vec_id, [exp(x - list_max(z)) FOR x IN z] AS e FROM p), s AS (SELECT vec_id, [x / list_sum(e) FOR x IN e] AS p FROM q)"""


def probabilities(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", C.softmax(F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 5), lambda x: x * 8)).alias("p"))


@query(f"WITH {SOFT} SELECT vec_id, round(list_sum([-x * ln(x) FOR x IN p]), 6) AS entropy FROM s")
def entropy_uncertainty(spark, d):
    return probabilities(spark, d).select("vec_id", r6(learned.classifier_uncertainty("p")).alias("entropy"))


@query(f"WITH {SOFT}, t AS (SELECT vec_id, list_reverse_sort(p) AS p FROM s) SELECT vec_id, CAST(p[1] - p[2] < 0.1 AS INTEGER) AS margin FROM t")
def margin_uncertainty(spark, d):
    return probabilities(spark, d).select("vec_id", learned.classifier_uncertainty("p", "margin").alias("margin"))


@query("WITH e AS (SELECT vec_id, unnest(embedding[1:16])::DOUBLE AS x FROM embeddings) SELECT vec_id, round(stddev_pop(x), 6) AS uncertainty FROM e GROUP BY vec_id")
def regressor_uncertainty(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", r6(learned.regressor_uncertainty(F.slice(F.col("embedding").cast("array<double>"), 1, 16))).alias("uncertainty"))


@query(f"WITH {SOFT}, num AS (SELECT 'uncertainty' AS feature, list_sum([-x * ln(x) FOR x IN p]) AS value, CAST(vec_id % 2 = 0 AS BIGINT) AS is_ref FROM s), {ECDF} SELECT feature, round(d, 6) AS distance FROM ks")
def classifier_uncertainty_drift(spark, d):
    p = probabilities(spark, d).withColumn("is_ref", (F.col("vec_id") % 2 == 0).cast("int"))
    return learned.classifier_uncertainty_drift(p, "p").select("feature", r6("distance").alias("distance"))


@query("WITH e AS (SELECT vec_id, unnest(embedding[1:16])::DOUBLE AS x FROM embeddings), num AS (SELECT 'uncertainty' AS feature, stddev_pop(x) AS value, CAST(vec_id % 2 = 0 AS BIGINT) AS is_ref FROM e GROUP BY vec_id), " + ECDF + " SELECT feature, round(d, 6) AS distance FROM ks")
def regressor_uncertainty_drift(spark, d):
    e = table(spark, d, "embeddings").select(F.slice(F.col("embedding").cast("array<double>"), 1, 16).alias("e"), (F.col("vec_id") % 2 == 0).cast("int").alias("is_ref"))
    return learned.regressor_uncertainty_drift(e, "e").select("feature", r6("distance").alias("distance"))


SCORED = "sc AS (SELECT 1 - quality AS is_ref, 1 / (1 + exp(-(n_chars - 1500) / 1000.0)) AS prob FROM labels JOIN documents USING (doc_id))"


def scored(spark, d) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select((1 - F.col("quality")).cast("int").alias("is_ref"), (1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000.0))).alias("prob"))


@query(f"""WITH {SCORED}, c AS (SELECT count(*) AS n, sum(CAST((prob > 0.5) = (is_ref = 0) AS BIGINT)) AS k, greatest(sum(is_ref), sum(1 - is_ref)) AS most FROM sc),
b AS (SELECT n, k, CAST(k AS DOUBLE) / n AS acc, CAST(most AS DOUBLE) / n AS share FROM c)
SELECT round(acc, 6) AS accuracy, round(greatest(0.0, 1 - (1 - acc) / (1 - share)), 6) AS distance,
round(CASE WHEN k <= 0 THEN 1 ELSE list_sum(list_transform(range(CAST(k AS BIGINT), n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(share) + (n - i) * ln(1 - share)))) END, 6) AS p_val FROM b""")
def classifier_hard_test(spark, d):
    """A fixed score as the classifier's probability."""
    return learned.hard_test(scored(spark, d)).select(*[r6(c).alias(c) for c in ("accuracy", "distance", "p_val")])


@query(f"WITH {SCORED}, num AS (SELECT 'prob' AS feature, prob AS value, CAST(is_ref AS BIGINT) AS is_ref FROM sc), {ECDF} SELECT round(greatest(up, 0), 6) AS distance FROM ks")
def classifier_soft_test(spark, d):
    return learned.soft_test(scored(spark, d)).select(r6("distance").alias("distance"))


def _classifier(kind: str):
    def run(spark, d):
        l = table(spark, d, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
        early = F.expr(f"CAST(l_shipdate AS TIMESTAMP) < {CUT}")
        out = learned.classifier_drift(l.where(early), l.where(~early), NUMERIC, "key", kind, n_folds=3)
        return out.select(*[r6(c).alias(c) for c in ("distance", "p_val")], "is_drift")

    return run


for _kind in ("lr", "rf", "gbt"):
    query(name=f"classifier_drift_{_kind}")(_classifier(_kind))


@query("SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1000")
def update_last_n(spark, d):
    return univariate.last_rows(table(spark, d, "orders").select("o_orderkey", r6("o_totalprice").alias("o_totalprice")), 1000, "o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY substr(md5(concat_ws('|', '7', CAST(o_orderkey AS VARCHAR))), 1, 13), o_orderkey LIMIT 1000")
def update_reservoir(spark, d):
    """A uniform sample of all orders: those of least hash."""
    return univariate.reservoir(table(spark, d, "orders").select("o_orderkey"), 1000, 7, ["o_orderkey"])
