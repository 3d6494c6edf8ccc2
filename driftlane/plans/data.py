"""Queries of encodings, faults, ordered computation, streams and sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.operators import categorical, inject, preprocess, recon, timeseries, univariate
from driftlane.plans.registry import query, r6, table
from driftlane.streaming import online

PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END"


def coded(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.expr(PRIORITY).alias("code"))


@query(f"WITH c AS (SELECT o_orderkey, {PRIORITY} AS code FROM orders) SELECT o_orderkey, CAST(code = 0 AS INTEGER) AS c0, CAST(code = 1 AS INTEGER) AS c1, CAST(code = 2 AS INTEGER) AS c2, CAST(code = 3 AS INTEGER) AS c3 FROM c")
def ord2ohe(spark, d):
    return coded(spark, d).withColumn("o", categorical.ord2ohe("code", 4)).select("o_orderkey", *[F.get("o", F.lit(i)).alias(f"c{i}") for i in range(4)])


@query(f"SELECT o_orderkey, CAST({PRIORITY} AS INTEGER) AS code FROM orders")
def ohe2ord(spark, d):
    return ord2ohe(spark, d).select("o_orderkey", categorical.ohe2ord(["c0", "c1", "c2", "c3"]).alias("code"))


NUMBERS = {0: -1.5, 1: -0.25, 2: 0.5, 3: 2.0}


@query(f"WITH c AS (SELECT o_orderkey, {PRIORITY} AS code FROM orders) SELECT o_orderkey, CAST(CASE code WHEN 0 THEN -1.5 WHEN 1 THEN -0.25 WHEN 2 THEN 0.5 ELSE 2.0 END AS DOUBLE) AS num FROM c")
def ord2num(spark, d):
    return coded(spark, d).select("o_orderkey", categorical.ord2num("code", NUMBERS).alias("num"))


@query("WITH z AS (SELECT o_orderkey, o_totalprice / 100000 - 2 AS z FROM orders) SELECT o_orderkey, CAST(CASE WHEN abs(z + 1.5) <= abs(z + 0.25) AND abs(z + 1.5) <= abs(z - 0.5) AND abs(z + 1.5) <= abs(z - 2) THEN 0 WHEN abs(z + 0.25) <= abs(z - 0.5) AND abs(z + 0.25) <= abs(z - 2) THEN 1 WHEN abs(z - 0.5) <= abs(z - 2) THEN 2 ELSE 3 END AS INTEGER) AS code FROM z")
def num2ord(spark, d):
    o = table(spark, d, "orders").withColumn("z", F.col("o_totalprice") / 100000 - 2)
    return o.select("o_orderkey", categorical.num2ord("z", NUMBERS).alias("code"))


@query("WITH e AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS p FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(len(list_filter(list_distinct(q), lambda x: x < l_quantity)) AS INTEGER) AS l_quantity, CAST(len(list_filter(list_distinct(p), lambda x: x < l_extendedprice)) AS INTEGER) AS l_extendedprice FROM lineitem, e")
def discretise(spark, d):
    l = table(spark, d, "lineitem")
    out = categorical.discretise(l, categorical.bin_edges(l, ["l_quantity", "l_extendedprice"]))
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("""WITH n AS (SELECT p_brand AS c, CAST(p_size > 25 AS INTEGER) AS y, count(*) AS n FROM part GROUP BY 1, 2), g AS (SELECT c, y FROM (SELECT DISTINCT c FROM n), (SELECT DISTINCT y FROM n)),
p AS (SELECT g.c, g.y, coalesce(n.n / CAST(sum(n.n) OVER (PARTITION BY g.c) AS DOUBLE), 0) AS p FROM g LEFT JOIN n USING (c, y))
SELECT a.c AS a, b.c AS b, round(sum(abs(a.p - b.p)), 6) AS distance FROM p a JOIN p b USING (y) GROUP BY 1, 2""")
def mvdm(spark, d):
    p = table(spark, d, "part").withColumn("y", (F.col("p_size") > 25).cast("int"))
    return categorical.mvdm(p, "p_brand", "y").select("a", "b", r6("distance").alias("distance"))


@query("""WITH s AS (SELECT l_returnflag AS c, 'a' AS o, l_linestatus AS v FROM lineitem UNION ALL SELECT l_returnflag, 'b', CAST(l_linenumber AS VARCHAR) FROM lineitem), n AS (SELECT c, o, v, count(*) AS n FROM s GROUP BY 1, 2, 3),
h AS (SELECT c, o, v, n / CAST(sum(n) OVER (PARTITION BY c, o) AS DOUBLE) AS p FROM n), g AS (SELECT c, o, v FROM (SELECT DISTINCT c FROM n), (SELECT DISTINCT o, v FROM n)),
p AS (SELECT g.c, g.o, g.v, coalesce(h.p, 0) + 1e-12 AS p FROM g LEFT JOIN h USING (c, o, v))
SELECT a.c AS a, b.c AS b, round(sum(a.p * ln(a.p / b.p) + b.p * ln(b.p / a.p)), 6) AS distance FROM p a JOIN p b USING (o, v) GROUP BY 1, 2""")
def abdm(spark, d):
    return categorical.abdm(table(spark, d, "lineitem"), "l_returnflag", ["l_linestatus", "l_linenumber"]).select("a", "b", r6("distance").alias("distance"))


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS scaled, round((l_quantity - avg(l_quantity) OVER ()) / (stddev_samp(l_quantity) OVER () + 1e-12), 6) AS standard FROM lineitem")
def scale_features(spark, d):
    """Min-max scaling and standardisation, by one aggregate each."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("scaled"), F.col("l_quantity").alias("standard"))
    out = preprocess.standardise(preprocess.scale_minmax(l, ["scaled"]), ["standard"])
    return out.select("l_orderkey", "l_linenumber", r6("scaled").alias("scaled"), r6("standard").alias("standard"))


# -- faults --------------------------------------------------------------------


def _uniform(seed: int, key: str) -> str:
    """SQL of the number that a key and a seed give."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0)"


def _normal(seed: int, key: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_uniform(seed, key)})) * cos(2 * pi() * {_uniform(seed + 7919, key)}))"


@query(f"""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, stddev_pop(l_quantity) OVER () AS dev, count(*) OVER () AS n FROM lineitem),
p AS (SELECT *, row_number() OVER (ORDER BY {_uniform(5, 'id')}, id) <= floor(n * 0.1) AS hit, {_normal(6, 'id')} AS r FROM l)
SELECT id, CAST(hit AS INTEGER) AS is_outlier, round(CASE WHEN hit THEN x + sign(r) * greatest(abs(r * 3), 1) * dev ELSE x END, 4) AS l_quantity FROM p""")
def inject_tabular(spark, d):
    """A tenth of the rows, chosen and moved by a hash of their key."""
    l = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity")
    return inject.inject_tabular(l, ["l_quantity"], 10, 3, 1, "id", 5).select("id", "is_outlier", F.round("l_quantity", 4).alias("l_quantity"))


@query(f"""WITH l AS (SELECT event_id, value AS x, stddev_pop(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS dev, count(*) OVER () AS n FROM events),
p AS (SELECT *, row_number() OVER (ORDER BY {_uniform(0, 'event_id')}, event_id) <= floor(n * 0.1) AS hit, {_normal(1, 'event_id')} AS r FROM l)
SELECT event_id, CAST(hit AS INTEGER) AS is_outlier, round(CASE WHEN hit THEN x + sign(r) * greatest(abs(r * 3), 1) * dev ELSE x END, 4) AS value FROM p""")
def inject_ts(spark, d):
    out = inject.inject_ts(table(spark, d, "events").select("event_id", "user_id", "value"), "value", "event_id", 10, 3, 1, series="user_id")
    return out.select("event_id", "is_outlier", F.round("value", 4).alias("value"))


@query(f"""WITH l AS (SELECT o_orderkey, {PRIORITY} AS code, count(*) OVER () AS n FROM orders), p AS (SELECT *, row_number() OVER (ORDER BY {_uniform(0, 'o_orderkey')}, o_orderkey) <= floor(n * 0.2) AS hit FROM l)
SELECT o_orderkey, CAST(hit AS INTEGER) AS is_outlier, CAST(CASE WHEN hit THEN CASE WHEN code < 2 THEN 3 ELSE 0 END ELSE code END AS INTEGER) AS code FROM p""")
def inject_categorical(spark, d):
    return inject.inject_categorical(coded(spark, d), "code", {0: 3, 1: 3, 2: 0, 3: 0}, 20, "o_orderkey").select("o_orderkey", "is_outlier", "code")


@query(f"WITH c AS (SELECT o_orderkey, {PRIORITY} AS code FROM orders) SELECT o_orderkey, CAST(CASE WHEN {_uniform(1, 'o_orderkey')} < 0.3 THEN (code + 1 + CAST(floor({_uniform(2, 'o_orderkey')} * 3) AS INTEGER)) % 4 ELSE code END AS INTEGER) AS code FROM c")
def mutate_categorical(spark, d):
    return coded(spark, d).select("o_orderkey", inject.mutate("code", 0.3, 3, "o_orderkey", 1).alias("code"))


@query(f"""WITH n AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic), w AS (SELECT toxic, n, CASE WHEN toxic = 1 THEN 60 ELSE 140 END AS want FROM n),
c AS (SELECT doc_id, toxic, want, unnest(range(1, CAST(ceil(want / CAST(n AS DOUBLE)) AS BIGINT) + 1)) AS copy FROM labels JOIN w USING (toxic)),
r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY copy, {_uniform(0, 'doc_id')}, doc_id) AS k FROM c) SELECT doc_id, toxic FROM r WHERE k <= want""")
def outlier_batch(spark, d):
    return inject.outlier_batch(table(spark, d, "labels"), "toxic", 200, 30, "doc_id").select("doc_id", "toxic")


PIXELS = "p AS (SELECT vec_id, [least(greatest((x + 0.5) * 255, 0), 255) / 255 FOR x IN CAST(embedding AS DOUBLE[])] AS u FROM embeddings)"


def images(spark, d) -> DataFrame:
    """Vectors as images of 8 by 8."""
    data = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.least(F.greatest((x + 0.5) * 255, F.lit(0.0)), F.lit(255.0)))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), data.alias("data"))
    return table(spark, d, "embeddings").select("vec_id", image.alias("image"))


def _pixels(df: DataFrame) -> DataFrame:
    """The sum of a corrupted image, weighted by place, and two of its pixels."""
    data = F.col("image.data")
    total = F.aggregate(F.transform(data, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", F.round(total, 4).alias("weighted"), F.round(F.get(data, F.lit(0)), 6).alias("first"), F.round(F.get(data, F.lit(63)), 6).alias("last"))


_PIXELS = "SELECT vec_id, round(list_sum([y[i] * i FOR i IN range(1, 65)]) * 255, 4) AS weighted, round(y[1] * 255, 6) AS first, round(y[64] * 255, 6) AS last FROM"


@query(f"WITH {PIXELS}, c AS (SELECT vec_id, [least(greatest((x - list_avg(u)) * 0.4 + list_avg(u), 0), 1) FOR x IN u] AS y FROM p) {_PIXELS} c")
def corrupt_images(spark, d):
    """Less contrast."""
    return _pixels(inject.corrupt(images(spark, d), "contrast", 0.4, "vec_id"))


#: A pixel of the 8 by 8 image; places beyond an edge are mirrored at it.
_AT = "u[8 * (CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} > 7 THEN 15 - ({i}) ELSE {i} END) + (CASE WHEN {j} < 0 THEN -1 - ({j}) WHEN {j} > 7 THEN 15 - ({j}) ELSE {j} END) + 1]"
_TAP = f"exp(-0.5 * (((a - 2) / 0.5) ** 2 + ((b - 2) / 0.5) ** 2)) * {_AT.format(i='(k // 8 + a - 2)', j='(k % 8 + b - 2)')}"


@query(f"""WITH {PIXELS}, g AS (SELECT sum(exp(-0.5 * (a / 0.5) ** 2)) AS s FROM range(-2, 3) t(a)),
c AS (SELECT vec_id, list_transform(range(0, 64), lambda k: list_sum(flatten(list_transform(range(0, 5), lambda a: list_transform(range(0, 5), lambda b: {_TAP})))) / (s * s)) AS y FROM p, g) {_PIXELS} c""")
def blur_images(spark, d):
    """A Gaussian blur, edges mirrored."""
    return _pixels(inject.corrupt(images(spark, d), "gaussian_blur", 0.5, "vec_id"))


# -- ordered computation -------------------------------------------------------


@query("SELECT event_id, round(stddev_pop(value) OVER w, 6) AS dev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)")
def local_deviation(spark, d):
    return table(spark, d, "events").select("event_id", r6(timeseries.local_deviation("value", "event_id", 5, 4, "user_id")).alias("dev"))


@query("SELECT event_id, CAST(sum(CAST(value > 40 AS BIGINT)) OVER w AS BIGINT) AS ones FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def fet_window_sums(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("value") > 40).cast("long").alias("bit"))
    return timeseries.last_sums(e, "bit", "event_id", 10, "user_id", "ones").select("event_id", "ones")


@query("WITH n AS (SELECT user_id, value, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, value, n, round(CAST(sum(n) OVER (PARTITION BY user_id ORDER BY value) AS DOUBLE) / sum(n) OVER (PARTITION BY user_id), 6) AS ecdf FROM n")
def running_ecdf(spark, d):
    return univariate.ecdf(table(spark, d, "events"), "value", "user_id").select(F.col("series").alias("user_id"), "value", "n", r6("ecdf").alias("ecdf"))


@query("""WITH n AS (SELECT user_id, value AS x, lead(value) OVER w AS y, row_number() OVER w - 1 AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT user_id AS series, i // 4 AS "window", sum(x) AS sx, sum(y) AS sy, count(*) AS k FROM n GROUP BY 1, 2) SELECT series, "window", round(sx, 6) AS sum_values, round(sy, 6) AS sum_targets FROM g WHERE k = 4""")
def sequence_windows(spark, d):
    w = timeseries.windows(table(spark, d, "events"), "value", "event_id", 4, "user_id")
    add = lambda c: F.aggregate(F.filter(c, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    return w.select("series", "window", r6(add("values")).alias("sum_values"), r6(add("targets")).alias("sum_targets"))


def _day(ts: str):
    """Days since 1970 of a time without zone, whatever the session's zone."""
    return F.datediff(F.col(ts), F.lit("1970-01-01").cast("date"))


def daily(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy((_day("ts") * 24 + F.hour("ts")).alias("hour")).agg(F.avg("value").alias("value"))


#: The whole method on hourly means: ten estimated points, the transform written out, local means of ten log
#: amplitudes with mirrored ends, the transform back, and the mean of ten earlier saliencies with a mirrored start.
RESIDUAL = """x AS (SELECT row_number() OVER (ORDER BY hour) - 1 AS i, hour, x FROM (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, avg(value) AS x FROM events GROUP BY 1)),
n AS (SELECT count(*) AS n FROM x), z AS (SELECT i, hour, x FROM x, n WHERE i = n - 1),
est AS (SELECT max(CASE WHEN x.i = n - 5 THEN x.x END) + avg(CASE WHEN x.i >= n - 6 AND x.i < n - 1 THEN (z.x - x.x) / (z.hour - x.hour) END) * avg(CASE WHEN x.i >= n - 6 AND x.i < n - 1 THEN z.hour - x.hour END) AS e FROM x, n, z),
y AS (SELECT i, x AS y FROM x UNION ALL SELECT n + k, e FROM n, est, range(0, 10) t(k)), m AS (SELECT count(*) AS m FROM y),
f AS (SELECT t.k, sum(y * cos(2 * pi() * t.k * i / m)) AS re, -sum(y * sin(2 * pi() * t.k * i / m)) AS im FROM y, m, range(0, 100000) t(k) WHERE t.k < m GROUP BY t.k),
l AS (SELECT k, re, im, sqrt(re * re + im * im) AS amp, ln(sqrt(re * re + im * im) + 1e-8) AS lg FROM f),
h AS (SELECT m, (m - 1 + 1) // 2 AS half FROM m),
pos AS (SELECT k - 1 AS j, lg FROM l, h WHERE k BETWEEN 1 AND half),
pad AS (SELECT j + 5 AS j, lg FROM pos UNION ALL SELECT 5 - j, lg FROM pos WHERE j BETWEEN 1 AND 5 UNION ALL SELECT 5 + half - 1 + (half - 1 - j), lg FROM pos, h WHERE half - 1 - j BETWEEN 1 AND 4),
sm AS (SELECT a.j, sum(b.lg) / 10 AS s FROM pos a JOIN pad b ON b.j BETWEEN a.j AND a.j + 9 GROUP BY a.j),
av AS (SELECT k, CASE WHEN k = 0 THEN lg ELSE s END AS a FROM l, h LEFT JOIN sm ON sm.j = CASE WHEN k <= half THEN k - 1 WHEN (m - 1) % 2 = 1 THEN m - 1 - k ELSE m - k - 1 END),
r AS (SELECT k, exp(lg - a) * re / amp AS re, exp(lg - a) * im / amp AS im FROM l JOIN av USING (k)),
s AS (SELECT y.i, sqrt(sum(re * cos(2 * pi() * k * y.i / m) - im * sin(2 * pi() * k * y.i / m)) ** 2 + sum(re * sin(2 * pi() * k * y.i / m) + im * cos(2 * pi() * k * y.i / m)) ** 2) / max(m) AS s FROM y, m, n, r WHERE y.i < n GROUP BY y.i),
q AS (SELECT i + 10 AS j, s FROM s UNION ALL SELECT 10 - i, s FROM s WHERE i BETWEEN 1 AND 10),
lm AS (SELECT s.i, sum(q.s) / 10 AS m FROM s JOIN q ON q.j BETWEEN s.i AND s.i + 9 GROUP BY s.i)
SELECT hour, round((s.s - lm.m) / (lm.m + 1e-8), 4) AS score FROM s JOIN lm USING (i) JOIN x USING (i)"""


@query(f"WITH {RESIDUAL}")
def spectral_residual(spark, d):
    """Scores of the hourly means of the events."""
    out = timeseries.spectral_residual(daily(spark, d), "value", "hour", window_amp=10, window_local=10)
    return out.select(F.col("t").cast("long").alias("hour"), (F.round("score", 4) + 0.0).alias("score"))


@query("""WITH s AS (SELECT CAST(floor(epoch(o_orderdate) / 86400) AS DOUBLE) AS ds, avg(o_totalprice) AS y FROM orders GROUP BY 1), f AS (SELECT regr_slope(y, ds) AS b, regr_intercept(y, ds) AS a, sqrt(regr_syy(y, ds) * (1 - regr_r2(y, ds)) / count(*)) AS sd FROM s WHERE ds < 10400),
p AS (SELECT ds, y, a + b * ds AS yhat, 1.2815515655446004 * sd AS h FROM s, f WHERE ds >= 10400) SELECT CAST(ds AS BIGINT) AS ds, round(yhat, 3) AS yhat, round(CASE WHEN y >= yhat THEN y - (yhat + h) ELSE yhat - h - y END, 3) AS score, CAST(CASE WHEN y >= yhat THEN y > yhat + h ELSE y < yhat - h END AS INTEGER) AS is_outlier FROM p""")
def forecast_interval_score(spark, d):
    o = table(spark, d, "orders")
    s = o.groupBy(_day("o_orderdate").cast("double").alias("ds")).agg(F.avg("o_totalprice").alias("y"))
    out = timeseries.trend_forecast(s.where("ds < 10400"), s.where("ds >= 10400"))
    return out.select(F.col("ds").cast("long").alias("ds"), F.round("yhat", 3).alias("yhat"), F.round("score", 3).alias("score"), "is_outlier")


@query()
def seasonal_forecast_score(spark, d):
    o = table(spark, d, "orders")
    s = o.groupBy(F.col("o_orderstatus").alias("series"), _day("o_orderdate").cast("double").alias("ds")).agg(F.avg("o_totalprice").alias("y"))
    out = timeseries.seasonal_forecast(s.where("ds < 10400"), s.where("ds >= 10400"))
    return out.select("series", F.col("ds").cast("long").alias("ds"), F.round("yhat", 3).alias("yhat"), F.round("score", 3).alias("score"), "is_outlier")


@query()
def recurrent_forecast_error(spark, d):
    out = timeseries.sequence_errors(table(spark, d, "events").withColumn("series", F.col("user_id") % 8), "value", "event_id", "series", 10, epochs=10)
    return out.select("series", "window", "step", r6("error").alias("error"), r6("estimate").alias("estimate"))


@query()
def sequence_forecast_error(spark, d):
    out = timeseries.forecast_errors(table(spark, d, "events").withColumn("series", F.col("user_id") % 8), "value", "event_id", "series", 5)
    return out.select("series", F.col("t").cast("long").alias("event_id"), r6("error").alias("error"))


# -- sequences -----------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, lang, string_split(text, '') AS s FROM documents), g AS (SELECT doc_id, lang, unnest(s[1:len(s) - 1]) AS a, unnest(s[2:len(s)]) AS b FROM t),
bc AS (SELECT a, b, count(*) AS c FROM g GROUP BY 1, 2), bg AS (SELECT a, b, ln((c + 1.0) / (sum(c) OVER (PARTITION BY a) + (SELECT count(DISTINCT b) FROM bc))) AS p FROM bc),
sc AS (SELECT a, b, count(*) AS c FROM g WHERE lang = 'en' GROUP BY 1, 2), sg AS (SELECT a, b, ln((c + 1.0) / (sum(c) OVER (PARTITION BY a) + (SELECT count(DISTINCT b) FROM sc))) AS p FROM sc)
SELECT doc_id, round(-sum(coalesce(sg.p, -20) - coalesce(bg.p, -20)), 3) AS score FROM g LEFT JOIN sg USING (a, b) LEFT JOIN bg USING (a, b) GROUP BY doc_id""")
def llr_char_bigram(spark, d):
    """Likelihood ratio of English character pairs against those of all documents."""
    docs = table(spark, d, "documents")
    semantic = recon.bigram_model(recon.pair_counts(docs.where("lang = 'en'"), "text"))
    background = recon.bigram_model(recon.pair_counts(docs, "text"))
    return recon.likelihood_ratio(docs, semantic, background).select("doc_id", (F.round("score", 3) + 0.0).alias("score"))


# -- online --------------------------------------------------------------------


def arrivals(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "value", (F.col("value") > 40).cast("int").alias("bit"), (F.col("user_id") % 4).alias("key"))


#: Rows on which an online detector is fitted at most, drawn by hash: it keeps them, or their kernel matrix.
REFERENCE = 2000


def _reference(spark, d, column: str) -> np.ndarray:
    """A column of the users of even number."""
    e = table(spark, d, "events").where("user_id % 2 = 0").select("event_id", "value", (F.col("value") > 40).cast("int").alias("bit"))
    return np.array([r[0] for r in e.orderBy(F.xxhash64("event_id"), "event_id").select(column).limit(REFERENCE).collect()], float)


def _stream(spark, d) -> DataFrame:
    """Those of odd number, in four streams."""
    e = table(spark, d, "events").where("user_id % 2 = 1")
    return e.select("event_id", "value", (F.col("value") > 40).cast("int").alias("bit"), (F.floor(F.col("user_id") / 2) % 4).alias("key"))


def _out(df: DataFrame) -> DataFrame:
    return df.select("key", "seq", "time", r6("test_stat").alias("test_stat"), r6("threshold").alias("threshold"), "is_drift")


def _stat(df: DataFrame) -> DataFrame:
    return df.where(F.col("test_stat").isNotNull() & ~F.isnan("test_stat")).select("key", "seq", r6("test_stat").alias("test_stat"))


_CVM_T = """(100.0 * {w} / (100 + {w}) ** 2 * (list_sum(list_transform(range(1, 101), lambda i: (i / 100.0 - len(list_filter(x{w}, lambda y: y <= i)) / {w}.0) ** 2))
 + list_sum(list_transform(range(1, {w} + 1), lambda j: (least(100, greatest(0, floor(list_sort(x{w})[j]))) / 100.0 - j / {w}.0) ** 2))) - (1 + 1 / (100.0 + {w})) / 6)
 / sqrt((101.0 + {w}) * (4 * 100.0 * {w} * (100 + {w}) - 3 * (10000.0 + {w} * {w}) - 200.0 * {w}) / (45 * (100.0 + {w}) ** 2 * 400 * {w}))"""


@query(f"""WITH e AS (SELECT CAST(user_id % 4 AS VARCHAR) AS key, event_id AS seq, row_number() OVER w AS t, list(value) OVER (w ROWS 4 PRECEDING) AS x5, list(value) OVER (w ROWS 9 PRECEDING) AS x10 FROM events WINDOW w AS (PARTITION BY user_id % 4 ORDER BY event_id))
SELECT key, seq, round(CASE WHEN t >= 10 THEN greatest({_CVM_T.format(w=5)}, {_CVM_T.format(w=10)}) ELSE {_CVM_T.format(w=5)} END, 6) + 0.0 AS test_stat FROM e WHERE t >= 5""")
def cvm_online_statistic(spark, d):
    """The largest statistic of two windows against the reference 1, 2, .., 100."""
    det = online.CVMOnline(np.arange(1.0, 101.0)[:, None], (5, 10), np.array([np.inf]))
    return _stat(online.replay(arrivals(spark, d), det, ["value"], "event_id", "key"))


@query("""WITH a AS (SELECT CAST(user_id % 4 AS VARCHAR) AS key, event_id AS seq, row_number() OVER w AS t, CAST(sum(CAST(value > 40 AS BIGINT)) OVER (w ROWS 19 PRECEDING) AS BIGINT) AS ones FROM events WINDOW w AS (PARTITION BY user_id % 4 ORDER BY event_id)),
o AS (SELECT DISTINCT ones, list_sum(list_transform(range(0, ones), lambda k: exp(lgamma(101 + ones) - lgamma(k + 1) - lgamma(101 + ones - k) + lgamma(171 - ones) - lgamma(21 - k) - lgamma(151 - ones + k) - (lgamma(271) - lgamma(21) - lgamma(251))))) AS v FROM a WHERE t >= 20),
v AS (SELECT key, seq, t, coalesce(v, 0) AS v FROM a JOIN o USING (ones) WHERE t >= 20), l AS (SELECT key, seq, t, list_reverse(list(v) OVER (PARTITION BY key ORDER BY t ROWS 9 PRECEDING)) AS l FROM v)
SELECT key, seq, round(list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i] * 0.01 ** (i - 1) * CASE WHEN i = t - 19 THEN 1 ELSE 0.99 END)), 6) AS test_stat FROM l""")
def fet_online_statistic(spark, d):
    """The smoothed 1 - p of the last twenty bits against 100 ones of 250."""
    det = online.FETOnline((100,), 250, (20,), np.full((1, 1), np.inf))
    return _stat(online.replay(arrivals(spark, d), det, ["bit"], "event_id", "key"))


@query()
def cvm_online_replay(spark, d):
    det = online.CVMOnline.fit(spark, _reference(spark, d, "value"), [10, 20], 150, runs=400)
    return _out(online.replay(_stream(spark, d), det, ["value"], "event_id", "key"))


@query()
def fet_online_replay(spark, d):
    det = online.FETOnline.fit(spark, _reference(spark, d, "bit"), [20], 150, runs=300)
    return _out(online.replay(_stream(spark, d), det, ["bit"], "event_id", "key"))


def _vector_halves(spark, d) -> tuple[np.ndarray, DataFrame]:
    """The vectors of even number as the reference, the others as the stream."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    ref = e.where("vec_id % 2 = 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(REFERENCE).collect()
    return np.array([r.x for r in ref]), e.where("vec_id % 2 = 1")


@query()
def mmd_online_replay(spark, d):
    ref, stream = _vector_halves(spark, d)
    return _out(online.replay(stream, online.MMDOnline.fit(spark, ref, 10, 50, runs=300), ["x"], "vec_id"))


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), r AS (SELECT x FROM v WHERE id % 2 = 0),
s AS (SELECT id, x, row_number() OVER (ORDER BY id) AS t FROM v WHERE id % 2 = 1),
xx AS (SELECT (sum(exp(-(list_distance(a.x, b.x) ** 2) / 2)) - (SELECT count(*) FROM r)) / CAST((SELECT count(*) FROM r) * ((SELECT count(*) FROM r) - 1) AS DOUBLE) AS xx FROM r a, r b),
c AS (SELECT t, sum(exp(-(list_distance(s.x, r.x) ** 2) / 2)) AS k FROM s, r GROUP BY t),
y AS (SELECT e.t, sum(exp(-(list_distance(a.x, b.x) ** 2) / 2)) - 10 AS yy FROM s e JOIN s a ON a.t BETWEEN e.t - 9 AND e.t JOIN s b ON b.t BETWEEN e.t - 9 AND e.t WHERE e.t >= 10 GROUP BY e.t)
SELECT s.id AS seq, round(xx + yy / 90 - 2 * (SELECT sum(k) FROM c WHERE c.t BETWEEN y.t - 9 AND y.t) / (10.0 * (SELECT count(*) FROM r)), 9) AS test_stat FROM y JOIN s USING (t), xx""")
def mmd_online_statistic(spark, d):
    """The distance of the last ten rows to the whole reference, at a set bandwidth."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    out = online.mmd_statistic(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "embedding", "vec_id", 1.0, 10)
    return out.select("seq", (F.round("test_stat", 9) + 0.0).alias("test_stat"))


@query("""WITH v AS (SELECT vec_id, list_sum(CAST(embedding[1:32] AS DOUBLE[])) AS x, list_sum(CAST(embedding[33:64] AS DOUBLE[])) AS y FROM embeddings),
m AS (SELECT vec_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, var_samp(x) OVER w AS a, covar_samp(x, y) OVER w AS b, var_samp(y) OVER w AS c, row_number() OVER (ORDER BY vec_id) AS t FROM v WINDOW w AS (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT vec_id AS seq, round((c * x * x - 2 * b * x * y + a * y * y) / (a * c - b * b), 6) AS test_stat FROM m WHERE t > 10""")
def mahalanobis_online_statistic(spark, d):
    """Distances of the halves' sums to their running mean."""
    half = lambda a: F.aggregate(F.slice(F.col("embedding").cast("array<double>"), a, 32), F.lit(0.0), lambda s, x: s + x)
    e = table(spark, d, "embeddings").select("vec_id", half(1).alias("a"), half(33).alias("b"))
    det = online.MahalanobisOnline(n_components=2, start_clip=1 << 60)
    return online.replay(e, det, ["a", "b"], "vec_id").where("time > 10").select("seq", r6("test_stat").alias("test_stat"))


@query()
def lsdd_online_replay(spark, d):
    ref, stream = _vector_halves(spark, d)
    return _out(online.replay(stream, online.LSDDOnline.fit(spark, ref, 10, 50, runs=300), ["x"], "vec_id"))


@query()
def mahalanobis_online_replay(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return _out(online.replay(e, online.MahalanobisOnline(threshold=100.0), ["x"], "vec_id"))
