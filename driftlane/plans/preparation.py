"""Queries of what goes before a detector, and of set operations on samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlane.functions import columns as C
from driftlane.operators import categorical, kernels, preprocess, univariate
from driftlane.plans.registry import query, r6, table
from driftlane.sources import readers


ENCODER = preprocess.untrained_encoder(64, 8)


def _layers_sql(model: preprocess.Layers) -> str:
    """Expressions of a stack of layers, one table each."""
    tables, source = ["l0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"], "l0"
    for i, (w, b) in enumerate(model.params, start=1):
        rows = ", ".join(f"[{', '.join(map(repr, row))}]" for row in w.T.tolist())
        tables.append(f"w{i} AS (SELECT [{rows}] AS w, [{', '.join(map(repr, b.tolist()))}] AS b)")
        one = "list_inner_product(x, w[j]) + b[j]"
        one = one if i == len(model.params) else f"greatest(0, {one})"
        tables.append(f"l{i} AS (SELECT vec_id, list_transform(range(1, {len(b) + 1}), lambda j: {one}) AS x FROM {source}, w{i})")
        source = f"l{i}"
    return "WITH " + ", ".join(tables)


@query(_layers_sql(ENCODER) + " SELECT vec_id, " + ", ".join(f"round(x[{i + 1}], 6) AS e{i}" for i in range(8)) + " FROM l3")
def untrained_encoder(spark, d):
    e = preprocess.apply_model(table(spark, d, "embeddings"), ENCODER, "embedding")
    return e.select("vec_id", *[r6(F.get("encoded", F.lit(i))).alias(f"e{i}") for i in range(8)])


@query(_layers_sql(ENCODER.hidden()) + " SELECT vec_id, round(list_sum(x), 6) AS total, round(list_max(x), 6) AS most FROM l2")
def hidden_output(spark, d):
    """All layers but the last; the SQL has none after it, so no ReLU follows."""
    e = preprocess.apply_model(table(spark, d, "embeddings"), ENCODER.hidden(), "embedding")
    return e.select("vec_id", r6(F.aggregate("encoded", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.array_max("encoded")).alias("most"))


@query()
def dropout_evaluations(spark, d):
    e = preprocess.dropout_evaluations(table(spark, d, "embeddings"), ENCODER, "embedding", 10, key="vec_id")
    return e.select("vec_id", *[r6(F.get("evaluations", F.lit(i))).alias(f"v{i}") for i in range(10)])


@query(_layers_sql(ENCODER) + " SELECT vec_id, round(x[1], 6) AS value, CAST(0 AS DOUBLE) AS deviation FROM l3")
def undropped_evaluations(spark, d):
    """Evaluations without dropout: all alike, the model's own output."""
    e = preprocess.dropout_evaluations(table(spark, d, "embeddings"), ENCODER, "embedding", 4, 0.0, "vec_id")
    return e.select("vec_id", r6(F.get("evaluations", F.lit(3))).alias("value"), r6(C.deviation("evaluations")).alias("deviation"))


@query("WITH m AS (SELECT vec_id, list_transform(range(1, 17), lambda i: (CAST(embedding[i] AS DOUBLE) + embedding[i + 16] + embedding[i + 32] + embedding[i + 48]) / 4) AS m FROM embeddings) SELECT vec_id, round(list_sum(m), 6) AS total, round(m[1], 6) AS first FROM m")
def layer_mean(spark, d):
    """Quarters of a vector as four layers."""
    v = F.col("embedding").cast("array<double>")
    m = table(spark, d, "embeddings").select("vec_id", preprocess.layer_mean(F.array(*[F.slice(v, a, 16) for a in (1, 17, 33, 49)])).alias("m"))
    return m.select("vec_id", r6(F.aggregate("m", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.get("m", F.lit(0))).alias("first"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), m AS (SELECT vec_id, x, list_avg(x) AS m, sqrt(list_avg([(y - list_avg(x)) ** 2 FOR y IN x])) AS s FROM v)
SELECT vec_id, round((x[1] - m) / (s + 1e-12), 6) AS first, round(list_sum([i * (x[i] - m) / (s + 1e-12) FOR i IN range(1, 65)]), 4) AS weighted FROM m""")
def scale_by_instance(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", preprocess.scale_by_instance(F.col("embedding").cast("array<double>")).alias("z"))
    weighted = F.aggregate(F.transform("z", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", r6(F.get("z", F.lit(0))).alias("first"), (F.round(weighted, 4) + 0.0).alias("weighted"))


@query("WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, round(-1 + 2 * (value - lo) / (hi - lo), 6) AS value FROM events, m")
def scale_minmax(spark, d):
    return preprocess.scale_minmax(table(spark, d, "events").select("event_id", "value"), ["value"], -1, 1).select("event_id", r6("value").alias("value"))


@query("SELECT toxic, count(*) AS n, CAST(sum(quality) AS BIGINT) AS quality FROM labels GROUP BY toxic")
def split_by_label(spark, d):
    normal, outlier = preprocess.split_by_label(table(spark, d, "labels"), "toxic")
    return normal.unionByName(outlier).groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("quality"))


@query("SELECT DISTINCT lang AS category FROM documents UNION SELECT DISTINCT event_type FROM events")
def category_domain(spark, d):
    """Union of the values of two samples."""
    return univariate.category_union(table(spark, d, "documents").select("lang"), table(spark, d, "events").select("event_type"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def held_out_rows(spark, d):
    """Rows of a sample that another leaves."""
    return preprocess.without(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


#: With two classes the categories lie on a line, by the share of one class.
LINE = """n AS (SELECT {c} AS c, avg(CAST({y} AS DOUBLE)) AS p FROM {t} GROUP BY 1), f AS (SELECT avg(p) AS m FROM n), far AS (SELECT p AS pf FROM n, f ORDER BY abs(p - m) DESC LIMIT 1), x AS (SELECT c, 2 * abs(p - pf) AS x FROM n, far)"""


@query("WITH " + LINE.format(c="c_mktsegment", y="c_acctbal > 0", t="customer") + " SELECT c AS category, round(x, 6) AS num FROM x")
def category_numbers(spark, d):
    """Categories with the numbers that scaling gives their distances."""
    c = table(spark, d, "customer").withColumn("y", (F.col("c_acctbal") > 0).cast("int"))
    n = categorical.multidimensional_scaling(categorical.mvdm(c, "c_mktsegment", "y"))
    return spark.createDataFrame([(k, round(v, 6) + 0.0) for k, v in n.items()], "category string, num double")


@query("WITH " + LINE.format(c="o_orderpriority", y="o_totalprice > 200000", t="orders") + ", s AS (SELECT stddev_pop(x) AS sd, max(x) AS hi, min(x) AS lo FROM x) SELECT o_orderkey, round((x - (hi + lo) / 2) / sd * 3, 6) AS priority FROM orders JOIN x ON c = o_orderpriority, s")
def encode_categories(spark, d):
    """Categories of the orders as numbers, by the classes of their price, at a set deviation."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") > 200000).cast("int").alias("y"))
    numbers = categorical.fit_categories(o, ["priority"], "mvdm", "y", std=3.0)
    return categorical.encode_categories(o, numbers).select("o_orderkey", r6("priority").alias("priority"))


@query("""WITH n AS (SELECT o_orderpriority AS c, o_orderstatus AS y, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT c, y FROM (SELECT DISTINCT c FROM n), (SELECT DISTINCT y FROM n)),
p AS (SELECT g.c, g.y, coalesce(n.n / CAST(sum(n.n) OVER (PARTITION BY g.c) AS DOUBLE), 0) AS p FROM g LEFT JOIN n USING (c, y)), d AS (SELECT a.c AS a, b.c AS b, sum(abs(a.p - b.p)) AS d FROM p a JOIN p b USING (y) GROUP BY 1, 2),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d DESC, b) AS k FROM d) SELECT a AS category, b AS farthest FROM r WHERE k = 1""")
def farthest_category(spark, d):
    return categorical.farthest_categories(categorical.mvdm(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus"))


@query("SELECT CASE user_id % 4 WHEN 0 THEN 'dos' WHEN 1 THEN 'probe' WHEN 2 THEN 'normal' END AS category, count(*) AS n FROM events GROUP BY 1")
def attack_categories(spark, d):
    """Attack types to categories, by a map."""
    e = table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, ("smurf.", "satan", "normal.", "unheard"))), (F.col("user_id") % 4 + 1).cast("int")).alias("t"))
    return e.groupBy(readers.attack_category("t").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, exp(-(list_distance(a.x, b.x) ** 2) / 2) AS k FROM v a, v b) SELECT a, round(sum(k), 6) AS total, round(max(CASE WHEN a <> b THEN k END), 6) AS nearest FROM p GROUP BY a")
def kernel_rows(spark, d):
    """Kernel values of all pairs, by tiles, added up by row."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return kernels.kernel_rows(e, e, kernels.GaussianRBF((1.0,))).select("a", r6("total").alias("total"), r6("nearest").alias("nearest"))


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, list_distance(a.x, b.x) ** 2 AS d FROM v a JOIN v b ON a.id % 50 = 0) SELECT a, b, round(exp(-d / 2), 6) AS k FROM p")
def kernel_matrix(spark, d):
    """Kernel values of a stated set of rows (every 50th) with all rows, by tiles."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return kernels.kernel_matrix(e.where("id % 50 = 0"), e, kernels.GaussianRBF((1.0,))).select("a", "b", r6("k").alias("k"))
