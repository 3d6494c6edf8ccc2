"""Categories as numbers: encodings, bins, and distances between categories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.operators.univariate import percentiles as percentiles_of


def ord2ohe(code: str | Column, n: int) -> Column:
    """One-hot array of an ordinal code from 0."""
    c = F.col(code) if isinstance(code, str) else code
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == c).cast("int"))


def ohe2ord(columns: list[str]) -> Column:
    """Ordinal code of one-hot columns; not exactly one 1 raises an error."""
    a = F.array(*[F.col(c).cast("int") for c in columns])
    ok = F.aggregate(a, F.lit(0), lambda s, x: s + x) == 1
    return F.when(ok, (F.array_position(a, 1) - 1).cast("int")).otherwise(F.raise_error(F.lit("not one-hot")).cast("int"))


def ord2num(code: str, values: dict[int, float]) -> Column:
    """Learned number of a code; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])
    return F.try_element_at(table, F.col(code).cast("int"))


def num2ord(value: str | Column, values: dict[int, float]) -> Column:
    """Code whose number is nearest; ties to the smaller code."""
    v = F.col(value) if isinstance(value, str) else value
    near = F.array_min(F.array(*[F.struct(F.abs(v - float(x)).alias("d"), F.lit(k).alias("k")) for k, x in sorted(values.items())]))
    return near["k"]


def bin_edges(df: DataFrame, features: list[str], percentiles: list[float] | None = None) -> dict[str, list[float]]:
    """Distinct percentile edges of each feature: a few numbers."""
    p = [x / 100 for x in (percentiles or [25, 50, 75])]
    found = {r.feature: r.edges for r in percentiles_of(df, features, p).collect()}
    return {f: sorted(set(found[f])) for f in features}


def discretise(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Replaces each feature by its bin: the number of edges below the value, so a
    value equal to an edge lies in the bin that ends there."""
    return df.withColumns({f: sum(((F.col(f) > float(e)).cast("int") for e in es), F.lit(0)) for f, es in edges.items()})


def bin_labels(feature: str, edges: list[float]) -> list[str]:
    names = [f"{feature} <= {edges[0]:.2f}"] + [f"{a:.2f} < {feature} <= {b:.2f}" for a, b in zip(edges, edges[1:])]
    return [*names, f"{feature} > {edges[-1]:.2f}"]


#: Categories of a feature whose distances are wanted, at most: the result has their square.
MAX_CATEGORIES = 5000


def _pairs(shares: DataFrame, keys: list[str], alone: Column, both: Column, limit: int) -> DataFrame:
    """``a, b, distance`` of all pairs of categories ``c`` with shares ``p`` of ``keys``.

    ``alone`` is what a share adds if the other category hasn't that key, ``both``
    (of pa and pb) what two shares of one key add. So only shares that are there
    meet, and each category's sum of ``alone`` stands for all its others.
    """
    own = shares.groupBy("c").agg(F.sum(alone).alias("own"))
    if (n := own.count()) > limit:
        raise ValueError(f"{n} categories, more than {limit}")
    a, b = shares.toDF("a", *keys, "pa", "ga"), shares.toDF("b", *keys, "pb", "gb")
    met = a.join(b, keys).groupBy("a", "b").agg(F.sum(both - F.col("ga") - F.col("gb")).alias("more"))
    every = own.toDF("a", "oa").crossJoin(F.broadcast(own.toDF("b", "ob")))  # the categories of one feature
    distance = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("oa") + F.col("ob") + F.coalesce("more", F.lit(0.0))))
    return every.join(met, ["a", "b"], "left").select("a", "b", distance.alias("distance"))


def mvdm(df: DataFrame, feature: str, target: str, alpha: float = 1.0, limit: int = MAX_CATEGORIES) -> DataFrame:
    """``a, b, distance``: sum over classes of |P(y|a) - P(y|b)| ** alpha for each
    pair of categories: pairs of categories, not of rows."""
    counts = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(feature).alias("c"), F.col(target).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.select("c", "y", (F.col("n") / F.sum("n").over(Window.partitionBy("c"))).alias("p"))
    return _pairs(shares.withColumn("g", F.pow("p", F.lit(alpha))), ["y"], F.col("g"), F.pow(F.abs(F.col("pa") - F.col("pb")), F.lit(alpha)), limit)


def abdm(df: DataFrame, feature: str, others: list[str], eps: float = 1e-12, limit: int = MAX_CATEGORIES) -> DataFrame:
    """``a, b, distance``: symmetric KL of P(other | category), each share ``eps``
    higher, summed over the other columns, for each pair of categories."""
    long = df.where(F.col(feature).isNotNull()).select(F.col(feature).alias("c"), F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.col(o).cast("string").alias("v")) for o in others])).alias("s")).select("c", "s.o", "s.v")
    counts = long.where("v is not null").groupBy("c", "o", "v").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.select("c", "o", "v", (F.col("n") / F.sum("n").over(Window.partitionBy("c", "o"))).alias("p"))
    pa, pb = F.col("pa") + eps, F.col("pb") + eps
    return _pairs(shares.withColumn("g", F.col("p") * F.ln(F.col("p") / eps + 1)), ["o", "v"], F.col("g"), (pa - pb) * F.ln(pa / pb), limit)


def multidimensional_scaling(distances: DataFrame, dims: int = 2) -> dict:
    """A number for each category: its distance, in a classical scaling to ``dims``
    axes, from the category that lies farthest from the origin."""
    rows = distances.collect()  # pairs of categories of one feature, whose number is bounded
    names = sorted({r.a for r in rows})
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[names.index(r.a), names.index(r.b)] = r.distance
    j = np.eye(len(names)) - 1 / len(names)
    value, vec = np.linalg.eigh(-0.5 * j @ d**2 @ j)
    lead = np.argsort(-value)[:dims]
    x = vec[:, lead] * np.sqrt(np.maximum(value[lead], 0))
    far = x[np.argmax((x**2).sum(1))]
    return dict(zip(names, np.sqrt(((x - far) ** 2).sum(1)).tolist()))


def scale_numbers(values: dict, mean: float = 0.0, std: float = 1.0, centre: bool = True) -> dict:
    """Category numbers brought to a feature's deviation, centred if asked."""
    x = np.array(list(values.values()))
    x = x / (x.std() or 1.0) * std
    if centre:
        x = x - (x.max() + x.min()) / 2 + mean
    return dict(zip(values, x.tolist()))


def fit_categories(df: DataFrame, features: list[str], method: str = "abdm", target: str | None = None, std: float = 1.0, centre: bool = True) -> dict[str, dict]:
    """Numbers for the categories of each feature: distances by how the other
    features (``abdm``), the classes of ``target`` (``mvdm``) or both on average
    (``abdm-mvdm``) are spread, brought to one dimension and to a deviation."""
    out = {}
    for f in features:
        found = []
        if "abdm" in method:
            found.append(abdm(df, f, [o for o in features if o != f]))
        if "mvdm" in method:
            found.append(mvdm(df, f, target))
        d = found[0]
        for other in found[1:]:
            d = d.unionByName(other).groupBy("a", "b").agg(F.avg("distance").alias("distance"))
        out[f] = scale_numbers(multidimensional_scaling(d), std=std, centre=centre)
    return out


def encode_categories(df: DataFrame, numbers: dict[str, dict]) -> DataFrame:
    """Replaces categories by their numbers; unknown ones become null."""
    return df.withColumns({f: F.try_element_at(F.create_map(*[F.lit(x) for k, v in m.items() for x in (k, float(v))]), F.col(f)) for f, m in numbers.items()})


def farthest_categories(distances: DataFrame) -> DataFrame:
    """``category, farthest``: for each category the one at the largest distance;
    ties to the smaller."""
    best = F.min(F.struct((-F.col("distance")).alias("d"), F.col("b")))
    return distances.groupBy(F.col("a").alias("category")).agg(best["b"].alias("farthest"))
