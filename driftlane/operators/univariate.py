"""Two-sample tests per feature: Kolmogorov-Smirnov, Cramer-von Mises, Fisher's
exact test, chi-squared, and their mix for tables.

A sample pair is one DataFrame with a flag column (1 reference, 0 test). Features
are unpivoted after projection; the statistics are aggregates. Only a row per
feature reaches the functions that turn them into p-values.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.functions import stats
from driftlane.functions.frames import uniform

#: Ranges that running sums of a feature are cut into.
BLOCKS = 128


def pair(ref: DataFrame, test: DataFrame, features: Iterable[str], flag: str = "is_ref") -> DataFrame:
    """One table of both samples with the flag."""
    cols = list(features)
    return ref.select(*cols, F.lit(1).alias(flag)).unionByName(test.select(*cols, F.lit(0).alias(flag)))


def long_form(df: DataFrame, features: Iterable[str], flag: str = "is_ref", kind: str = "double", names: str | None = None) -> DataFrame:
    """(feature, value, is_ref) rows; null values take no part. ``names``: the rows
    are long already, and this column names their feature."""
    if names is not None:
        (value,) = features
        return df.select(F.col(names).alias("feature"), F.col(value).cast(kind).alias("value"), F.col(flag).cast("int").alias("is_ref")).where("value is not null")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast(kind).alias("value")) for f in features]))
    return df.select(F.col(flag).cast("int").alias("is_ref"), rows.alias("r")).select("r.feature", "r.value", "is_ref").where("value is not null")


def value_counts(long: DataFrame) -> DataFrame:
    """Counts of each value in both samples: combined before the shuffle."""
    return long.groupBy("feature", "value").agg(F.sum("is_ref").alias("ref"), F.sum(1 - F.col("is_ref")).alias("test"))


def _block(cuts: Column, value: Column) -> Column:
    """How many cuts lie below a value, by binary search."""
    steps = [1 << k for k in reversed(range(BLOCKS.bit_length()))]
    fits = lambda at, s: (at + s <= F.size(cuts)) & (F.get(cuts, at + s - F.lit(1)) < value)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(fits(at, s), at + s).otherwise(at))


def running(counts: DataFrame, few: bool = True) -> DataFrame:
    """Adds ``ref_upto`` and ``test_upto``, counts at or below a value, and the
    sample sizes ``n_ref`` and ``n_test``.

    Values of a feature are cut into ranges of about equal numbers of distinct
    values. Sums run within a range; what lies before it is added from a table of
    a row per feature and range. So a task holds a range, not a feature. With ``few``
    features (a table's columns) what has a row per feature and range is broadcast.
    """
    small = F.broadcast if few else lambda df: df
    # the filter holds always; as it reads both counts, this branch shares the exchange of the others
    cuts = counts.where("ref + test >= 0").groupBy("feature").agg(F.percentile_approx("value", [i / BLOCKS for i in range(1, BLOCKS)], 1000).alias("cuts"))
    ranged = counts.join(small(cuts), "feature").withColumn("block", _block(F.col("cuts"), F.col("value"))).drop("cuts")
    sums = ranged.groupBy("feature", "block").agg(F.sum("ref").alias("r"), F.sum("test").alias("t"))
    before = Window.partitionBy("feature").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    sums = sums.select(
        "feature", "block", F.coalesce(F.sum("r").over(before), F.lit(0)).alias("ref_before"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("test_before"),
        F.sum("r").over(whole).alias("n_ref"), F.sum("t").over(whole).alias("n_test"),
    )
    upto = Window.partitionBy("feature", "block").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inner = ranged.select("*", F.sum("ref").over(upto).alias("r_in"), F.sum("test").over(upto).alias("t_in"))
    joined = inner.join(small(sums), ["feature", "block"])
    return joined.select("feature", "value", "ref", "test", (F.col("r_in") + F.col("ref_before")).alias("ref_upto"), (F.col("t_in") + F.col("test_before")).alias("test_upto"), "n_ref", "n_test")


def percentiles(df: DataFrame, features: Iterable[str], shares: list[float]) -> DataFrame:
    """``feature, edges``: exact percentiles of each feature with linear interpolation,
    from counts of values in ranges: no task holds a feature. Features without values
    have no row."""
    r = running(value_counts(long_form(df.withColumn("__one", F.lit(1)), features, "__one")))

    def edge(p: float) -> Column:
        at = (F.col("n_ref") - 1) * p
        low, high = F.floor(at), F.ceil(at)
        held = lambda i: F.max(F.when((F.col("ref_upto") - F.col("ref") <= i) & (i < F.col("ref_upto")), F.col("value")))
        a, b, spot, down, up = held(low), held(high), F.max(at), F.max(low), F.max(high)
        return F.when(a == b, a).otherwise((up - spot) * a + (spot - down) * b)

    return r.groupBy("feature").agg(F.array(*map(edge, shares)).alias("edges"))


def ks_statistic(df: DataFrame, features: Iterable[str], alternative: str = "two-sided", flag: str = "is_ref", names: str | None = None) -> DataFrame:
    """``feature, distance, n_ref, n_test`` of the two-sample statistic.

    ``greater`` is the largest excess of the reference's distribution function
    over the test's, ``less`` the other way round. A feature whose one sample is
    empty has a null distance.
    """
    gap = F.try_divide("ref_upto", "n_ref") - F.try_divide("test_upto", "n_test")
    gap = {"two-sided": F.abs(gap), "greater": gap, "less": -gap}[alternative]
    out = running(value_counts(long_form(df, features, flag, names=names)), few=names is None).groupBy("feature")
    least = F.greatest(F.max(gap), F.lit(0.0))
    return out.agg(F.when((F.max("n_ref") > 0) & (F.max("n_test") > 0), least).alias("distance"), F.max("n_ref").alias("n_ref"), F.max("n_test").alias("n_test"))


def ecdf(df: DataFrame, value: str, series: str) -> DataFrame:
    """``series, value, n, ecdf``: the share of a series' values at or below each of its
    distinct values, from counts in ranges: no task holds a series."""
    long = df.where(F.col(value).isNotNull()).select(F.col(series).cast("string").alias("feature"), F.col(value).cast("double").alias("value"))
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("ref"), F.lit(0).cast("long").alias("test"))
    r = running(counts, few=False)
    return r.select(F.col("feature").cast(dict(df.dtypes)[series]).alias("series"), "value", F.col("ref").alias("n"), (F.col("ref_upto") / F.col("n_ref")).alias("ecdf"))


def category_union(*samples: DataFrame) -> DataFrame:
    """``category``: the distinct values of one-column samples, of any of them."""
    out = samples[0].toDF("category")
    for s in samples[1:]:
        out = out.unionAll(s.toDF("category"))
    return out.distinct()


def cvm_statistic(df: DataFrame, features: Iterable[str], flag: str = "is_ref", names: str | None = None) -> DataFrame:
    """``feature, distance, n_ref, n_test`` of T, with mid-ranks for ties."""
    r = running(value_counts(long_form(df, features, flag, names=names)), few=names is None)
    n, m = F.col("n_ref").cast("double"), F.col("n_test").cast("double")
    before = F.col("ref_upto") + F.col("test_upto") - F.col("ref") - F.col("test")
    mid = before + (F.col("ref") + F.col("test") + 1) / 2.0

    def squares(c: str) -> Column:  # of (mid-rank - own rank) over the tied values
        k = F.col(c).cast("double")
        a = mid - (F.col(f"{c}_upto") - F.col(c))
        return k * a * a - a * k * (k + 1) + k * (k + 1) * (2 * k + 1) / 6.0

    u = r.groupBy("feature", "n_ref", "n_test").agg(F.sum(n * squares("ref") + m * squares("test")).alias("u"))
    t = F.try_divide(F.col("u"), n * m * (n + m)) - F.try_divide(4 * n * m - 1, 6 * (n + m))
    return u.select("feature", F.when((n > 0) & (m > 0), t).alias("distance"), "n_ref", "n_test")


def fet_table(df: DataFrame, features: Iterable[str], flag: str = "is_ref") -> DataFrame:
    """``feature, sum_ref, n_ref, sum_test, n_test`` of 0/1 or boolean features.
    Another value raises an error."""
    bad = F.raise_error(F.lit("values must be 0, 1 or booleans")).cast("double")
    long = long_form(df, features, flag).withColumn("value", F.when(F.col("value").isin(0.0, 1.0), F.col("value")).otherwise(bad))
    is_ref = F.col("is_ref")
    return long.groupBy("feature").agg(
        F.sum(F.col("value") * is_ref).cast("long").alias("sum_ref"), F.sum(is_ref).alias("n_ref"), F.sum(F.col("value") * (1 - is_ref)).cast("long").alias("sum_test"), F.sum(1 - is_ref).alias("n_test")
    )


def fet_statistic(df: DataFrame, features: Iterable[str], alternative: str = "greater", flag: str = "is_ref") -> DataFrame:
    """``feature, distance (sample odds ratio), p_val``; test counts come first in
    the table, so ``greater`` asks whether the test sample has more ones."""

    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([stats.fisher_exact(int(w), int(x), int(y), int(z), alternative)[1] for w, x, y, z in zip(a, b, c, d)])

    a, b = F.col("sum_test"), F.col("sum_ref")
    c, d = F.col("n_test") - a, F.col("n_ref") - b
    odds = F.when((a + b == 0) | (c + d == 0), F.lit(float("nan"))).when(b * c == 0, F.lit(float("inf"))).otherwise(F.try_divide(a * d, b * c))
    return fet_table(df, features, flag).select("feature", odds.alias("distance"), p_value(a, b, c, d).alias("p_val"), "n_ref", "n_test")


def contingency(df: DataFrame, features: Iterable[str], flag: str = "is_ref") -> DataFrame:
    """``feature, category, ref, test``: counts of every category of either sample.
    Categories that neither has would add nothing to the statistic."""
    long = long_form(df, features, flag, "string")
    return long.groupBy("feature", F.col("value").alias("category")).agg(F.sum("is_ref").alias("ref"), F.sum(1 - F.col("is_ref")).alias("test"))


def chi2_statistic(df: DataFrame, features: Iterable[str], flag: str = "is_ref") -> DataFrame:
    """``feature, distance, dof, n_ref, n_test``: chi-squared over the union of
    categories, with Yates' correction if there are two."""
    return _chi2(contingency(df, features, flag=flag))


def _chi2(counts: DataFrame) -> DataFrame:
    # the filter holds always; totals are combined before a feature's counts meet
    totals = counts.where("ref + test >= 0").groupBy("feature").agg(F.sum("ref").alias("n_ref"), F.sum("test").alias("n_test"), F.count(F.lit(1)).alias("k"))
    c = counts.join(F.broadcast(totals), "feature")  # a row per feature
    both = F.col("ref") + F.col("test")

    def part(x: str, n: str) -> Column:
        e = F.col(n) * both / (F.col("n_ref") + F.col("n_test"))
        gap = F.abs(F.col(x) - e)
        gap = F.when(F.col("k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.coalesce(F.try_divide(gap * gap, e), F.lit(0.0))

    return c.groupBy("feature").agg(F.sum(part("ref", "n_ref") + part("test", "n_test")).alias("distance"), (F.max("k") - 1).alias("dof"), F.max("n_ref").alias("n_ref"), F.max("n_test").alias("n_test"))


def ks(df: DataFrame, features: Iterable[str], alternative: str = "two-sided", exact: bool = False, flag: str = "is_ref") -> DataFrame:
    """KS report: ``feature, distance, p_val``."""

    @F.pandas_udf("double")
    def p_value(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else stats.ks_sf(x, int(a), int(b), alternative, exact and max(a, b) <= 10_000) for x, a, b in zip(d, n, m)], dtype="float64")

    return ks_statistic(df, features, alternative, flag).withColumn("p_val", p_value("distance", "n_ref", "n_test"))


def cvm(df: DataFrame, features: Iterable[str], flag: str = "is_ref") -> DataFrame:
    """Cramer-von Mises report: ``feature, distance, p_val``."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else stats.cvm_sf(x, int(a), int(b)) for x, a, b in zip(t, n, m)], dtype="float64")

    return cvm_statistic(df, features, flag).withColumn("p_val", p_value("distance", "n_ref", "n_test"))


def chi2_from_counts(counts: DataFrame) -> DataFrame:
    """Chi-squared report of counts ``feature, category, ref, test``."""

    @F.pandas_udf("double")
    def p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([stats.chi2_sf(a, b) for a, b in zip(x, dof)])

    return _chi2(counts).withColumn("p_val", p_value("distance", "dof"))


def chi2(df: DataFrame, features: Iterable[str], flag: str = "is_ref") -> DataFrame:
    """Chi-squared report: ``feature, distance, p_val``."""
    return chi2_from_counts(contingency(df, features, flag=flag))


def tabular(df: DataFrame, numeric: Iterable[str], categorical: Iterable[str] = (), alternative: str = "two-sided", flag: str = "is_ref") -> DataFrame:
    """KS on numeric and chi-squared on categorical features, in one report."""
    numeric, categorical = list(numeric), list(categorical)
    cols = ["feature", "distance", "p_val", "test"]
    parts = []
    if numeric:
        parts.append(ks(df, numeric, alternative, flag=flag).withColumn("test", F.lit("ks")).select(*cols))
    if categorical:
        parts.append(chi2(df, categorical, flag=flag).withColumn("test", F.lit("chi2")).select(*cols))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def by_segment(df: DataFrame, segment: str, features: Iterable[str], test=ks_statistic, flag: str = "is_ref") -> DataFrame:
    """A test's report for every segment of a table, in one plan: a segment's feature
    is a feature of its own. Adds ``segment``; a null segment is one too."""
    mark, features = "\x1f", list(features)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    held = df.select(F.col(flag).alias(flag), F.coalesce(F.col(segment).cast("string"), F.lit("\x00")).alias("__s"), rows.alias("r"))
    named = held.select(flag, F.concat_ws(mark, "__s", "r.feature").alias("feature"), F.col("r.value").alias("value"))
    out = test(named, ["value"], flag=flag, names="feature")
    parts = F.split("feature", mark)
    return out.withColumn("segment", F.nullif(F.get(parts, F.lit(0)), F.lit("\x00"))).withColumn("feature", F.get(parts, F.lit(1)))


def feature_decision(report: DataFrame, p_val: float = 0.05) -> DataFrame:
    """Decision per feature, at the uncorrected level."""
    return report.select("*", F.lit(p_val).alias("threshold"), (F.col("p_val") < p_val).cast("int").alias("is_drift"))


def batch_decision(report: DataFrame, p_val: float = 0.05, correction: str = "bonferroni") -> DataFrame:
    """One row: drift if any feature passes the corrected level.

    ``fdr``: the level q i / n of the largest i whose p-value lies below its own;
    null if none does. The report has a row per feature.
    """
    n = F.count(F.lit(1))
    if correction == "bonferroni":
        out = report.agg(F.min("p_val").alias("p_val"), (F.lit(p_val) / n).alias("threshold"), n.alias("n_features"))
    elif correction == "fdr":
        ordered = report.select("p_val", F.row_number().over(Window.orderBy("p_val")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
        bar = F.lit(p_val) * F.col("i") / F.col("n")
        out = ordered.agg(F.min("p_val").alias("p_val"), F.max(F.when(F.col("p_val") < bar, bar)).alias("threshold"), n.alias("n_features"))
    else:
        raise ValueError("bonferroni or fdr")
    return out.withColumn("is_drift", F.coalesce((F.col("p_val") < F.col("threshold")).cast("int"), F.lit(0)))


def last_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """Reference update: the last ``n`` rows."""
    return df.orderBy(F.col(order).desc()).limit(n)


def reservoir(df: DataFrame, size: int, seed: int, key: Iterable[str]) -> DataFrame:
    """Reference update: a uniform sample of ``size`` rows of all seen so far. Each
    row has a lasting pseudo-random priority from its key; the least stay, so it
    doesn't matter when or where rows were seen."""
    priority = uniform(seed, *key)
    return df.withColumn("__priority", priority).orderBy("__priority", *key).limit(size).drop("__priority")
