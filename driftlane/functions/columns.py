"""Array and vector expressions. All stay inside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use) -> Column:
    """``use(value)``, with the value computed once: inside a function of each
    element an expression is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(a: str | Column) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def mean(a: str | Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(total(a), F.size(col(a)))


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def minkowski(a: str | Column, b: str | Column, p: float = 2) -> Column:
    """Of absolute differences, for odd p too."""
    return F.pow(total(F.zip_with(col(a), col(b), lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def cityblock(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def relative_distance(a: str | Column, b: str | Column, eps: float = 1e-12) -> Column:
    """|a - b| over the smaller of the two lengths."""
    return F.sqrt(squared_distance(a, b)) / (F.least(norm(a), norm(b)) + eps)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null if a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def softmax(a: str | Column) -> Column:
    e = bind(F.array_max(col(a)), lambda top: F.transform(col(a), lambda x: F.exp(x - top)))
    return bind(e, lambda e: bind(total(e), lambda s: F.transform(e, lambda x: x / s)))


def entropy(p: str | Column) -> Column:
    """Natural-log entropy of probabilities; 0 ln 0 is 0."""
    return total(F.transform(col(p), lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(0.0)))


def margin(p: str | Column, width: float = 0.1) -> Column:
    """1 if the two largest probabilities are less than ``width`` apart."""
    s = F.sort_array(col(p), asc=False)
    return (F.get(s, F.lit(0)) - F.get(s, F.lit(1)) < width).cast("int")


def kl(p: str | Column, q: str | Column) -> Column:
    """Infinite where ``q`` leaves out what ``p`` has."""
    return total(F.zip_with(col(p), col(q), lambda x, y: F.when((x > 0) & (y > 0), x * F.ln(F.try_divide(x, y))).when(x > 0, float("inf")).otherwise(0.0)))


def cross_entropy(p: str | Column, q: str | Column) -> Column:
    return total(F.zip_with(col(p), col(q), lambda x, y: F.when(y > 0, -x * F.ln(y)).when(x > 0, float("inf")).otherwise(0.0)))


def sharpen(p: str | Column, temperature: float) -> Column:
    e = F.transform(col(p), lambda x: F.pow(x, F.lit(1.0 / temperature)))
    return bind(e, lambda e: bind(total(e), lambda s: F.transform(e, lambda x: x / s)))


def deviation(a: str | Column) -> Column:
    """Population deviation of an array."""
    return bind(mean(a), lambda m: F.sqrt(mean(F.transform(col(a), lambda x: (x - m) * (x - m)))))


def argmax(a: str | Column) -> Column:
    """Place, from 0, of the first largest value."""
    return (F.array_position(col(a), F.array_max(col(a))) - 1).cast("int")


def top_share(a: str | Column, percent: float) -> Column:
    """Mean of the largest ceil(percent %) values."""
    k = F.ceil(F.size(col(a)) * (percent / 100.0)).cast("int")
    return mean(F.slice(F.sort_array(col(a), asc=False), F.lit(1), k))
