"""Nearest neighbours among a reference set, and the outlier scores on them.

Rows of the query side meet the reference in blocks: a task holds one block of
each side as matrices, and keeps the k least distances of each row, so neither
memory nor the shuffle holds all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
#: A table is cut into about so many blocks, each of ``BLOCK`` rows at least and
#: ``MAX_BLOCK`` at most: what is shuffled grows with the rows, up to BLOCKS * MAX_BLOCK.
BLOCKS, MAX_BLOCK = 16, 65_536
#: Rows of a block that are compared with the other block at a time, and values that
#: such a comparison holds.
SLICE, VALUES = 256, 1 << 22


def block_size(rows: int, least: int) -> int:
    return min(max(least, math.ceil(rows / BLOCKS)), max(least, MAX_BLOCK))


def dealt(df: DataFrame, id_col: str, vec_col: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """``id, v`` and the block ``own`` of a row, once for each block ``other`` that it
    meets. Block numbers are integers on either side, as cogrouped keys hash by type."""
    block = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias(own)
    held = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), block)
    return held.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def as_matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


#: Pairs of rows whose exact difference is taken at a time.
PAIRS = 1 << 18


def _differences(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, from their differences."""
    return np.concatenate([((x[i[a : a + PAIRS]] - y[j[a : a + PAIRS]]) ** 2).sum(1) for a in range(0, len(i), PAIRS)] or [np.zeros(0)])


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances of two sets of rows, 1e-30 at least.

    They come from one product of the rows less their mean, so where the data lies
    doesn't matter; those that are small against the rows' lengths, where digits
    cancel, are taken from the differences.
    """
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)))
    centre = (x.mean(0) + y.mean(0)) / 2
    a, b = x - centre, y - centre
    x2, y2 = (a * a).sum(1), (b * b).sum(1)
    d = a @ (-2 * b).T
    d += x2[:, None]
    d += y2
    if d.min() < (bar := 1e-6 * (x2.max() + y2.max())):
        i, j = np.nonzero(d < bar)
        small = d[i, j] < 1e-6 * (x2[i] + y2[j])
        i, j = i[small], j[small]
        d[i, j] = _differences(x, y, i, j)
    return np.maximum(d, 1e-30, out=d)


def nearest(x: np.ndarray, y: np.ndarray, k: int, rank: np.ndarray, kernel=None, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the ``k`` nearest rows of y, in order, ties to
    the lesser ``rank``. ``same`` marks pairs to leave out.

    All rows that may be among the nearest, as far as the product of the rows can
    tell, are compared by their differences.
    """
    if kernel is None:
        centre = (x.mean(0) + y.mean(0)) / 2
        a, b = x - centre, y - centre
        x2, y2 = (a * a).sum(1), (b * b).sum(1)
        d = x2[:, None] + y2[None] - 2 * a @ b.T
        slack = 8 * np.finfo(float).eps * (x.shape[1] + 8) * (x2 + y2.max())  # beyond what rounding can do
    else:
        d, slack = -kernel(x, y), np.zeros(len(x))
    if same is not None:
        d[same] = np.inf
    take = min(k, len(y))
    bar = np.partition(d, take - 1, axis=1)[:, take - 1] + slack
    i, j = np.nonzero((d <= bar[:, None]) & (d < np.inf))
    dist = np.sqrt(_differences(x, y, i, j)) if kernel is None else d[i, j]
    order = np.lexsort((rank[j], dist, i))
    i, j, dist = i[order], j[order], dist[order]
    on = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[on], j[on], dist[on]


def neighbours(queries: DataFrame, ref: DataFrame, k: int, id_col: str = "id", vec_col: str = "features", kernel=None, skip_self: bool = False, block: int = BLOCK) -> DataFrame:
    """``id_col, neighbour, distance, rank`` of the k nearest reference rows.

    Distance is Euclidean, exact wherever the data lies, or minus ``kernel`` (a
    function of two matrices). Ties, also among many equal rows, go to the smaller id. ``skip_self`` leaves out the row of the same id, for a
    reference that is scored against itself.
    """
    kind = dict(ref.dtypes)[id_col]
    n_ref, n_q = ref.count(), queries.count()
    b_ref, b_q = (max(1, math.ceil(n / block_size(n, block))) for n in (n_ref, n_q))
    left = dealt(queries, id_col, vec_col, "q", b_q, "r", b_ref)
    right = dealt(ref, id_col, vec_col, "r", b_ref, "q", b_q)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = as_matrix(a.column("v")), as_matrix(b.column("v"))
        out = [np.zeros(0, object), np.zeros(0, object), np.zeros(0)]
        if len(x) and len(y):
            ids, refs = a.column("id").to_numpy(), b.column("id").to_numpy()
            rank = np.empty(len(refs), np.int64)
            rank[np.argsort(refs, kind="stable")] = np.arange(len(refs))
            got = []
            step = max(1, min(SLICE, VALUES // len(y)))
            for start in range(0, len(x), step):
                part = slice(start, start + step)
                i, j, dist = nearest(x[part], y, k, rank, kernel, ids[part, None] == refs[None] if skip_self else None)
                got.append((ids[part][i], refs[j], dist))
            out = [np.concatenate(c) for c in zip(*got)]
        return pa.table({"id": pa.array(out[0], a.schema.field("id").type), "neighbour": pa.array(out[1], a.schema.field("id").type), "distance": pa.array(out[2], pa.float64())})

    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(search, f"id {kind}, neighbour {kind}, distance double")
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.select(F.col("id").alias(id_col), "neighbour", "distance", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def knn_scores(queries: DataFrame, ref: DataFrame, k: int | list[int], id_col: str = "id", vec_col: str = "features", kernel=None) -> DataFrame:
    """``id_col, score``: the distance to the k-th neighbour; for several k
    ``scores``, an array with one for each."""
    ks = [k] if isinstance(k, int) else list(k)
    near = neighbours(queries, ref, max(ks), id_col, vec_col, kernel).groupBy(id_col)
    each = [F.max(F.when(F.col("rank") == i, F.col("distance"))) for i in ks]
    return near.agg(each[0].alias("score") if isinstance(k, int) else F.array(*each).alias("scores"))


def lof_scores(queries: DataFrame, ref: DataFrame, k: int, id_col: str = "id", vec_col: str = "features", kernel=None) -> DataFrame:
    """``id_col, score``: local outlier factor against the reference.

    Reference rows have neighbours among the others. A row's reach to a neighbour
    is the larger of their distance and the neighbour's k-distance; the score is
    the mean reach times the mean of the neighbours' inverse mean reaches.
    """
    def reach(near: DataFrame, k_dist: DataFrame) -> Column:
        d, kd = F.col("distance"), F.col("k_distance")
        return F.greatest(d, kd) if kernel is None else F.exp(F.greatest(d, kd))

    own = neighbours(ref, ref, k, id_col, vec_col, kernel, skip_self=True).select(F.col(id_col).alias("id"), "neighbour", "distance", "rank")
    k_dist = own.groupBy("id").agg(F.max("distance").alias("k_distance")).toDF("neighbour", "k_distance")
    mean_reach = own.join(k_dist, "neighbour").groupBy("id").agg(F.avg(reach(own, k_dist)).alias("mean_reach"))
    known = k_dist.join(mean_reach.toDF("neighbour", "mean_reach"), "neighbour")
    near = neighbours(queries, ref, k, id_col, vec_col, kernel)
    out = near.join(known, "neighbour").groupBy(id_col)
    return out.agg((F.avg(reach(near, known)) * F.avg(1 / F.col("mean_reach"))).alias("score"))
