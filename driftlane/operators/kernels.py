"""Kernel two-sample tests: MMD, LSDD, learned and context-aware kernels.

The kernel matrix is never whole: pairs of row blocks are evaluated in tasks and
only sums leave them. Permutations are label vectors that a seed gives back, so a
tile yields one number per permutation: with S the 0/1 labels of all permutations,
S'KS needs one product per tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.functions.columns import squared_distance
from driftlane.functions.frames import number
from driftlane.operators.neighbours import BLOCKS, MAX_BLOCK, as_matrix, block_size, dealt, squared_distances

TILE = 2048


@dataclass(frozen=True)
class GaussianRBF:
    """Mean of Gaussian kernels over one or more bandwidths."""

    sigma: tuple[float, ...]

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = squared_distances(x, y)
        if len(self.sigma) > 1:
            return np.mean([np.exp(-d / (2 * s * s)) for s in self.sigma], axis=0)
        d *= -0.5 / self.sigma[0] ** 2
        return np.exp(d, out=d)


@dataclass(frozen=True)
class DeepKernel:
    """(1 - eps) a(proj x, proj y) + eps b(x, y)."""

    proj: Callable[[np.ndarray], np.ndarray]
    kernel_a: Callable
    kernel_b: Callable
    eps: float = 0.1

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.mixed(self.proj(x), self.proj(y), x, y)

    def mixed(self, px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The kernel of rows whose projections are known."""
        k, b = self.kernel_a(px, py), self.kernel_b(x, y)
        k *= 1 - self.eps
        b *= self.eps
        k += b
        return k


#: Rows of a tile whose kernel values are held at a time.
STRIP = 256


def strips(kernel: Callable, x: np.ndarray, y: np.ndarray):
    """(first row of x, kernel of some rows with all of y), one after the other; rows
    are projected once."""
    px, py = (kernel.proj(x), kernel.proj(y)) if isinstance(kernel, DeepKernel) else (x, y)
    for s in range(0, len(x), STRIP):
        e = s + STRIP
        yield s, kernel.mixed(px[s:e], py, x[s:e], y) if isinstance(kernel, DeepKernel) else kernel(x[s:e], y)


@dataclass
class Samples:
    """Rows of both samples, numbered, with their number and that of test rows."""

    rows: DataFrame  # n, v, is_ref, tile
    n_ref: int
    n_test: int
    tiles: int = 1
    size: int = TILE  # rows in a tile


def numbered(ref: DataFrame, test: DataFrame, vec_col: str = "features", order: str | None = None, size: int = TILE) -> Samples:
    """Rows with lasting numbers 0 .. N-1, reference first.

    Numbers depend on the key alone (the vector itself unless ``order`` names a
    column), not on partitions; no task holds all rows.
    """
    v = F.col(vec_col).cast("array<double>").alias("v")
    key = F.col(order) if order else F.col(vec_col).cast("array<double>")
    both = ref.select(v, F.lit(1).alias("is_ref"), key.alias("k")).unionByName(test.select(v, F.lit(0).alias("is_ref"), key.alias("k")))
    counts = {r.is_ref: r["count"] for r in both.groupBy("is_ref").count().collect()}
    n_ref, n_test = counts.get(1, 0), counts.get(0, 0)
    tiles = max(1, math.ceil((n_ref + n_test) / size))
    rows = number(both, F.col("k"), tiles, F.col("is_ref")).select("v", "is_ref", "n")
    return Samples(rows.withColumn("tile", F.floor(F.col("n") / size).cast("int")), n_ref, n_test, tiles, size)


def tile_shares(n_ref: int, n_test: int, permutations: int, seed: int, size: int = TILE) -> np.ndarray:
    """(tiles, P): how many test rows each permutation marks in each tile, one
    hypergeometric draw for each permutation."""
    n = n_ref + n_test
    sizes = np.full(math.ceil(n / size), size)
    sizes[-1:] = n - size * (len(sizes) - 1)
    draw = lambda p: np.random.default_rng([seed, p]).multivariate_hypergeometric(sizes, n_test, method="marginals")
    return np.array([draw(p) for p in range(permutations)], np.int64).reshape(permutations, len(sizes)).T


def tile_labels(tile: int, n_ref: int, n_test: int, shares: np.ndarray, seed: int, size: int = TILE) -> np.ndarray:
    """(rows of the tile, P + 1) 0/1 marks of test rows; column 0 is the true
    labelling, where test rows come last.

    A permutation marks exactly ``n_test`` rows, all choices alike: how many fall
    into each tile is a row of ``shares``, which rows those are comes from a draw of
    the tile's own. So a task makes the marks of its own rows alone.
    """
    rows = np.arange(tile * size, min((tile + 1) * size, n_ref + n_test))
    out = np.zeros((len(rows), len(shares) + 1))
    out[:, 0] = rows >= n_ref
    for p, share in enumerate(shares.tolist()):
        out[np.random.default_rng([seed, p, tile]).permutation(len(rows))[:share], p + 1] = 1
    return out


def _block_pairs(samples: Samples):
    """Grouped blocks of rows, each unordered pair of blocks once: columns n, v, i or j.

    A block is some tiles, so rows are sent as often as there are blocks (16 up to a
    million rows) and not as there are tiles."""
    held = max(1, min(math.ceil(samples.tiles / BLOCKS), MAX_BLOCK // samples.size))
    blocks = math.ceil(samples.tiles / held)
    block = F.floor(F.col("tile") / held).cast("int")
    left = samples.rows.select("n", "v", block.alias("i")).withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1))))
    right = samples.rows.select("n", "v", block.alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j")))).toDF("n", "v", "j", "i")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of a block's rows in order."""
    n = rows.column("n").to_numpy()
    order = np.argsort(n)
    return n[order], as_matrix(rows.column("v"))[order]


def _tile_sums(kernel: Callable, x: np.ndarray, y: np.ndarray, sa: np.ndarray, sb: np.ndarray, same: bool) -> np.ndarray:
    """(P + 1, 3) sums of a pair of tiles, in all orders: within ref, within test, across."""
    sb1 = np.column_stack([sb, np.ones(len(y))])
    yy, ya, col, whole = np.zeros(sa.shape[1]), np.zeros(sa.shape[1]), np.zeros(len(y)), 0.0
    for s, k in strips(kernel, x, y):
        if same:
            k[np.arange(len(k)), s + np.arange(len(k))] = 0.0
        k1, marked = k @ sb1, sa[s : s + len(k)]  # per row, sums over the columns marked test, and over all
        yy += (marked * k1[:, :-1]).sum(0)
        ya += marked.T @ k1[:, -1]  # all columns for test rows
        col += k.sum(0)
        whole += k1[:, -1].sum()
    yb = sb.T @ col  # all rows for test columns
    return np.stack([whole - ya - yb + yy, yy, ya + yb - 2 * yy], 1)  # across: exactly one of the two marked


def tile_sums(samples: Samples, kernel: Callable, permutations: int = 0, seed: int = 0) -> np.ndarray:
    """Sums (within ref, within test, across) without the diagonal, (P + 1, 3)."""
    n_ref, m, size = samples.n_ref, samples.n_test, samples.size
    shares = tile_shares(n_ref, m, permutations, seed, size)  # numbers of tiles times permutations
    labels = lambda n: tile_labels(n // size, n_ref, m, shares[n // size], seed, size)

    def evaluate(a: pa.Table, b: pa.Table) -> pa.Table:
        same, (na, x), (nb, y) = a.column("i")[0].as_py() == b.column("j")[0].as_py(), _matrix(a), _matrix(b)
        marks = [labels(int(nb[t])).astype(np.uint8) for t in range(0, len(y), size)]
        sums = np.zeros((permutations + 1, 3))
        for i in range(0, len(x), size):
            sa = labels(int(na[i]))
            for j in range(i if same else 0, len(y), size):
                tile = _tile_sums(kernel, x[i : i + size], y[j : j + size], sa, marks[j // size].astype(float), same and i == j)
                # unordered tile pairs stand for both orders; within a tile both orders are there
                sums += tile * (np.array([1.0, 1.0, 0.5]) if same and i == j else np.array([2.0, 2.0, 1.0]))
        return pa.table({"p": pa.array(np.arange(permutations + 1), pa.int32()), **{c: pa.array(sums[:, i]) for i, c in enumerate(("xx", "yy", "xy"))}})

    tiles_df = _block_pairs(samples).applyInArrow(evaluate, "p int, xx double, yy double, xy double")
    out = tiles_df.groupBy("p").agg(F.sum("xx").alias("xx"), F.sum("yy").alias("yy"), F.sum("xy").alias("xy")).orderBy("p").collect()
    return np.array([[r.xx, r.yy, r.xy] for r in out])


def mmd2(sums: np.ndarray, n: int, m: int) -> np.ndarray:
    """Unbiased squared MMD from the sums; xy counts each pair across once."""
    return sums[:, 0] / (n * (n - 1)) + sums[:, 1] / (m * (m - 1)) - 2 * sums[:, 2] / (n * m)


#: Rows whose pairs are ordered in one place; the pairs of more are counted in tiles.
LOCAL_ROWS = 3000
#: Ranges in which distances are counted, and distances that are ordered at last.
BINS, FEW = 4096, 200_000


def sigma_median(ref: DataFrame, test: DataFrame | None = None, vec_col: str = "features", id_col: str = "id", local: int = LOCAL_ROWS, size: int = TILE, seed: int = 0) -> DataFrame:
    """``sigma``: sqrt(d2 / 2) for the median squared distance over all ordered
    pairs of rows of both samples, without the pairs of a row with itself.

    Beyond ``local`` rows the distances are counted in tiles: a sample by hash gives a
    first bracket, each round counts what lies below it and in its ranges, and goes
    on in the range of the median until few distances are left there. The result is
    the exact one of all pairs.
    """
    rows = ref.select(F.col(id_col).alias("a"), F.col(vec_col).cast("array<double>").alias("v"))
    if test is not None:
        rows = rows.unionByName(test.select(F.col(id_col).alias("a"), F.col(vec_col).cast("array<double>").alias("v")))
    held = np.array([r.v for r in rows.orderBy(F.xxhash64(F.lit(seed), "a"), "a").limit(local + 1).collect()])
    whole = len(held) <= local
    held = held[:local]
    d = np.sort(squared_distances(held, held)[np.triu_indices(len(held), 1)])
    n = len(held) if whole else rows.count()
    # ordered pairs come twice: place (n*n - n) // 2 - 1 of them
    at = max(((n * n - n) // 2 - 1) // 2, 0)
    if whole:
        value = float(d[at]) if len(d) else 2.0
    else:
        value = _ordered_distance(rows.select("v"), n, at, float(d[int(0.48 * len(d))]), float(d[int(0.52 * len(d))]), size)
    return ref.sparkSession.createDataFrame([(math.sqrt(value / 2),)], "sigma double")


def _bins(edges: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many distances lie in each range of ``edges``, below them and from the last
    on; the edges are even, so a place is guessed and then set right."""
    last = len(edges) - 1
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        at = np.clip((d - edges[0]) * (last / (edges[-1] - edges[0])), 0, max(last - 1, 0)).astype(np.int64) if last else np.zeros(len(d), np.int64)
    wrong = np.flatnonzero((d < edges[at]) | (d >= edges[np.minimum(at + 1, last)]))
    at += 1
    at[wrong] = np.searchsorted(edges, d[wrong], side="right")
    return np.bincount(at, minlength=len(edges) + 1)


def _ordered_distance(rows: DataFrame, n: int, at: int, low: float, high: float, size: int = TILE) -> float:
    """The squared distance at a place, from 0, of all unordered pairs of ``n`` rows;
    ``low`` and ``high`` are where it is looked for first."""
    samples = numbered(rows.withColumn("features", F.col("v")), rows.limit(0).withColumn("features", F.col("v")), size=size)
    pairs = _block_pairs(samples)

    def distances(a: pa.Table, b: pa.Table):
        same, (_, x), (_, y) = a.column("i")[0].as_py() == b.column("j")[0].as_py(), _matrix(a), _matrix(b)
        for i in range(0, len(x), STRIP):
            for j in range(i // size * size if same else 0, len(y), size):
                d = squared_distances(x[i : i + STRIP], y[j : j + size])
                yield d[i + np.arange(len(d))[:, None] < j + np.arange(d.shape[1])[None]] if same and j < i + STRIP else d.ravel()

    while True:
        edges = np.unique(np.linspace(low, high, BINS + 1))

        def count(a: pa.Table, b: pa.Table) -> pa.Table:
            bins = np.zeros(len(edges) + 1, np.int64)
            for d in distances(a, b):
                bins += _bins(edges, d)
            return pa.table({"bin": pa.array(np.flatnonzero(bins), pa.int32()), "c": pa.array(bins[bins > 0], pa.int64())})

        counts = np.zeros(len(edges) + 1, np.int64)
        for r in pairs.applyInArrow(count, "bin int, c long").groupBy("bin").agg(F.sum("c").alias("c")).collect():
            counts[r.bin] = r.c
        upto = np.cumsum(counts)
        k = int(np.searchsorted(upto, at, side="right"))  # values of range k lie from edges[k - 1] up to below edges[k]
        if k == 0:
            low, high = 0.0, low
        elif k == len(edges):
            low, high = high, max(4 * high, 1e-30)
        elif counts[k] <= FEW:
            a, b = float(edges[k - 1]), float(edges[k])

            def inside(x: pa.Table, y: pa.Table) -> pa.Table:
                return pa.table({"d": np.concatenate([d[(d >= a) & (d < b)] for d in distances(x, y)])})

            few = sorted(r.d for r in pairs.applyInArrow(inside, "d double").collect())  # as many as were counted
            return few[at - int(upto[k - 1])]
        elif float(edges[k]) <= np.nextafter(float(edges[k - 1]), np.inf):
            return float(edges[k - 1])  # one value, many times
        else:
            low, high = float(edges[k - 1]), float(edges[k])


def sigma_mean(rows: DataFrame, vec_col: str = "features") -> DataFrame:
    """``sigma``: sqrt(mean squared distance / 2) over ordered pairs of different
    rows, in one pass: the sum is 2 n sum|x|^2 - 2 |sum x|^2."""
    v = F.col(vec_col).cast("array<double>")
    parts = rows.select(F.posexplode(v).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    total = 2 * n * F.sum("q") - 2 * F.sum(F.col("s") * F.col("s"))
    return parts.agg(F.sqrt(total / (n * (n - 1)) / 2).alias("sigma"))


def mmd(ref: DataFrame, test: DataFrame, kernel: Callable | None = None, p_val: float = 0.05, permutations: int = 100, vec_col: str = "features", id_col: str = "id", seed: int = 0, init_sigma: Callable | None = None) -> dict:
    """Permutation test of the squared MMD: a report of the distance, its p-value
    (share of permutations that reach it) and the distance that would be drift.
    ``init_sigma(ref, test, vec_col, id_col)`` gives a frame of one ``sigma``; the
    median of all pairs by default."""
    if kernel is None:
        kernel = GaussianRBF(((init_sigma or sigma_median)(ref, test, vec_col, id_col).first().sigma,))
    s = numbered(ref, test, vec_col)
    stats = mmd2(tile_sums(s, kernel, permutations, seed), s.n_ref, s.n_test)
    return permutation_report(stats, p_val)


def permutation_report(stats: np.ndarray, p_val: float) -> dict:
    true, perms = float(stats[0]), np.sort(stats[1:])[::-1]
    p = float((true <= perms).mean())
    at = min(int(p_val * len(perms)), len(perms) - 1)
    return {"is_drift": int(p < p_val), "distance": true, "p_val": p, "threshold": p_val, "distance_threshold": float(perms[at])}


def permutation_test(x: np.ndarray, y: np.ndarray, metric: Callable, permutations: int = 100, seed: int = 0) -> tuple[float, float]:
    """(p-value, distance) of any metric on two small samples."""
    both, true = np.concatenate([x, y]), metric(x, y)
    hits = 0
    for p in range(permutations):
        order = np.random.default_rng([seed, p]).permutation(len(both))
        hits += true <= metric(both[order[: len(x)]], both[order[len(x) :]])
    return hits / permutations, float(true)


# -- least-squares density difference ------------------------------------------


#: Centres of the density difference, whose matrix is inverted in the driver.
MAX_CENTRES = 2000


def lsdd_select(h_all: np.ndarray, gram: np.ndarray, rd_max: float = 0.2) -> tuple[np.ndarray, float]:
    """(inverse, lambda): the first of 4**-i whose mean relative difference over the
    permutations' h falls below ``rd_max``. Raises ValueError if none has a value,
    as with too many repeated rows."""
    eye = np.eye(len(gram))
    best = None
    for i in range(10):
        lam = 4.0**-i
        inv = np.linalg.inv(gram + lam * eye)
        omega = h_all @ inv.T
        with np.errstate(divide="ignore", invalid="ignore"):
            rd = np.mean(1 - np.einsum("pi,ij,pj->p", omega, gram, omega) / np.einsum("pi,pi->p", h_all, omega))
        if np.isnan(rd):
            continue
        best = (2 * inv - inv.T @ gram @ inv, lam)
        if rd < rd_max:
            return best
    if best is None:
        raise ValueError("no regularisation gives a finite difference: too many repeated rows")
    return best


def lsdd_h(rows: DataFrame, centres: np.ndarray, sigma: float, vec_col: str = "features", flag: str = "is_ref") -> DataFrame:
    """``centre, h``: difference of the samples' mean kernel values at each centre."""
    c = centres.tolist()
    v = F.col(vec_col).cast("array<double>")
    at = F.array(*[F.struct(F.lit(i).alias("centre"), F.array(*map(F.lit, x)).alias("c")) for i, x in enumerate(c)])
    values = rows.select(F.col(flag).alias("f"), v.alias("v"), F.explode(at).alias("a")).select("f", "a.centre", F.exp(-squared_distance("v", "a.c") / (2.0 * sigma * sigma)).alias("k"))
    return values.groupBy("centre").agg((F.avg(F.when(F.col("f") == 1, F.col("k"))) - F.avg(F.when(F.col("f") == 0, F.col("k")))).alias("h"))


def lsdd(ref: DataFrame, test: DataFrame, p_val: float = 0.05, permutations: int = 100, centres: int | None = None, rd_max: float = 0.2, vec_col: str = "features", id_col: str = "id", seed: int = 0, ddof: int = 1) -> dict:
    """Permutation test of the least-squares density difference.

    Rows are standardised by the reference (``ddof`` 1: sample deviation). The
    centres, a twentieth of the reference unless given and ``MAX_CENTRES`` at most
    (more raise ValueError), are drawn by hash; each task turns its rows into kernel
    values at the centres and adds them up per permutation, so only (permutations x
    centres) numbers leave it.
    """
    if centres and centres > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    s = numbered(ref, test, vec_col)
    moments = ref.select(F.posexplode(F.col(vec_col).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), (F.stddev_samp if ddof else F.stddev_pop)("x").alias("s")).orderBy("i").collect()
    mean, dev = np.array([r.m for r in moments]), np.array([r.s or 0.0 for r in moments]) + 1e-12
    k = centres or min(max(s.n_ref // 20, 1), MAX_CENTRES)
    drawn = ref.select(F.col(id_col).alias("i"), F.col(vec_col).cast("array<double>").alias("v")).orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(k).collect()
    c = (np.array([r.v for r in drawn]) - mean) / dev
    if len(np.unique(c, axis=0)) < len(c):
        c = c + np.random.default_rng(seed).normal(size=c.shape) * 1e-6
    scaled = ref.select(F.col(id_col).alias("id"), F.zip_with(F.zip_with(F.col(vec_col).cast("array<double>"), F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m), F.array(*map(F.lit, dev.tolist())), lambda x, d: x / d).alias("features"))
    sigma = sigma_median(scaled).first().sigma
    kernel = GaussianRBF((sigma,))

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("n")
        kx = kernel((as_matrix(rows.column("v")) - mean) / dev, c)
        tile = rows.column("tile")[0].as_py()
        marks = tile_labels(tile, n_ref, m, shares[tile], seed)
        total = np.stack([(1 - marks).T @ kx, marks.T @ kx], 1)
        return pa.table({"p": pa.array(np.arange(permutations + 1), pa.int32()), "sums": pa.array([t.ravel().tolist() for t in total], pa.list_(pa.float64()))})

    n_ref, m = s.n_ref, s.n_test
    shares = tile_shares(n_ref, m, permutations, seed)
    parts = s.rows.select("n", "v", "tile").groupBy("tile").applyInArrow(add, "p int, sums array<double>")
    sums = parts.select("p", F.posexplode("sums").alias("i", "x")).groupBy("p", "i").agg(F.sum("x").alias("x")).orderBy("p", "i").collect()
    total = np.array([r.x for r in sums]).reshape(permutations + 1, 2, len(c))
    h = total[:, 0] / s.n_ref - total[:, 1] / s.n_test
    d = c.shape[1]
    gram = (math.pi * sigma**2) ** (d / 2) * GaussianRBF((math.sqrt(2) * sigma,))(c, c) if d < 100 else GaussianRBF((math.sqrt(2) * sigma,))(c, c)
    inverse, lam = lsdd_select(h[1:] if permutations else h, gram, rd_max)
    return permutation_report(np.einsum("pi,ij,pj->p", h, inverse, h), p_val) | {"lambda": lam}


def one_segment(both: DataFrame, segment: str | None, run: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """A report for each segment: the test of a segment is one task, as its linear
    algebra is cubic; a table has as many tasks as segments."""
    key = segment or "__all"
    held = both if segment else both.withColumn(key, F.lit("all"))

    def apply(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"segment": str(k[0])} | run(pdf)])

    return held.groupBy(key).applyInPandas(apply, f"segment string, {schema}")


def _tile_pairs(left: DataFrame, right: DataFrame, id_col: str, vec_col: str, size: int):
    """Grouped tiles of two tables, each pair of tiles once: columns id, v."""
    n, m = (max(1, math.ceil(c / block_size(c, size))) for c in (left.count(), right.count()))
    x, y = dealt(left, id_col, vec_col, "i", n, "j", m), dealt(right, id_col, vec_col, "j", m, "i", n)
    return x.groupBy("i", "j").cogroup(y.groupBy("i", "j"))


def kernel_rows(left: DataFrame, right: DataFrame, kernel: Callable, id_col: str = "id", vec_col: str = "features", size: int = TILE) -> DataFrame:
    """``a, total, nearest``: for each row of one table the sum of the kernel over the
    other, and its largest value at a row of another id. A tile leaves a row for each
    of its own, not for each pair, and holds the kernel of few of them at a time."""

    def evaluate(a: pa.Table, b: pa.Table) -> pa.Table:
        ka, kb = a.column("id").to_numpy(), b.column("id").to_numpy()
        total, others = np.zeros(len(a)), np.full(len(a), -np.inf)
        own = np.isin(ka, kb)
        x, y = as_matrix(a.column("v")), as_matrix(b.column("v"))
        for s, k in strips(kernel, x, y) if len(a) and len(b) else ():
            at = np.arange(s, s + len(k))
            total[at] = k.sum(1)
            for i in at[own[at]]:
                k[i - s, kb == ka[i]] = -np.inf
            others[at] = k.max(1)
        return pa.table({"a": ka, "total": total, "nearest": pa.array(others, pa.float64(), mask=others == -np.inf)})

    kind = dict(left.dtypes)[id_col]
    tiles = _tile_pairs(left, right, id_col, vec_col, size).applyInArrow(evaluate, f"a {kind}, total double, nearest double")
    return tiles.groupBy("a").agg(F.sum("total").alias("total"), F.max("nearest").alias("nearest"))


def kernel_matrix(left: DataFrame, right: DataFrame, kernel: Callable, id_col: str = "id", vec_col: str = "features", size: int = TILE) -> DataFrame:
    """``a, b, k``: the kernel of all pairs of two tables, in tiles. Its rows are the
    product of the tables': for reports on small samples; ``kernel_rows`` and the
    tests leave sums alone."""

    def evaluate(a: pa.Table, b: pa.Table) -> pa.Table:
        ka, kb = a.column("id").to_numpy(), b.column("id").to_numpy()
        k = kernel(as_matrix(a.column("v")), as_matrix(b.column("v"))) if len(a) and len(b) else np.zeros((len(a), len(b)))
        return pa.table({"a": np.repeat(ka, len(kb)), "b": np.tile(kb, len(ka)), "k": k.ravel()})

    kind = dict(left.dtypes)[id_col]
    return _tile_pairs(left, right, id_col, vec_col, size).applyInArrow(evaluate, f"a {kind}, b {kind}, k double")
