"""Operators over several blocks of rows, against the whole matrices."""

from contextlib import contextmanager

import numpy as np

from driftlane.operators import kernels, neighbours


@contextmanager
def partitions(spark, n: int):
    """Shuffles into ``n`` partitions that aren't put together again."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def frame(spark, x: np.ndarray, start: int = 0):
    return spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")


def test_blocks_meet_in_any_partitions(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(70, 5)), rng.normal(size=(90, 5))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    k = np.exp(-d * d / 2)
    left, right = frame(spark, x), frame(spark, y, 1000)
    with partitions(spark, 7):
        near = {(r.id, r.rank): (r.neighbour, r.distance) for r in neighbours.neighbours(left, right, 4, block=20).collect()}
        own = {(r.id, r.rank): r.neighbour for r in neighbours.neighbours(right, right, 2, block=20, skip_self=True).collect()}
        sums = {r.a: r for r in kernels.kernel_rows(left, right, kernels.GaussianRBF((1.0,)), size=20).collect()}
        pairs = {(r.a, r.b): r.k for r in kernels.kernel_matrix(left, right, kernels.GaussianRBF((1.0,)), size=20).collect()}
    assert len(near) == 280 and len(own) == 180 and len(pairs) == 6300
    for i in range(70):
        for rank, j in enumerate(np.argsort(d[i])[:4]):
            assert near[i, rank + 1][0] == 1000 + j and abs(near[i, rank + 1][1] - d[i, j]) < 1e-9
        assert abs(sums[i].total - k[i].sum()) < 1e-9 and abs(sums[i].nearest - k[i].max()) < 1e-9
        assert all(abs(pairs[i, 1000 + j] - k[i, j]) < 1e-9 for j in range(90))


def test_number_of_blocks_is_bounded():
    for rows in (10, 5000, 10**5, 10**6):
        assert rows / neighbours.block_size(rows, neighbours.BLOCK) <= neighbours.BLOCKS
    assert neighbours.block_size(10**9, neighbours.BLOCK) == neighbours.MAX_BLOCK
