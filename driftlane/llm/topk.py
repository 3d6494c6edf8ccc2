"""Exact maximum inner product search over norm buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.llm import common, vectors
from driftlane.llm.sharding import range_of

#: Rows of a bucket or a part of it, and queries, that meet in one task.
BUCKET = 4096
QUERY_BLOCK = 8192
#: Queries that are multiplied at a time.
SLICE = 256
#: The longest vectors, against which first thresholds are found.
HEAD = 1024
#: From this local cosine threshold on, a bucket is pruned by coordinates.
COORDINATE_FROM = 0.6
FOCUS = 3
#: Buckets by length at most; fuller ones are split by hash.
MAX_RANGES = 4096
#: Pairs of buckets and query blocks that are broadcast at most; more are joined.
MAX_CELLS = 1 << 18


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows. Doubles hold them as long as no sum
    passes 2**53; then 64-bit integers; beyond those Python integers, held to the
    range of a long."""
    top = lambda x: int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0
    bound = top(q) * top(p) * max(1, q.shape[1])
    if bound < 1 << 53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return q @ p.T
    wide = q.astype(object) @ p.astype(object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def search_bucket(q: np.ndarray, theta: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which pairs of queries and vectors of a bucket may reach the thresholds.

    ``t``, the local cosine threshold, is what a query's threshold asks of the
    longest vector. Above 1 the bucket is left out. From COORDINATE_FROM on the
    bucket is pruned by coordinates: a unit vector at cosine t or more has, in the
    query's largest coordinates, a value within bounds that follow from t. Below,
    by length: only vectors of length theta / |q| or more can reach the threshold.
    """
    q_len, p_len = _norms(q), _norms(p)
    longest = p_len.max(initial=0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = theta / (q_len * longest)
        need = theta / q_len
    t = np.where(theta <= 0, -1.0, np.where(np.isnan(t) | np.isinf(t), 2.0, t)) - 1e-9
    mask = np.zeros((len(q), len(p)), bool)
    by_length = (t < COORDINATE_FROM) & (t <= 1)
    mask[by_length] = np.where(theta[by_length] <= 0, -1.0, need[by_length] * (1 - 1e-9))[:, None] <= p_len[None]
    for i in np.flatnonzero((t >= COORDINATE_FROM) & (t <= 1)).tolist():
        unit = q[i] / q_len[i]
        ok = np.ones(len(p), bool)
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS].tolist():
            u, spread = unit[f], np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - t[i] ** 2)))
            low = -1.0 if u <= -t[i] else u * t[i] - spread
            high = 1.0 if u >= t[i] else u * t[i] + spread
            x = p[:, f] / np.maximum(p_len, 1e-300)
            ok &= (x >= low - 1e-9) & (x <= high + 1e-9)
        mask[i] = ok
    return mask


def top_k(df: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "vector", bucket: int = BUCKET, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` largest inner products of each query row with all other rows.

    ``vec_col`` holds arrays of long; ``query`` marks the query rows. Returns
    ``query_id``, ``rank`` int from 1, ``id_col`` and ``score`` long, ties to the
    smaller id; fewer than ``k`` if there are fewer rows. Null, empty and
    null-holding vectors and rows with a null id take no part; vectors of other
    lengths than the query's are no candidates. A repeated row is another row.

    Rows are grouped by length into buckets. A first threshold comes from the
    ``HEAD`` longest rows, which are broadcast. A query goes to the buckets whose
    longest row can reach its threshold, in blocks of ``query_block`` queries; a bucket
    goes to the blocks that ask for it. A task holds one of each (of a bucket with
    more than ``bucket`` rows a part), and products of what is left there are exact.
    So a row is sent once for each block that asks for its bucket and a query once
    for each bucket part that it asks for, which is little against the products of a
    block and a part.
    """
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(vec_col, lambda x: x.isNull())
    held, n, n_queries = vectors.numbered(df.where(ok), id_col, F.col(vec_col).cast("array<bigint>"), query, "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    held = held.withColumn("len", F.sqrt(squares)).withColumn("dim", F.size("v"))
    schema = f"qrow long, qid {dict(held.dtypes)['id']}, row long, id {dict(held.dtypes)['id']}, score long"

    # buckets: ranges of length, the fuller ones split
    ranges = min(MAX_RANGES, vectors.blocks_of(n, bucket))
    cuts = held.agg(F.percentile_approx("len", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)).first()[0] or []
    scale = float(1 << 20)  # cuts as whole numbers
    at = range_of((F.col("len") * scale).cast("long"), sorted({int(c * scale) for c in cuts}))
    ranged = held.withColumn("range", at)
    # MAX_RANGES rows at most for each length of vectors
    full = common.stage(ranged.groupBy("range", "dim").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("subs"), F.max("len").alias("longest")), "buckets")
    split = ranged.join(F.broadcast(full.drop("longest")), ["range", "dim"]).withColumn("sub", F.pmod(F.xxhash64("row"), "subs").cast("int"))

    # first thresholds
    head = held.orderBy(F.col("len").desc(), "row").limit(HEAD).select("row", "v", "dim").collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {d: (np.array([r.row for r in head if r.dim == d]), np.array([r.v for r in head if r.dim == d], np.int64)) for d in {r.dim for r in head}}

    def first(batches):
        for whole in batches:
            for b in common.slices(whole, rows=SLICE):
                row, dim = b.column("row").to_numpy(), b.column("dim").to_numpy()
                out = np.full(len(row), -np.inf)
                for d in np.unique(dim).tolist():
                    near_row, near = by_dim.get(d, (np.zeros(0, np.int64), np.zeros((0, d), np.int64)))
                    on = np.flatnonzero(dim == d)
                    q = vectors.matrix(pa.chunked_array([b.column("v").take(pa.array(on))]), np.int64)
                    s = products(q, near).astype(np.float64) if len(near) else np.zeros((len(on), 0))
                    s[row[on][:, None] == near_row[None]] = -np.inf  # not its own neighbour
                    if s.shape[1] >= k:
                        out[on] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "theta"])

    asked = held.where("query").select(F.col("row"), F.col("id"), F.col("v"), F.col("len"), F.col("dim"))
    asked = asked.mapInArrow(first, ", ".join(f"{c} {t}" for c, t in asked.dtypes) + ", theta double")
    q_blocks = vectors.blocks_of(n_queries, query_block)
    asked = asked.withColumn("qblock", F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int"))
    reach = (F.col("theta") <= 0) | (F.col("len") * F.col("longest") * (1 + 1e-9) >= F.col("theta"))
    met = asked.join(F.broadcast(full), "dim").where(reach)
    each_part = F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")
    sent = met.select("dim", "range", each_part, "qblock", "row", "id", "v", "theta")
    # a bucket goes to the query blocks that ask for it, and to no other
    cells = met.select("dim", "range", "subs", "qblock").distinct()
    if full.count() * q_blocks <= MAX_CELLS:
        there = split.join(F.broadcast(cells.drop("subs")), ["dim", "range"])
    else:
        there = split.join(cells.select("dim", "range", each_part, "qblock"), ["dim", "range", "sub"])
    columns = ["dim", "range", "sub", "qblock", "row", "id", "v"]
    there = there.select(*columns).toDF(*columns)

    def verify(queries: pa.Table, bucket: pa.Table) -> pa.Table:
        q, p = vectors.matrix(queries.column("v"), np.int64), vectors.matrix(bucket.column("v"), np.int64)
        out = ([], [], [], [], [])
        if len(q) and len(p):
            theta = queries.column("theta").to_numpy()
            q_row, q_id = queries.column("row").to_numpy(), queries.column("id").to_numpy()
            p_row, p_id = bucket.column("row").to_numpy(), bucket.column("id").to_numpy()
            for a in range(0, len(q), SLICE):
                part = slice(a, a + SLICE)
                mask = search_bucket(q[part], theta[part], p) & (q_row[part, None] != p_row[None])
                rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
                if not len(rows):
                    continue
                scores = products(q[part][rows], p[cols])
                mask = mask[np.ix_(rows, cols)] & (scores >= theta[part][rows][:, None])
                for i in np.flatnonzero(mask.any(1)).tolist():
                    on = np.flatnonzero(mask[i])
                    on = on[np.lexsort((p_id[cols][on], -scores[i, on]))][:k]
                    for col, values in zip(out, (np.full(len(on), q_row[part][rows[i]]), np.full(len(on), q_id[part][rows[i]]), p_row[cols][on], p_id[cols][on], scores[i, on])):
                        col.append(values)
        joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(joined, names=["qrow", "qid", "row", "id", "score"])

    keys = ["dim", "range", "sub", "qblock"]
    found = sent.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(verify, schema)
    return vectors.best(found, id_col, k)
