"""Approximate maximum inner product search with score-aware four-bit codes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.llm import vectors

#: Rows on which the codebooks are fitted.
SAMPLE = 10_000
CENTRES = 16
WIDTH = 2  # components in a subspace
#: Inner products count from this share of the lengths on; sets the weight of the parallel error.
THRESHOLD = 0.2
ROUNDS = 5
#: Rows of a block, at least and at most, into how many blocks a table of a size between is cut, and queries of a block.
BLOCK = (512, 1 << 16)
BLOCKS = 12
QUERY_BLOCK = 1 << 14
#: Queries whose codes are scanned at a time.
SLICE = 64
#: Rows of each block that are reranked for each query, at least.
RERANK = 256


class Codebook:
    """Product quantiser whose loss weighs the residual along the vector more.

    For a vector x with residual r, split into the part along x and the rest, the
    loss is |r|^2 + w (r . x / |x|)^2 with w = (d - 1) T^2 / (1 - T^2) - 1, T the
    threshold: errors along x change large inner products most.
    """

    def __init__(self, sample: np.ndarray, threshold: float = THRESHOLD, rounds: int = ROUNDS, seed: int = 7):
        self.dim = sample.shape[1]
        self.parts = -(-self.dim // WIDTH)
        self.parts += self.parts % 2  # two codes to a byte
        self.weight = max(0.0, (self.dim - 1) * threshold**2 / (1 - threshold**2) - 1)
        x, unit = self._split(sample)
        rng = np.random.default_rng(seed)
        pick = rng.choice(len(sample), CENTRES, replace=len(sample) < CENTRES)
        self.centres = x[pick].transpose(1, 0, 2).copy()  # part, centre, component
        weight, self.weight = self.weight, 0.0
        for turn in range(2 * rounds):
            if turn == rounds:
                self.weight = weight
            self._update(x, unit, self._assign(x, unit))

    def _split(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.astype(np.float64)
        padded = np.zeros((len(rows), self.parts * WIDTH))
        padded[:, : self.dim] = rows
        length = np.linalg.norm(padded, axis=1, keepdims=True)
        unit = padded / np.where(length > 0, length, 1)
        return padded.reshape(len(rows), self.parts, WIDTH), unit.reshape(len(rows), self.parts, WIDTH)

    def _assign(self, x: np.ndarray, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        n = len(x)
        codes = np.zeros((n, self.parts), np.uint8)
        along = np.zeros((n, self.parts))  # what each part adds to the parallel residual
        for sweep in range(sweeps if self.weight else 1):
            for s in range(self.parts):
                r = x[:, s, None, :] - self.centres[s][None]
                par = np.einsum("nkc,nc->nk", r, unit[:, s])
                loss = (r**2).sum(2)
                if sweep or not self.weight:
                    loss = loss + self.weight * (along.sum(1) - along[:, s])[:, None] * 2 * par + self.weight * par**2
                codes[:, s] = loss.argmin(1)
                along[:, s] = par[np.arange(n), codes[:, s]]
        return codes

    def _update(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        part = np.arange(self.parts)
        along = ((x - self.centres[part[None], codes]) * unit).sum(2)
        for s in range(self.parts):
            rest = along.sum(1) - along[:, s]
            at, u, v = codes[:, s], unit[:, s], x[:, s]
            n = np.bincount(at, minlength=CENTRES)
            add = lambda values: np.bincount(at, weights=values, minlength=CENTRES)
            lhs, rhs = np.zeros((CENTRES, WIDTH, WIDTH)), np.zeros((CENTRES, WIDTH))
            pull = rest + (v * u).sum(1)
            for i in range(WIDTH):
                rhs[:, i] = add(v[:, i]) + self.weight * add(u[:, i] * pull)
                for j in range(WIDTH):
                    lhs[:, i, j] = n * (i == j) + self.weight * add(u[:, i] * u[:, j])
            some = n > 0
            self.centres[s, some] = np.linalg.solve(lhs[some], rhs[some][..., None])[..., 0]
            along[:, s] = ((v - self.centres[s][at]) * u).sum(1)

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """Codes of two parts to a byte."""
        codes = self._assign(*self._split(rows), sweeps=3)
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte, what each value of the byte adds to the score."""
        q, _ = self._split(queries)
        one = np.einsum("qsc,skc->qsk", q, self.centres).astype(np.float32)
        return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), self.parts // 2, CENTRES * CENTRES)


def rows_of_block(n: int) -> int:
    """Rows of a block for a table of ``n`` rows."""
    return min(BLOCK[1], max(BLOCK[0], -(-n // BLOCKS)))


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate scores (query, row): sums of table entries."""
    out = np.zeros((len(tables), len(codes)), np.float32)
    for s in range(codes.shape[1]):
        out += np.take(tables[:, s], codes[:, s], axis=1)
    return out


def rerank_one(q: np.ndarray, x: np.ndarray, rough: np.ndarray, near: np.ndarray, k: int, order: np.ndarray, start: np.ndarray, row: np.ndarray, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the ``k`` best rows of a block for one query.

    ``x`` holds distinct vectors; the rows of vector g are ``order[start[g] :
    start[g + 1]]``, by id. ``near`` are the vectors with the best rough scores.
    """
    near = near[rough[near] > -np.inf]
    if not len(near):
        return np.zeros(0, np.int64), np.zeros(0)
    exact = np.einsum("rd,d->r", x[near], q)
    low = rough[near].min()
    kth = np.partition(exact, -min(k, len(exact)))[-min(k, len(exact))]
    low = min(low, kth - np.abs(exact - rough[near]).max())
    more = np.setdiff1d(np.flatnonzero((rough >= low) & (rough > -np.inf)), near)
    near, exact = np.concatenate([near, more]), np.concatenate([exact, np.einsum("rd,d->r", x[more], q)])
    kth = np.partition(exact, -min(k, len(exact)))[-min(k, len(exact))]
    near, exact = near[exact >= kth], exact[exact >= kth]
    # one more than k, as the query's own row may be among them
    places = [order[start[g] : min(start[g + 1], start[g] + k + 1)] for g in near.tolist()]
    at, score = np.concatenate(places), np.repeat(exact, [len(p) for p in places])
    at, score = at[row[at] != own], score[row[at] != own]
    best = np.lexsort((ids[at], -score))[:k]
    return at[best], score[best]


def nearest(df: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK, sample: int = SAMPLE, block: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """About the ``k`` largest inner products of each query row with all others.

    Returns ``query_id``, ``rank`` int from 1, ``id_col`` and ``score`` double (the
    inner product of the original vectors), ties to the smaller id; fewer than
    ``k`` if there are fewer rows. Null, empty and zero vectors, vectors with null
    or non-finite components and rows with a null id take no part; vectors with
    another number of components than the query's are no candidates. A repeated row
    is another row.

    For each number of components, codebooks are fitted on about ``sample`` rows
    drawn by hash; all rows are coded. Blocks of rows meet blocks of queries: a task
    scans the codes of one block by tables, and reranks the ``rerank`` best of each
    query by the original vectors, with all that tie with the last of them or whose
    rough score lies within the largest error of these below the ``k``-th exact score
    so far; a tight group may be a whole block, so the vectors lie beside their codes.
    Equal vectors are scanned once. ``rerank`` is never below ``k``. A row is sent
    once for each ``query_block`` queries, a query once for each block of rows.
    """
    ok = vectors.finite(F.col(vec_col)) & F.exists(F.col(vec_col), lambda x: x != 0)
    held, n, n_queries = vectors.numbered(df.where(ok), id_col, F.col(vec_col), query, "vectors")
    kind, vec = dict(held.dtypes)["id"], dict(held.dtypes)["v"]
    schema = f"qrow long, qid {kind}, row long, id {kind}, score double"
    dims = sorted(held.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q")).collect(), key=lambda r: r.d)
    found = [_nearest_of(held.where(F.size("v") == r.d), r.d, r.n, r.q, schema, kind, vec, k, max(rerank, k), sample, block, query_block) for r in dims if r.q]
    found = functools.reduce(DataFrame.unionAll, found) if found else df.sparkSession.createDataFrame([], schema)
    return vectors.best(found, id_col, k)


def _nearest_of(held: DataFrame, dim: int, n: int, n_queries: int, schema: str, kind: str, vec: str, k: int, depth: int, sample: int, block: int | None, query_block: int) -> DataFrame:
    """The best ``k`` of each block of rows for each query, among vectors of one length."""
    draw = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 40)) < min(1.0, sample / max(n, 1)) * (1 << 40)
    drawn = [r.v for r in held.where(draw).select("v").collect()]
    book = Codebook(np.array(drawn if drawn else [[1.0] * dim]))

    def code(batches):
        for b in batches:
            got = book.encode(vectors.matrix(pa.chunked_array([b.column("v")]), np.float64)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in got], pa.binary())], [*b.schema.names, "codes"])

    blocks, q_blocks = vectors.blocks_of(n, block or rows_of_block(n)), vectors.blocks_of(n_queries, query_block)
    index = held.select("row", "id", "v").mapInArrow(code, f"row long, id {kind}, v {vec}, codes binary")
    index = index.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    there = index.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asked = held.where("query").select("row", "id", "v", F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int").alias("qblock"))
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = ([], [], [], [], [])
        if len(queries) and len(rows):
            q, x = vectors.matrix(queries.column("v"), np.float64), vectors.matrix(rows.column("v"), np.float64)
            q_row, q_id = queries.column("row").to_numpy(), queries.column("id").to_numpy()
            row, ids = rows.column("row").to_numpy(), rows.column("id").to_numpy()
            _, group = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)
            order = np.lexsort((row, ids, group))
            start = np.searchsorted(group[order], np.arange(group.max() + 2))  # members of each group, by id
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
            distinct = order[start[:-1]]
            x, codes = x[distinct], codes[distinct]
            own = {int(r): int(g) for r, g in zip(row, group)}
            take = min(depth, len(x))
            for a in range(0, len(q), SLICE):
                part = q[a : a + SLICE]
                rough = scan(book.tables(part), codes)
                mine = q_row[a : a + SLICE].tolist()
                # a query row that has no copies is no candidate of its own
                for i, r in enumerate(mine):
                    if (g := own.get(r)) is not None and start[g + 1] - start[g] == 1:
                        rough[i, g] = -np.inf
                near = np.argpartition(-rough, take - 1, axis=1)[:, :take]
                for i, r in enumerate(mine):
                    at, score = rerank_one(part[i], x, rough[i], near[i], k, order, start, row, ids, r)
                    for col, values in zip(out, (np.full(len(at), r), np.full(len(at), q_id[a + i]), row[at], ids[at], score)):
                        col.append(values)
        kinds = (np.int64,) * 4 + (np.float64,)
        return pa.table([np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, kinds)], names=["qrow", "qid", "row", "id", "score"])

    return sent.groupBy("block", "qblock").cogroup(there.groupBy("block", "qblock")).applyInArrow(search, schema)
