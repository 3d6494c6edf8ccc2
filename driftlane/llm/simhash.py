"""SimHash fingerprints and the groups of documents that they link."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlane.llm import common
from driftlane.llm.components import connected_components

#: Fingerprints in a tile of the comparison.
TILE = 1024
#: Fingerprints of a cell, and probes of it, that one task holds, at least and at most.
CELL = (1 << 10, 1 << 17)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included.

    A-Z become lower case, words are runs without blanks or control white space,
    a text of fewer words has itself as its one shingle, and one without words
    (null too) has fingerprint 0. A bit is set if over half the hashes set it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        spans = zip(starts[a : min(n, a + (1 << 16))].tolist(), last[a : a + (1 << 16)].tolist())
        hashes = np.array([digest(line[i:j], seed) for i, j in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``id_col`` and ``fp`` long (the 64 bits as a signed number), a row per row."""
    schema = T.StructType([common.field(docs, id_col), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 1):
                got = np.array([fingerprint(t, shingle, seed) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.view(np.int64))], [id_col, "fp"])

    return common.spread(docs.select(id_col, text_col)).mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) of each component of links, apart from the least ones."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    on = root != np.arange(len(nodes))
    return nodes[on], nodes[root[on]]


def _quarters(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts, a row per fingerprint."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _compare(home: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sets of fingerprints, as a forest.

    Both are sorted by the population counts of their parts and cut into tiles. A
    tile pair is left out if the counts of the parts, which the tiles hold within
    ranges, differ by more than the radius in sum: each differing bit changes one
    count by one. All other pairs of tiles are compared bit by bit.
    """
    tiles = []
    for fp in (home, probe):
        parts = _quarters(fp)
        order = np.lexsort(parts.T[::-1])
        fp, parts = fp[order], parts[order]
        at = np.arange(0, len(fp), TILE)
        tiles.append((fp, at, np.minimum.reduceat(parts, at), np.maximum.reduceat(parts, at)))
    (h, h_at, h_lo, h_hi), (p, p_at, p_lo, p_hi) = tiles
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, a in enumerate(h_at.tolist()):
        gap = np.maximum(0, np.maximum(p_lo - h_hi[k], h_lo[k] - p_hi)).sum(1)
        x = h[a : a + TILE].view(np.uint64)[:, None]
        for m in np.flatnonzero(gap <= radius).tolist():
            y = p[p_at[m] : p_at[m] + TILE]
            i, j = np.nonzero(np.bitwise_count(x ^ y.view(np.uint64)[None]) <= radius)
            if len(i):
                u, v = h[a : a + TILE][i], y[j]
                on = u != v
                u, v = _forest(u[on], v[on]) if on.any() else (u[:0], v[:0])
                left.append(u)
                right.append(v)
    u, v = np.concatenate(left), np.concatenate(right)
    return _forest(u, v) if len(u) else (u, v)


def parts_for(n: int) -> int:
    """Into how many parts fingerprints are cut for their cells. More parts make
    more and smaller cells, and more neighbours of a cell: two parts suit up to
    some ten million fingerprints, eight those of the largest corpora. The links
    that are found are the same."""
    return 2 if n <= 1 << 25 else 4 if n <= 1 << 33 else 8


def steps(parts: int, radius: int) -> list[int]:
    """What is added to a cell's code to reach the cells after it within the radius."""
    ball = [(0, 0)]
    for i in range(parts):
        ball = [(used + abs(d), code + d * 128**i) for used, code in ball for d in range(-radius, radius + 1) if used + abs(d) <= radius]
    return sorted(code for _, code in ball if code > 0)


def cell_for(n: int) -> int:
    """How many of ``n`` fingerprints of a cell one task holds: a small share of all
    within the bounds of CELL, so that no task stands out and memory is bounded."""
    return min(CELL[1], max(CELL[0], n >> 5))


def links(fps: DataFrame, radius: int = 2, parts: int = 2, cell: int = CELL[1]) -> DataFrame:
    """Links ``a``, ``b`` that join all distinct fingerprints ``fp`` (long) at
    ``radius`` or fewer differing bits: as many as keep each group connected.

    A cell is the population counts of the ``parts`` equal parts of a fingerprint,
    seven bits each in one code. A link's ends lie in cells whose counts differ by
    ``radius`` at most in sum, so each fingerprint goes to its own cell and, as a
    probe, to the cells after its own within that distance. A cell with more than
    ``cell`` fingerprints or probes is split into a grid: each part of the
    fingerprints meets each part of the probes. The split cells, at most a few for
    each ``cell`` fingerprints, are broadcast.
    """
    width = 64 // parts
    mask = (1 << width) - 1
    pops = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask))).cast("long") for i in range(parts)]
    held = fps.select("fp", sum(((p + radius) * F.lit(128**i) for i, p in enumerate(pops)), F.lit(0).cast("long")).alias("cell"))
    reach = lambda ds: F.explode(F.array(*[F.lit(d).cast("long") for d in ds]))
    # fingerprints and probes of each cell: a row per cell
    cells = held.groupBy("cell").agg(F.count(F.lit(1)).alias("homes"))
    probed = cells.select(reach(steps(parts, radius)).alias("d"), "cell", "homes").groupBy((F.col("cell") + F.col("d")).alias("cell")).agg(F.sum("homes").alias("probes"))
    grid = cells.join(probed, "cell", "left").select("cell", F.ceil(F.col("homes") / cell).cast("int").alias("rows"), "homes", F.coalesce("probes", F.lit(0)).alias("probes"))
    # a split cell also meets itself across its parts
    grid = grid.select("cell", "rows", F.greatest(F.lit(1), F.ceil((F.col("probes") + F.when(F.col("rows") > 1, F.col("homes")).otherwise(0)) / cell)).cast("int").alias("cols"))
    grid = F.broadcast(grid.where((F.col("rows") > 1) | (F.col("cols") > 1)))
    rows, cols = F.coalesce("rows", F.lit(1)), F.coalesce("cols", F.lit(1))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    home = held.join(grid, "cell", "left").select("fp", "cell", F.pmod(F.xxhash64("fp"), rows).cast("int").alias("part"), each(cols).alias("side"), F.lit(0).alias("probe"))
    away = held.select("fp", reach([0, *steps(parts, radius)]).alias("d"), "cell").select("fp", "d", (F.col("cell") + F.col("d")).alias("cell"))
    away = away.join(grid, "cell", "left").where((F.col("d") > 0) | (rows > 1))
    away = away.select("fp", "cell", F.pmod(F.xxhash64("fp", F.lit(1)), cols).cast("int").alias("side"), each(rows).alias("part"), F.lit(1).alias("probe")).select(*home.columns)

    def run(table: pa.Table) -> pa.Table:
        fp, probe = table.column("fp").to_numpy(), table.column("probe").to_numpy()
        home, away = fp[probe == 0], fp[probe == 1]
        u, v = [np.zeros(0, np.int64)] * 2
        if len(home):
            alone = table.column("side")[0].as_py() == 0  # one side of the grid compares a part with itself
            got = [_compare(home, home, radius)] * alone + ([_compare(home, away, radius)] if len(away) else [])
        if len(home) and got:
            u, v = (np.concatenate(x) for x in zip(*got))
        return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})

    return home.unionAll(away).groupBy("cell", "part", "side").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """Groups of documents whose fingerprints a chain of links joins.

    Returns ``id_col``, ``fingerprint`` string (16 lowercase hexadecimal digits)
    and ``component_id`` (the least id in the group), one row per input row,
    repeated ids included. Documents without words, null texts too, have
    fingerprint zero and link like any other. A null id keeps its row and is never
    the least; a group of null ids alone has a null ``component_id``. Other columns
    are not read. Copies fall together before the comparison, and neither a group
    nor a fingerprint that many rows share has to fit into one task.
    """
    held = fingerprints(docs, id_col, text_col, shingle, seed).toDF("id", "fp")
    held = common.stage(held.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    nodes = common.stage(held.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    count = nodes.count()
    roots = connected_components(links(nodes.select("fp"), radius, parts_for(count), cell_for(count)))
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.col("n").alias("copies"), F.coalesce("root", "fp").alias("root"))
    joined = common.stage(joined, "groups")
    firsts = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = common.join_hot(joined.select("fp", "root", "copies"), firsts, "root", F.xxhash64("fp")).select("fp", "component_id", F.col("copies").alias("n"))
    out = common.join_hot(held, named, "fp", F.col("row"))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
