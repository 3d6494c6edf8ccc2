"""Byte-level BPE encoding and decoding over padded numpy matrices."""

from __future__ import annotations

import base64
import functools
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftlane.llm import common
from driftlane.llm.pretokens import PieceStore

NONE = np.iinfo(np.int32).max
#: Width of a matrix: a longer row stands in several lines of one.
LINE = 256


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank of its join."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(rank), 1) * 2.5))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo = self._home(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            at, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[at], self.vals[at] = key[won], rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            lost = self.keys[slot[todo]] != key[todo]
            slot[todo] = np.where(lost, (slot[todo] + 1) & self.mask, slot[todo])
            todo = todo[lost]

    def _home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the join is no token (or an id is -1)."""
        shape = left.shape
        key = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        out = np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._home(key[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.vals[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class ByteBPE:
    """Encoder and decoder for a byte-level BPE vocabulary.

    ``merges`` lists the pairs that may join, as ``(left, right, joined)`` ids
    where a smaller joined id merges first. Without it any two tokens whose
    bytes together are a token may join, and a piece that is a token stays whole,
    as is usual for files of ranks. ``added`` gives the ids of tokens that are cut
    out of a text before the pattern runs.
    """

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[int, int, int]] | None = None, added: dict[str, int] | None = None):
        self.ranks, self.whole, self.added = ranks, ranks if merges is None else {}, added or {}
        named = ranks | {tok.encode(): r for tok, r in self.added.items()}
        self.tokens = [b""] * (max(named.values()) + 1)
        for tok, r in named.items():
            self.tokens[r] = tok
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = merges if merges is not None else [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(found, np.int32).reshape(-1, 3).T)
        b = np.arange(256)
        self.byte_pairs = self.pairs.rank(*np.broadcast_arrays(self.byte_id[b][:, None], self.byte_id[b][None]))  # where every row starts
        sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.token_len, self.token_start = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def load(path: str) -> ByteBPE:
        """From a file of ranks (``base64 rank`` lines), or from the JSON of a
        byte-level BPE tokenizer, whose listed merges alone then apply, and whose
        added tokens are those that the library finds in texts by default."""
        if not path.endswith(".json"):
            with open(path, "rb") as f:
                return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, added = whole["model"], whole.get("added_tokens") or []
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at the text around them are not supported")
        # the printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ids = model["vocab"]
        merges = []
        for order, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges.append((ids[left], ids[right], ids[left + right]))
            if order and merges[-1][2] <= merges[-2][2]:
                raise ValueError("the ids of joined tokens must rise in the order of the merges")
        return ByteBPE({bytes(byte_of[c] for c in t): i for t, i in ids.items()}, merges, {t["content"]: t["id"] for t in added})

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each pre-token, joined, and the number of ids of each."""
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.fromiter(map(self.whole.get, raw, itertools.repeat(-1)), np.int64, len(raw)) if self.whole else np.full(len(raw), -1)
        lengths = np.ones(len(raw), np.int32)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # rows, and a padded matrix of their ids
        known = np.flatnonzero(whole >= 0)
        parts.append((known, whole[known].astype(np.int32)[:, None]))
        for i in np.flatnonzero((whole < 0) & (size > LINE)).tolist():
            parts.append((np.array([i]), self._merge_lines(raw[i])[None]))
        short = np.flatnonzero((whole < 0) & (size <= LINE))
        for width in np.unique(-(-size[short] // 4) * 4).tolist():
            rows = short[(size[short] > width - 4) & (size[short] <= width)]
            for a in range(0, len(rows), 1 << 15):
                part = rows[a : a + (1 << 15)]
                parts.append((part, self._merge_matrix([raw[i] for i in part.tolist()], width)))
        for rows, mat in parts:
            lengths[rows] = (mat >= 0).sum(1)
        start = np.cumsum(lengths, dtype=np.int64) - lengths
        flat = np.empty(int(lengths.sum()), np.int32)
        for rows, mat in parts:
            on = mat >= 0
            flat[(start[rows][:, None] + np.arange(mat.shape[1])[None])[on]] = mat[on]
        return flat, lengths

    def _merge_matrix(self, rows: list[bytes], width: int) -> np.ndarray:
        """Every row merges its leftmost minimum-rank pair each round. The ids of
        each row, padded with -1."""
        n, cols = len(rows), np.arange(width)
        mat = np.full((n, width), -1, np.int32)
        size = np.fromiter(map(len, rows), np.int64, n)
        inside = cols[None] < size[:, None]
        raw = np.zeros((n, width), np.uint8)
        raw[inside] = np.frombuffer(b"".join(rows), np.uint8)
        mat[inside] = self.byte_id[raw[inside]]
        done = np.full((n, width), -1, np.int32)
        rank = np.full((n, width), NONE, np.int32)  # of the pair that begins at each place
        rank[:, :-1] = np.where(inside[:, 1:], self.byte_pairs[raw[:, :-1], raw[:, 1:]], NONE)
        live = np.arange(n)
        while len(live):
            j = rank.argmin(axis=1)
            at = np.arange(len(live))
            best = rank[at, j]
            on = best != NONE
            done[live[~on], : mat.shape[1]] = mat[~on]
            live, mat, rank, j, best = live[on], mat[on], rank[on], j[on], best[on]
            if not len(live):
                break
            at = np.arange(len(live))
            mat[at, j] = best
            w = mat.shape[1]
            src = np.minimum(np.arange(w)[None] + (np.arange(w)[None] > j[:, None]), w - 1)  # compaction
            tail = mat[:, -1].copy()
            mat, rank = np.take_along_axis(mat, src, 1), np.take_along_axis(rank, src, 1)
            mat[:, -1], rank[:, -1] = np.where(j == w - 1, tail, -1), NONE
            right = np.where(j + 1 < w, mat[at, np.minimum(j + 1, w - 1)], -1)
            rank[at, j] = self.pairs.rank(mat[at, j], right)
            had = np.flatnonzero(j > 0)
            rank[had, j[had] - 1] = self.pairs.rank(mat[had, j[had] - 1], mat[had, j[had]])
        return done

    def _merge_lines(self, row: bytes) -> np.ndarray:
        """The same for one row of any length, in a matrix of its lines: the first of
        the lines whose least rank is the minimum holds the leftmost such pair. A merge
        compacts one line, so a round costs a line and the minima of all."""
        lines = -(-len(row) // LINE)
        mat = np.full((lines, LINE), -1, np.int32)
        mat.ravel()[: len(row)] = self.byte_id[np.frombuffer(row, np.uint8)]
        fill = np.full(lines, LINE)
        fill[-1] = len(row) - LINE * (lines - 1)
        after, before = np.arange(1, lines + 1), np.arange(-1, lines - 1)  # the next and last lines that hold anything
        flat = mat.ravel()
        rank = np.full(mat.shape, NONE, np.int32)  # of the pair that begins at each place, also across lines
        rank.ravel()[:-1] = self.pairs.rank(flat[:-1], flat[1:])
        least = rank.min(axis=1)

        def drop(line: int, at: int) -> None:
            """Take out one place of a line; a line without any is passed over."""
            end = fill[line] = fill[line] - 1
            mat[line, at:end], rank[line, at:end] = mat[line, at + 1 : end + 1], rank[line, at + 1 : end + 1]
            mat[line, end], rank[line, end] = -1, NONE
            if not end:
                if before[line] >= 0:
                    after[before[line]] = after[line]
                if after[line] < lines:
                    before[after[line]] = before[line]

        while True:
            k = int(least.argmin())
            if least[k] == NONE:
                return mat[mat >= 0]
            j = int(rank[k].argmin())
            mat[k, j] = least[k]
            touched = {k}
            if j + 1 < fill[k]:
                drop(k, j + 1)
            else:
                touched.add(int(after[k]))
                drop(int(after[k]), 0)
            # the pairs that begin and end at the new token
            if j > 0:
                left = (k, j - 1)
            else:
                left = (int(before[k]), int(fill[before[k]]) - 1) if before[k] >= 0 else None
            right = (k, j + 1) if j + 1 < fill[k] else (int(after[k]), 0) if after[k] < lines else None
            ids = np.array([mat[left] if left else -1, mat[k, j], mat[right] if right else -1])
            new = self.pairs.rank(ids[:-1], ids[1:])
            if left:
                rank[left] = new[0]
                touched.add(left[0])
            rank[k, j] = new[1]
            for line in touched:
                least[line] = rank[line].min()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids; an id that is no token raises ValueError."""
        if len(ids) and (int(ids.max()) >= len(self.tokens) or not self.token_len[ids].all()):
            raise ValueError("an id is outside the vocabulary")
        lengths = self.token_len[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.token_bytes[np.repeat(self.token_start[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()


@functools.lru_cache(maxsize=2)
def piece_store(path: str, pattern: str) -> PieceStore:
    bpe = ByteBPE.load(path)
    return PieceStore(bpe.encode_pieces, pattern, added=bpe.added)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Token ids of every whole text.

    Returns ``id_col``, ``n_tokens`` long, ``ids`` binary (little-endian unsigned
    32-bit) and, with ``decode``, ``decoded`` binary: the bytes that the ids stand
    for. One row per input row, repeated rows and null ids included. A null or
    empty text has no tokens. Other columns are not read. ``ranks_path`` names a
    file of ranks that every worker can open.
    """
    fields = [common.field(docs, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.BinaryType())] * decode

    def run(batches):
        store, bpe = piece_store(ranks_path, pattern), ByteBPE.load(ranks_path)
        for batch in batches:
            for part in common.slices(batch, 1):
                store.trim()
                numbers = [store.number(t or "") for t in part.column(1).to_pylist()]
                store.settle()
                ids = [store.gather(x) for x in numbers]
                cols = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if decode:
                    cols.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return common.spread(docs.select(id_col, text_col)).mapInArrow(run, T.StructType(fields))


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that a column of little-endian unsigned 32-bit ids stands
    for. Null ids decode to null. ``out_col`` replaces a column of that name."""
    kept = [f for f in tokens.schema.fields if f.name != out_col]
    at = next(i for i, f in enumerate(kept) if f.name == ids_col)

    def run(batches):
        bpe = ByteBPE.load(ranks_path)
        for batch in batches:
            for part in common.slices(batch, at):
                got = [None if b is None else bpe.decode(np.frombuffer(b, "<u4").astype(np.int64)) for b in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*part.schema.names, out_col])

    return tokens.select(*[f.name for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(out_col, T.BinaryType())]))
