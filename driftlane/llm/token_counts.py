"""Token counts that follow edits: segment trees of pre-tokens per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlane.llm import common
from driftlane.llm.bpe import piece_store
from driftlane.llm.pretokens import PieceStore

#: Pre-tokens that a leaf holds when the tree is built.
LEAF = 64
#: The pattern decides on a match from at most two characters past its end
#: (a contraction, or the non-blank that ends a run of white space).
LOOKAHEAD = 2


class CountTree:
    """Pre-tokens of one text in leaves under a binary tree of sums.

    A leaf is the arrays (characters, tokens) of consecutive pre-tokens. Node
    sums hold characters, tokens and pre-tokens, so a place in the text is found
    and a change passed up in logarithmic time.
    """

    def __init__(self, text: str, store: PieceStore, numbers: np.ndarray | None = None, sizes: np.ndarray | None = None):
        self.text, self.store = text, store
        if numbers is None:
            found, numbers = store.number_pieces(text)
            store.settle()
            sizes = np.fromiter(map(len, found), np.int64, len(found))
        tokens = store.length[numbers].astype(np.int64)
        n = max(1, -(-len(numbers) // LEAF))
        self.leaves = [(sizes[a : a + LEAF], tokens[a : a + LEAF]) for a in range(0, max(len(numbers), 1), LEAF)]
        self.width = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        if len(numbers):
            at = np.arange(0, len(numbers), LEAF)
            self.sums[self.width : self.width + n] = np.stack([np.add.reduceat(sizes, at), np.add.reduceat(tokens, at), np.diff([*at, len(numbers)])], 1)
        w = self.width
        while w > 1:
            self.sums[w // 2 : w] = self.sums[w : 2 * w : 2] + self.sums[w + 1 : 2 * w : 2]
            w //= 2
        self.reencoded = 0

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def pretokens(self) -> int:
        return int(self.sums[1, 2])

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character and the characters before the leaf."""
        node, before = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            node, before = (2 * node, before) if char < before + left else (2 * node + 1, before + left)
        return node - self.width, before

    def _set_leaf(self, leaf: int, sizes: np.ndarray, tokens: np.ndarray) -> None:
        while leaf >= len(self.leaves):
            self.leaves.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
        self.leaves[leaf] = (sizes, tokens)
        node = leaf + self.width
        change = np.array([sizes.sum(), tokens.sum(), len(sizes)]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of characters ``start`` to ``end`` (exclusive,
        both clipped to the text) and bring the counts up to date."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        # the first pre-token that the edit can change ends within LOOKAHEAD of it or later
        lo, at = self._leaf_at(max(0, start - LOOKAHEAD))
        if lo >= len(self.leaves):
            lo = len(self.leaves) - 1
            at = int(self.sums[1, 0] - self.sums[lo + self.width, 0])
        begin, skip = at, 0
        while lo > 0 and at > max(0, start - LOOKAHEAD - 1):
            lo -= 1
            at = begin = at - int(self.sums[lo + self.width, 0])
        for size in self.leaves[lo][0].tolist():
            if begin + size + LOOKAHEAD > start:
                break
            begin, skip = begin + size, skip + 1
        # old ends of pre-tokens from there on, leaf by leaf, until the new pre-tokens meet one of them past the edit
        hi, reach, ends = lo, at, set()
        matches, pos = self.store.pattern.finditer(text, begin), begin
        found: list[str] = []
        met = None
        while met is None:
            m = next(matches, None)
            if m is None:
                break
            found.append(m.group())
            pos = m.end()
            if pos < start + len(new):
                continue
            old = pos - shift
            while reach < old and hi < len(self.leaves):
                ends.update((reach + np.cumsum(self.leaves[hi][0])).tolist())
                reach += int(self.sums[hi + self.width, 0])
                hi += 1
            if old >= end and old in ends:
                met = old
        if met is None:
            met, hi = len(self.text), len(self.leaves)
            reach = len(self.text)
        numbers = np.fromiter(map(self.store.pieces.__getitem__, found), np.int64, len(found))
        self.store.settle()
        self.reencoded += len(found)
        sizes, tokens = np.fromiter(map(len, found), np.int64, len(found)), self.store.length[numbers].astype(np.int64)
        head = self.leaves[lo]
        tail_sizes, tail_tokens = self.leaves[hi - 1] if hi > lo else (np.zeros(0, np.int64),) * 2
        if hi > lo:
            keep = np.cumsum(tail_sizes) + (reach - int(tail_sizes.sum())) > met
            tail_sizes, tail_tokens = tail_sizes[keep], tail_tokens[keep]
        sizes, tokens = np.concatenate([head[0][:skip], sizes, tail_sizes]), np.concatenate([head[1][:skip], tokens, tail_tokens])
        self.text = text
        # what was touched is dealt out over the leaves it came from
        over = np.array_split(np.arange(len(sizes)), max(1, hi - lo))
        for k, part in enumerate(over):
            self._set_leaf(lo + k, sizes[part], tokens[part])
        if max(len(p) for p in over) > 8 * LEAF:
            self._rebuild()

    def _rebuild(self) -> None:
        """Even leaves after they have grown; token counts are kept."""
        sizes, tokens = (np.concatenate([x[k] for x in self.leaves]) for k in (0, 1))
        counted = _Counted(tokens, self.store)
        done = self.reencoded
        self.__init__(self.text, counted, np.arange(len(tokens)), sizes)
        self.store, self.reencoded = counted.store, done


class _Counted:
    """Stands in for a store where the lengths are known already."""

    def __init__(self, length: np.ndarray, store: PieceStore):
        self.length, self.store = length, store


def edit_list(*edits: tuple[Column, Column, Column]) -> Column:
    """A column of edits from (start, end, replacement) columns."""
    return F.array(*[F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), c.alias("text")) for a, b, c in edits])


def count_after_edits(docs: DataFrame, ranks_path: str, pattern: str, edits: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every whole text before and after its edits.

    ``edits`` is an array of structs (start long, end long, text string), in code
    points of the text as the edits before have left it. Places outside the text
    are clipped; a null start is 0, a null end is the start, a null text is empty;
    a null array has no edits. Returns ``id_col``, ``n_tokens_before``,
    ``n_tokens``, ``n_pretokens``, ``n_edits``, ``n_reencoded`` (pre-tokens that
    the edits made anew) long and ``edited_text`` string. One row per input row; a
    null text is empty. Other columns are not read.
    """
    longs = ("n_tokens_before", "n_tokens", "n_pretokens", "n_edits", "n_reencoded")
    fields = [common.field(docs, id_col), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("edited_text", T.StringType())]

    def run(batches):
        store = piece_store(ranks_path, pattern)
        for batch in batches:
            for part in common.slices(batch, 1):
                store.trim()
                texts = [t or "" for t in part.column(1).to_pylist()]
                lexed = [store.number_pieces(t) for t in texts]
                store.settle()
                rows = []
                for text, (found, numbers), todo in zip(texts, lexed, part.column(2).to_pylist()):
                    tree = CountTree(text, store, numbers, np.fromiter(map(len, found), np.int64, len(found)))
                    before = tree.tokens
                    for e in todo or []:
                        a = e["start"] or 0
                        tree.replace(a, a if e["end"] is None else e["end"], e["text"] or "")
                    rows.append((before, tree.tokens, tree.pretokens, len(todo or []), tree.reencoded, tree.text))
                cols = [part.column(0), *[pa.array(c, pa.int64()) for c in list(zip(*rows))[:-1]], pa.array([r[-1] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return common.spread(docs.select(id_col, text_col, edits.alias("__edits"))).mapInArrow(run, T.StructType(fields))
