"""Pre-tokens and a per-process store of their token ids.

A byte-level BPE vocabulary splits text by a pattern and merges within each
match. Distinct matches are few beside all matches, so each is encoded once per
Python worker and then looked up. The store is bounded: past ``max_entries``
keys it starts anew, which changes speed alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import regex


_BLANK_RUN = re.compile(r" \s").search


class _Numbered(dict):
    """Gives each new key the next number and remembers it."""

    __slots__ = ("fresh", "store")

    def __init__(self, store):
        super().__init__()
        self.store, self.fresh = store, []

    def __missing__(self, key):
        self[key] = i = self.store._take()
        self.fresh.append((i, key))
        return i


class PieceStore:
    """Token ids of pre-tokens.

    ``encode`` maps a list of distinct pre-tokens to ``(flat ids, lengths)``.

    Texts are first cut at blanks: a blank before a non-blank always begins a
    pre-token, so the cut pieces (blank included) can be looked up whole without
    running the pattern. A text with a blank before white space or at its end goes
    through the pattern itself, as a run of white space may then cross a cut.

    Before that, texts are split at the ``added`` tokens, the leftmost longest
    first, which stand for one id each; what lies between is a text of its own.
    """

    def __init__(self, encode: Callable, pattern: str, max_entries: int = 1_000_000, added: dict[str, int] | None = None):
        self.encode, self.max_entries, self.added = encode, max_entries, added or {}
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if longest else None
        self.pattern = regex.compile(pattern)
        self.findall = self.pattern.findall
        self._reset()

    def _reset(self):
        self.pieces, self.chunks, self.marks = _Numbered(self), _Numbered(self), _Numbered(self)
        self.n = self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.int32)

    def _take(self):
        self.n += 1
        return self.n - 1

    def trim(self):
        """Start anew if the bound is passed; call between batches."""
        if self.n > self.max_entries:
            self._reset()

    def number(self, text: str) -> np.ndarray:
        """Numbers of the entries that make up ``text``, in order."""
        if self.split is not None and any(t in text for t in self.added):
            # what splits stands at the odd places
            parts = [np.array([self.marks[x]], np.int64) if i % 2 else self._number(x) for i, x in enumerate(self.split(text))]
            return np.concatenate(parts)
        return self._number(text)

    def _number(self, text: str) -> np.ndarray:
        if _BLANK_RUN(text) or text[-1:] == " ":
            found = self.findall(text)
            return np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        head, *rest = text.split(" ")
        found = self.findall(head)
        out = np.empty(len(found) + len(rest), np.int64)
        out[: len(found)] = list(map(self.pieces.__getitem__, found))
        out[len(found) :] = list(map(self.chunks.__getitem__, rest))
        return out

    def number_pieces(self, text: str) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of ``text`` and their numbers."""
        found = self.findall(text)
        return found, np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))

    def settle(self):
        """Encode what was numbered since the last call."""
        chunks, self.chunks.fresh = self.chunks.fresh, []
        # chunks hold no blank, so in their join each begins with the one match that starts with a blank
        found = self.findall(" " + " ".join([c for _, c in chunks])) if chunks else []
        of = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        first = np.flatnonzero(np.fromiter((p[0] == " " for p in found), bool, len(found)))
        fresh, self.pieces.fresh = self.pieces.fresh, []
        if self.n > len(self.start):
            size = max(self.n, 2 * len(self.start))
            self.start = np.concatenate([self.start, np.zeros(size - len(self.start), np.int64)])
            self.length = np.concatenate([self.length, np.zeros(size - len(self.length), np.int32)])
        marks, self.marks.fresh = self.marks.fresh, []
        if marks:
            ids = np.array([self.added[x] for _, x in marks], np.int32)
            self._put(np.array([i for i, _ in marks], np.int64), ids, np.ones(len(ids), np.int32))
        if fresh:
            flat, lengths = self.encode([p for _, p in fresh])
            self._put(np.fromiter((i for i, _ in fresh), np.int64, len(fresh)), flat, lengths)
        if chunks:
            self._put(np.fromiter((i for i, _ in chunks), np.int64, len(chunks)), self.gather(of), np.add.reduceat(self.length[of], first))

    def _put(self, at: np.ndarray, flat: np.ndarray, lengths: np.ndarray):
        need = self.used + len(flat)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, 2 * len(self.flat)) - len(self.flat), np.int32)])
        self.flat[self.used : need] = flat
        self.start[at] = self.used + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.length[at] = lengths
        self.used = need

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The token ids of settled entries, joined."""
        lengths = self.length[numbers].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[numbers] - (ends - lengths), lengths) + np.arange(total)]
