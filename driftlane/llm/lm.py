"""N-gram language model as a weighted backoff automaton, fitted and applied in blocks.

Counts of all n-grams don't fit in one place, and a join of every token with
them would shuffle every token. So each task cuts its documents into blocks of a
few megabytes, whose tokens become numbers. A block sends its distinct words, one
compressed record for each range of hashes; a task per range numbers the words of
all blocks, adds up their counts and answers each block. Then the block sends its
n-grams in these numbers, as tries, and gets their total counts back in the same
way. With them it builds the part of the automaton that its texts can reach, and
scores its documents in one traversal. Texts aren't shuffled, and words and
n-grams are told apart by themselves, not by hashes, which only deal them out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlane.llm import common

ORDER = 3
#: Bytes of text in a block, and bytes of text for each range of hashes.
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 12 << 20
#: Tokens that the smoothing adds to a state, dealt out as its backoff state has them.
PRIOR = 8.0
#: Histories that occur more often have their continuations dealt out to all ranges.
FREQUENT = 1 << 16
#: Bytes of a block's numbers in one row, which keeps rows small.
PIECE = 1 << 18
#: Tokens that follow each other in one lane of the traversal.
RUN = 256
END = b""  # no word is empty


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z alone); the end of the text is not among them."""
    return (text or "").encode().lower().split()


def _mix(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of whole numbers."""
    x = np.full(len(columns[0]), 0x632BE59BD9B4E019, np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            x = (x ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
    return x


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes, a plane for each, compressed."""
    width = next(w for w in (1, 2, 3, 4, 5, 6, 8) if not len(values) or int(values.max()) < 1 << (8 * w))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<i8").ravel()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, rising, and the place of each key among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], place


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


@dataclass
class Level:
    """The distinct n-grams of one length in a block, in the order of their prefixes."""

    parent: np.ndarray  # the n-gram (below: the word) without its last token
    last: np.ndarray
    suffix: np.ndarray  # the n-gram without its first token
    at: np.ndarray  # for each position the n-gram that ends there, or -1


class Block:
    """The documents of a block as numbers of its distinct words.

    Word 0 is the end of a text, the others follow by falling frequency. ``token``
    holds the texts one after another, each closed by its end; ``part`` the range of
    each word.
    """

    def __init__(self, sizes: np.ndarray, token: np.ndarray, part: np.ndarray, train: np.ndarray):
        self.sizes, self.token, self.part, self.train, self.n_words = sizes, token, part, train, len(part)
        self.starts = _starts(sizes)
        self.on = np.repeat(train, sizes)

    @classmethod
    def lex(cls, texts: pa.Array, train: np.ndarray, parts: int) -> tuple[Block, list[bytes]]:
        """The block of some texts, and its words."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat, of = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        real = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(real).dictionary_encode()
        sizes = np.bincount(of[real.to_numpy(zero_copy_only=False)], minlength=len(texts)) + 1
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(-np.bincount(code, minlength=len(coded.dictionary)), kind="stable")
        words = [END, *coded.dictionary.cast(pa.binary()).take(pa.array(order)).to_pylist()]
        part = np.fromiter((xxhash.xxh64_intdigest(w) % parts for w in words), np.int64, len(words))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(1, len(words))
        token = np.zeros(int(sizes.sum()), np.int32)
        inner = np.ones(len(token), bool)
        inner[np.cumsum(sizes) - 1] = False
        token[inner] = number[code]
        return cls(sizes, token, part, train), words

    def by_part(self) -> list[tuple[int, np.ndarray]]:
        """The ranges that the words are in, and the words of each."""
        order = np.argsort(self.part, kind="stable")
        ranges, first = np.unique(self.part[order], return_index=True)
        return list(zip(ranges.tolist(), np.split(order, first[1:])))

    def counts(self, at: np.ndarray, n: int, train: bool = True) -> np.ndarray:
        """How often each n-gram ends in the training documents (or in the others)."""
        return np.bincount(at[(self.on == train) & (at >= 0)], minlength=n)

    def levels(self, order: int) -> list[Level]:
        """N-grams of length 2 to ``order``. A text's first history is the end."""
        out, before, n = [], self.token, self.n_words
        for length in range(2, order + 1):
            prefix = np.concatenate([np.full(min(1, len(before)), -1, np.int64), before[:-1]])
            prefix[self.starts] = 0 if length == 2 else -1
            on = np.flatnonzero(prefix >= 0)
            keys, at = _distinct(prefix[on] * self.n_words + self.token[on])
            whole = np.full(len(self.token), -1, np.int32)
            whole[on] = at
            suffix = np.empty(len(keys), np.int32)
            suffix[at] = before[on]
            out.append(Level(*(x.astype(np.int32) for x in np.divmod(keys, self.n_words)), suffix, whole))
            before = whole
        return out

    def tries(self, levels: list[Level], numbers: np.ndarray, lone: np.ndarray, frequent: np.ndarray, parts: int) -> list[tuple[int, list[np.ndarray], np.ndarray]]:
        """For each range its share of the n-grams, by level from 2 on, as indexes, and
        which of the pairs it counts.

        Left out are those with a word that no other block has: the counts of the
        block are all there is. N-grams go where their first word is, or if that is
        frequent, their first two words, or if both are, their first three.
        """
        if not levels:
            return []
        two = levels[0]
        shared = ~(lone[two.parent] | lone[two.last])
        n1, n2 = numbers[two.parent], numbers[two.last]
        home = np.where(frequent[two.parent], _mix(n1, n2), _mix(n1)) % np.uint64(parts)
        spread = frequent[two.parent] & frequent[two.last]
        part, kept = [home], [shared]
        for at, level in enumerate(levels[1:]):
            p = part[-1][level.parent]
            if at == 0:
                p = np.where(spread[level.parent], _mix(n1[level.parent], n2[level.parent], numbers[level.last]) % np.uint64(parts), p)
            part.append(p)
            kept.append(kept[-1][level.parent] & ~lone[level.last])
        indexes = [np.flatnonzero(k) for k in kept]
        indexes = [i[np.argsort(p[i], kind="stable")] for i, p in zip(indexes, part)]
        ranges = np.unique(np.concatenate([p[i] for i, p in zip(indexes, part)]))  # those with any n-gram
        bounds = [(np.searchsorted(p[i], ranges), np.searchsorted(p[i], ranges, side="right")) for i, p in zip(indexes, part)]
        out = []
        for at, k in enumerate(ranges.tolist()):
            mine = [i[first[at] : last[at]] for i, (first, last) in zip(indexes, bounds)]
            guests = np.zeros(0, np.int64)
            if len(mine) > 1:  # pairs whose continuations were dealt here
                guests = levels[1].parent[mine[1]]
                guests = np.unique(guests[home[guests] != k])
            pairs = np.concatenate([mine[0], guests])
            order = np.argsort(pairs, kind="stable")
            mine[0] = pairs[order]
            if len(pairs):
                out.append((k, mine, order < len(pairs) - len(guests)))
        return out


def trie_record(levels: list[Level], counts: list[np.ndarray], numbers: np.ndarray, mine: list[np.ndarray], counted: np.ndarray) -> list[bytes]:
    """One range's share of a block's n-grams: first words, then for each level how
    many follow each of those before, their last words, and counts."""
    above = levels[0].parent[mine[0]]
    begins = np.flatnonzero(np.diff(above, prepend=-1))
    kids, out = np.diff(begins, append=len(above)), [_pack(numbers[above[begins]])]
    for at, (level, index) in enumerate(zip(levels, mine)):
        if at:
            kids = np.bincount(np.searchsorted(mine[at - 1], level.parent[index]), minlength=len(mine[at - 1]))
        n = counts[at][index] if at else np.where(counted, counts[at][index], 0)
        out += [_pack(kids), _pack(numbers[level.last[index]]), _pack(n)]
    return out


def add_tries(records: list[list[bytes]]) -> list[list[bytes]]:
    """What the other records of a range add to the counts of each record's n-grams."""
    answers = [[] for _ in records]
    above = np.concatenate([_unpack(r[0]) for r in records])
    for at in range(1, len(records[0]), 3):
        kids = np.concatenate([_unpack(r[at]) for r in records])
        own = [_unpack(r[at + 1]) for r in records]
        ends = np.cumsum([len(x) for x in own])[:-1]
        words, word = _distinct(np.concatenate(own))
        del own
        _, prefix = _distinct(above)
        _, above = _distinct(np.repeat(prefix.astype(np.int64), kids) * max(1, len(words)) + word)
        del kids, words, word, prefix
        n = np.concatenate([_unpack(r[at + 2]) for r in records])
        total = np.bincount(above, weights=n).astype(np.int64)[above] - n if len(above) else above
        for answer, part in zip(answers, np.split(total, ends)):
            answer.append(_pack(part))
    return answers


class Automaton:
    """The states and arcs of the model that a block's texts can reach.

    State 0 is the root; the others are histories that training has seen, of up to
    ``order - 1`` tokens. A token that training has seen after a history follows an
    arc of probability (c(h,w) + prior * p(w | shorter h)) / (c(h) + prior) to the
    state of the longest history it leaves. Any other token takes the failure arc,
    weight prior / (c(h) + prior), to the state of the history without its first
    token, and tries again there. The root has an arc for every token, of
    probability (c(w) + 0.5) / (N + 0.5 (V + 1)), the last half for all unseen
    tokens together. So the probabilities of each state sum to 1.
    """

    def __init__(self, words: np.ndarray, levels: list[Level], counts: list[np.ndarray], floor: float, prior: float):
        self.order, self.n_words = len(levels) + 1, len(words)
        p = (words + 0.5) / floor
        self.root_weight = np.log10(p)
        base = np.cumsum([1, len(words), *(len(x.last) for x in levels)])  # first state of each length of history
        self.root_next = np.where(words > 0, 1 + np.arange(len(words)), 0) if self.order > 1 else np.zeros(len(words), np.int64)
        self.start = int(self.root_next[0]) if len(words) else 0
        self.fail = np.zeros(int(base[self.order - 1]) if self.order > 1 else 1, np.int64)
        self.fail_weight = np.zeros(len(self.fail))
        above, keys, weights, after = words, [], [], []
        for n, (level, c) in enumerate(zip(levels, counts), start=2):
            seen = np.flatnonzero(c > 0)
            at = slice(int(base[n - 2]), int(base[n - 1]))  # states of histories of n - 1 tokens
            self.fail_weight[at] = np.log10(prior / (above + prior))
            if n < self.order:
                self.fail[int(base[n - 1]) : int(base[n])] = base[n - 2] + level.suffix
            p = (c + prior * p[level.suffix]) / (above[level.parent] + prior)
            keys.append((base[n - 2] + level.parent[seen]) * self.n_words + level.last[seen])
            weights.append(np.log10(p[seen]))
            after.append(base[n - 1] + seen if n < self.order else base[n - 2] + level.suffix[seen])
            above = c
        none = [np.zeros(0, np.int64)]
        self.keys, self.weight, self.next = np.concatenate(keys or none), np.concatenate(weights or none), np.concatenate(after or none)
        self.arcs = np.bincount(self.keys // max(1, self.n_words), minlength=len(self.fail))  # of each state
        self.first = _starts(self.arcs)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next states, log10 probabilities, and failure arcs taken."""
        state, weight, failed = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        after = np.empty(len(state), np.int64)
        while len(todo):
            s, t = state[todo], token[todo]
            key, arc, n = s * self.n_words + t, self.first[s], self.arcs[s]
            hit = n > 0
            hit[hit] = self.keys[arc[hit]] == key[hit]
            more = np.flatnonzero(~hit & (n > 1))  # most states have one arc
            found = np.searchsorted(self.keys, key[more])
            inside = found < len(self.keys)
            inside[inside] = self.keys[found[inside]] == key[more[inside]]
            arc[more], hit[more] = found, inside
            to, arc = todo[hit], arc[hit]
            weight[to] += self.weight[arc]
            after[to] = self.next[arc]
            root = ~hit & (s == 0)
            to = todo[root]
            weight[to] += self.root_weight[t[root]]
            after[to] = self.root_next[t[root]]
            on = ~hit & ~root
            todo, s = todo[on], s[on]
            weight[todo] += self.fail_weight[s]
            failed[todo] += 1
            state[todo] = self.fail[s]
        return after, weight, failed

    def traverse(self, block: Block, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability, and failure arcs taken, of each token of the texts.

        Each text is read from left to right and carries its state. Long texts are
        cut into runs, which go side by side: a run starts from the root the few
        tokens earlier that decide its state, which don't count for it.
        """
        of = np.repeat(np.arange(len(block.sizes)), -(-block.sizes // run))
        nth = np.arange(len(of)) - _starts(-(-block.sizes // run))[of]
        begin = block.starts[of] + nth * run
        end = np.minimum(begin + run, block.starts[of] + block.sizes[of])
        early = np.minimum(nth * run, self.order - 1)
        order = np.argsort(-(end - begin + early), kind="stable")
        begin, end, early, first = begin[order], end[order], early[order], (nth * run == early)[order]
        state = np.where(first, self.start, 0)
        length = end - begin + early
        weight, failed = np.zeros(len(block.token)), np.zeros(len(block.token), np.int64)
        for t in range(int(length.max(initial=0))):
            active = int(np.searchsorted(-length, -t))
            at = begin[:active] - early[:active] + t
            state[:active], w, f = self.step(state[:active], block.token[at])
            on = early[:active] <= t
            weight[at[on]], failed[at[on]] = w[on], f[on]
        return weight, failed


def elsewhere(block: Block, words: np.ndarray, levels: list[Level], counts: list[np.ndarray]) -> np.ndarray:
    """Which tokens end an n-gram of the longest kind that other training documents
    than their own have too."""
    out, todo, doc = np.zeros(len(block.token), bool), np.ones(len(block.token), bool), np.repeat(np.arange(len(block.sizes)), block.sizes)
    for at, count in reversed([(block.token, words), *((x.at, c) for x, c in zip(levels, counts))]):
        on = np.flatnonzero(todo & (at >= 0))
        place = _distinct(doc[on] * len(count) + at[on])[1]
        own = np.bincount(place)[place] if len(on) else place
        out[on] = count[at[on]] > own * block.on[on]
        todo[on] = False
    return out


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """Score every whole text with an n-gram model of the rows where ``training``
    holds (null: not). See ``Automaton`` for the model.

    Returns ``id_col``, ``n_tokens``, ``n_known``, ``train_tokens`` long,
    ``base_score`` (root arcs alone) and ``score`` double (log10), ``n_failures``
    (failure arcs taken) and ``n_elsewhere`` long (tokens whose n-gram of the longest
    kind other training documents have too: all of a copy's). One row per input row, equal ones included; a null or
    empty text is the end token alone. Without training rows N and V are 0 and all
    arcs are unseen. Other columns are not read.

    Blocks are cut inside tasks, so equal rows don't meet anywhere; a longer text is
    a block by itself. The number of hash ranges follows the bytes of the table, and
    no word or history fills one: what follows a word or a pair that occurs more than
    ``frequent`` times is dealt to all. Blocks times ranges is how many records meet,
    at most one for each n-gram of a block, so executors with more memory should take
    larger blocks and ranges.
    """
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training.cast("boolean"), F.lit(False)).alias("train"))
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / range_bytes))
    held = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("item", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("words", T.ArrayType(T.BinaryType()))])

    def cut(batches):
        """Each block's numbers in pieces of PIECE bytes, and a record for each range of its words."""
        task, made, pieces, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            lengths = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(lengths, lengths[a] + block_bytes - size, side="right")) - 1)
                if pieces and size + lengths[b] - lengths[a] > block_bytes:
                    yield block_records(pa.Table.from_batches(pieces), task << 32 | made)
                    made, pieces, size = made + 1, [], 0
                    continue
                pieces.append(batch.slice(a, b - a))
                size += int(lengths[b] - lengths[a])
                a = b
        if pieces:
            yield block_records(pa.Table.from_batches(pieces), task << 32 | made)

    def block_records(table: pa.Table, number: int) -> pa.RecordBatch:
        text, ids = table.column("text").combine_chunks(), table.column("id").combine_chunks()
        block, words = Block.lex(text, table.column("train").to_numpy(), parts)
        texts = [_pack(x.astype(np.int64)) for x in (block.sizes, block.token, block.part, block.train)]
        seen, others = (block.counts(block.token, block.n_words, t) for t in (True, False))
        asked = block.by_part()
        zip_words = zstandard.ZstdCompressor(level=3).compress
        records = [[zip_words(b"\n".join([words[i] for i in at.tolist()])), _pack(seen[at]), _pack(others[at])] for _, at in asked]
        pieces = [(item, a // PIECE, raw[a : a + PIECE]) for item, raw in enumerate(texts) for a in range(0, len(raw), PIECE)]
        n, m = len(pieces), len(asked)
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        ids = pa.concat_arrays([ids, pa.nulls(n + m - 1, ids.type)])  # with the first piece
        own = [pa.array([*column, *[None] * m], t) for column, t in zip(zip(*pieces), (pa.int32(), pa.int32(), pa.binary()))]
        cols = [pa.array([number] * (n + m), pa.int64()), ids, *own, pa.array([*[None] * n, *(k for k, _ in asked)], pa.int32()), pa.array([*[None] * n, *records], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(cols, held.names)

    answer = "kind int, part int, block long, packed array<binary>, seen long, held long"
    names = [c.split()[0] for c in answer.split(", ")]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.int64())

    def answers_of(rows) -> pa.Table:
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def number_words(table: pa.Table) -> pa.Table:
        part, blocks = table.column("part")[0].as_py(), table.column("block").to_pylist()
        records = table.column("words").to_pylist()
        lists = [zstandard.ZstdDecompressor().decompress(r[0]).split(b"\n") for r in records]
        ends = np.cumsum([len(x) for x in lists])[:-1]
        at = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        seen, others = (np.bincount(at, weights=np.concatenate([_unpack(r[i]) for r in records])).astype(np.int64) for i in (1, 2))
        rank = np.empty(len(seen), np.int64)
        rank[np.argsort(-(seen + others), kind="stable")] = np.arange(len(seen))  # small numbers for frequent words
        flags = (np.bincount(at) == 1) + 2 * (seen + others > frequent)
        distinct, sums = int((seen > 0).sum()), int(seen.sum())
        return answers_of([(1, part, block, [_pack(x[i]) for x in (rank, seen, flags)], distinct, sums) for block, i in zip(blocks, np.split(at, ends))])

    def opened(texts: pa.Table) -> Block:
        items: list[list[bytes]] = [[], [], [], []]
        for r in sorted(texts.select(["item", "piece", "data"]).to_pylist(), key=lambda r: (r["item"], r["piece"])):
            items[r["item"]].append(r["data"])
        sizes, token, part, train = (_unpack(b"".join(x)) for x in items)
        return Block(sizes, token.astype(np.int32), part, train.astype(bool))

    def words_of(block: Block, got: pa.Table):
        """Numbers, training counts and flags (lone, frequent) of a block's words."""
        out = np.empty((3, block.n_words), np.int64)
        where = dict(block.by_part())
        for r in got.filter(pc.equal(got.column("kind"), 1)).select(["part", "packed"]).to_pylist():
            out[:, where[r["part"]]] = [_unpack(b) for b in r["packed"]]
        return out[0] * parts + block.part, out[1], (out[2] & 1).astype(bool), (out[2] & 2).astype(bool)

    def ask(texts: pa.Table, got: pa.Table) -> pa.Table:
        block = opened(texts)
        numbers, _, lone, often = words_of(block, got)
        levels = block.levels(order)
        counts = [block.counts(x.at, len(x.last)) for x in levels]
        number = texts.column("block")[0].as_py()
        rows = [(k, number, trie_record(levels, counts, numbers, mine, counted)) for k, mine, counted in block.tries(levels, numbers, lone, often, parts)]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.binary())))], names=["part", "block", "trie"])

    def add(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        totals = add_tries(table.column("trie").to_pylist())
        return answers_of([(2, part, block, packed, None, None) for block, packed in zip(table.column("block").to_pylist(), totals)])

    blocks = common.stage(common.spread(wanted).mapInArrow(cut, held), "blocks")
    texts = blocks.where("part is null").select("block", "ids", "item", "piece", "data")
    words = common.stage(blocks.where("part is not null").select("part", "block", "words").groupBy("part").applyInArrow(number_words, answer), "words")
    # a range's sums stand in each of its rows: one number per range
    sums = words.groupBy("part").agg(F.first("seen").alias("seen"), F.first("held").alias("held")).agg(F.sum("seen"), F.sum("held")).first()
    distinct, n_train = sums[0] or 0, sums[1] or 0
    floor = n_train + 0.5 * (distinct + 1)
    asked = texts.drop("ids").groupBy("block").cogroup(words.select("kind", "part", "block", "packed").groupBy("block")).applyInArrow(ask, "part int, block long, trie array<binary>")
    grams = common.stage(asked.groupBy("part").applyInArrow(add, answer), "ngrams")

    schema = T.StructType([common.field(docs, id_col), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("n_failures", T.LongType()), T.StructField("n_elsewhere", T.LongType())])

    def traverse(texts: pa.Table, got: pa.Table) -> pa.Table:
        block, ids = opened(texts), pa.concat_arrays(texts.column("ids").chunks).flatten()
        numbers, words, lone, often = words_of(block, got)
        levels = block.levels(order)
        counts = [block.counts(x.at, len(x.last)) for x in levels]
        others = {r["part"]: r["packed"] for r in got.filter(pc.equal(got.column("kind"), 2)).select(["part", "packed"]).to_pylist()}
        for k, mine, _ in block.tries(levels, numbers, lone, often, parts):
            for count, index, packed in zip(counts, mine, others[k]):
                count[index] += _unpack(packed)
        automaton = Automaton(words, levels, counts, floor, prior)
        weight, failed = automaton.traverse(block)
        add = lambda values: np.add.reduceat(values, block.starts) if len(block.starts) else values
        cols = [ids, pa.array(block.sizes), pa.array(add((words > 0)[block.token].astype(np.int64))), pa.array(np.full(len(block.sizes), n_train, np.int64))]
        cols += [pa.array(add(automaton.root_weight[block.token])), pa.array(add(weight)), pa.array(add(failed)), pa.array(add(elsewhere(block, words, levels, counts).astype(np.int64)))]
        return pa.table(cols, names=schema.names)

    got = words.select("kind", "part", "block", "packed").unionAll(grams.select("kind", "part", "block", "packed"))
    return texts.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(traverse, schema)
