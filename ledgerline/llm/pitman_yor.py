"""Scoring texts with a hierarchical Pitman-Yor trigram model.

The model. The root restaurant serves words; its base is uniform over the V training tokens and one unknown. Below it stands
a restaurant for each preceding token, and below each of these one for each token before that one; all of them share their
parent with their siblings. A parent takes one customer for a dish from each restaurant below that has it (the least seating,
from which Gibbs sampling starts, and that of interpolated Kneser-Ney smoothing). Contexts grow with the corpus; only tokens two
back are told apart by 16 bits of a hash, within each preceding token.

Seating is sampled by Gibbs, from the root down: in a sweep, the customers of each (restaurant, dish) leave and are seated again
one after another (in blocks of a sixteenth of those already seated, once these are many), by the Chinese-restaurant rule, given
everybody else. Probabilities are averaged over the sweeps (below, over those after burn-in); a text's score is the sum of
their log10.

How it runs.
1. Texts move once, as compressed arrays of (token two back, token, document) under each distinct preceding token, to the part
   that holds all restaurants of that token. Parts are of bounded size, frequent tokens are dealt to several by the context.
   The parts move in rounds, a share of them in each, so that only a share of the shuffle's files lies beside the tables.
2. Each part tells for each of its words how often it occurs in training and how many whole parents serve it. A parent whose
   contexts are dealt to several parts is shared by them as the root is: they tell its customers, too, by word. These meet by
   word: exact counts, customers and seating of the root and of shared parents. Each word's count, its probability at the
   root and in the shared parents go back to the parts that asked.
3. Each part seats its whole parents under that root, then its restaurants below, and scores its postings; partial sums meet by
   piece of the input.

The parts are bucketed tables, so only words, pairs of shared parents and sums move after the first step. Random numbers are hashes
of the restaurant, the dish, the customer and the sweep, sums of customers and tables are whole numbers, and discounts come from
how many dishes of a level have one and two customers in all parts. So a score depends on the corpus only: not on how many
parts there are, nor on which tokens are dealt to several. Tokens are told apart by 48 bits of their hash: any two of V
coincide with a chance of V**2 / 2**49.

Defined results: null text counts as empty; an empty text has one token, its end; texts of any length are scored whole; ids are
whole numbers and may repeat or be null (each row gets its row); ties do not arise; without training rows every token has
probability 1 / (V + 1) = 1; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, index_in, mix, pieces, settled, shared_folder, tidy, utf8, words

CONTEXT_BITS = 16
END, START = (mix(np.array([0x0E4D, 0x57A7], np.uint64)) >> np.uint64(16)).tolist()
#: A piece holds fewer documents than fit in 15 bits, and about so many bytes of text.
MOST_DOCS, PIECE = (1 << 15) - 1, 8 << 20
#: Text for each part, and the fewest parts.
PART_BYTES, LEAST_PARTS = 8_000_000, 32
#: Rounds in which the parts' postings are moved.
ROUNDS = 4
#: Words that make up this share of a sample's tokens are dealt to several parts; there are at most 1 / HOT of them.
HOT, SAMPLE_DOCS = 0.001, 2000
#: Bits in which what is asked for names a shared context; words have 48.
SLOT = np.uint64(16)
STRENGTH = 1.0
ROOT_SWEEPS = PARENT_SWEEPS = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)

PACKED = "part int, piece bigint, sizes binary, data binary"
FEW = ["types_once", "types_twice", "pairs_once", "pairs_twice"]
ASKS = "asked int, part int, n bigint, data binary, types_once bigint, types_twice bigint, pairs_once bigint, pairs_twice bigint"


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays compressed together, byte by byte of their values."""
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"" for x in arrays)
    return pa.Codec("zstd", compression_level=2).compress(raw, asbytes=True)


def _unzip(data: bytes, *shape: tuple[type, int]) -> list[np.ndarray]:
    """The arrays again: (type, length) of each."""
    widths = [np.dtype(t).itemsize for t, _ in shape]
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, sum(w * n for w, (_, n) in zip(widths, shape))), np.uint8)
    out, at = [], 0
    for w, (t, n) in zip(widths, shape):
        out.append(np.ascontiguousarray(raw[at : at + w * n].reshape(w, n).T).view(t).ravel() if n else np.zeros(0, t))
        at += w * n
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    named = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(named)], [n for n, _ in named])


def _sequence(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens with an end after each text, the one before each, a 16-bit hash of the one two before, and each text's
    number of tokens."""
    hashes, count = words(data, ends)
    size = count + 1
    last = np.cumsum(size) - 1
    tokens = np.empty(int(size.sum()), np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[last] = False
    tokens[inner], tokens[last] = hashes >> np.uint64(16), END
    first = np.concatenate([[0], last[:-1] + 1])
    before = np.empty(len(tokens), np.uint64)
    before[1:] = tokens[:-1]
    before[first] = START
    two = np.empty(len(tokens), np.uint64)
    two[1:] = before[:-1]
    two[first] = START
    return tokens, before, (mix(two) >> np.uint64(64 - CONTEXT_BITS)).astype(np.uint16), size


def _parts_of(before: np.ndarray, back: np.ndarray, parts: int, hot: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The part of each context; hot: hashes of frequent tokens, sorted; spread: over how many parts each goes."""
    part = (mix(before) % np.uint64(parts)).astype(np.int64)
    if len(hot):
        i = np.minimum(np.searchsorted(hot, before), len(hot) - 1)
        is_hot = hot[i] == before
        salt = (mix(back[is_hot].astype(np.uint64)) % spread[i[is_hot]].astype(np.uint64)).astype(np.int64)
        part[is_hot] = (part[is_hot] + salt * 7) % parts
    return part.astype(np.int32)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and how long they are."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def _packed(docs: DataFrame, parts: int, hot: np.ndarray, spread: np.ndarray, turn: int = 0, rounds: int = 1) -> DataFrame:
    """docs: id, text, train. For each piece of the input and each part of the round: the distinct preceding tokens and how many
    follow each; the distinct tokens; and for each occurrence which of these it is, the hash of the token two back, and the
    document (its number in the piece, doubled, plus 1 if it trains). In the first round for each piece besides, with a
    negative part, its documents: ids, numbers of tokens, flags (1 held out, 2 no id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for whole in pieces(batches, most=PIECE):
            for at in range(0, whole.num_rows, MOST_DOCS):
                batch = whole.slice(at, MOST_DOCS)
                tokens, before, back, size = _sequence(*utf8(batch.column("text")))
                train = batch.column("train").to_numpy(zero_copy_only=False)
                doc = (np.repeat(np.arange(len(size)), size) * 2 + np.repeat(train, size)).astype(np.uint16)
                part = _parts_of(before, back, parts, hot, spread)
                mine = np.flatnonzero(part % rounds == turn)
                order = mine[np.argsort(part[mine], kind="stable")]
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cut)):
                    own = order[cut[p] : cut[p + 1]]
                    known, which = np.unique(tokens[own], return_inverse=True)
                    sort = np.lexsort((which, before[own]))
                    own, which = own[sort], which[sort]
                    first, count = _runs(before[own])
                    sizes = np.array([len(first), len(known), len(own)], np.int64)
                    data = _zip(_steps(before[own][first]), count.astype(np.uint32), _steps(known), _steps(which.astype(_kind(len(known)))), back[own], doc[own])
                    yield _rows(PACKED, [(int(p), piece, sizes.tobytes(), data)])
                if not turn:
                    ids = batch.column("id")
                    flags = (~train).astype(np.uint8) + 2 * ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                    data = _zip(ids.fill_null(0).to_numpy(), size.astype(np.int64), flags)
                    yield _rows(PACKED, [(-1 - piece % 1_000_003 % parts, piece, np.array([len(size)], np.int64).tobytes(), data)])
                piece += 1

    return docs.mapInArrow(run, PACKED)


def _kind(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def _stream(key: np.ndarray, seed: int, sweep: int) -> np.ndarray:
    """Another key for each dish, seed and sweep."""
    return mix(key + np.uint64((seed << 32) + sweep + 1))


def _drawn(key: np.ndarray, at: np.ndarray | int) -> np.ndarray:
    """A number from 0 to 1 for the customer `at` of each dish; it follows from the dish alone, not from who seats it."""
    return (mix(key + np.asarray(at).astype(np.uint64) * _STEP) >> np.uint64(11)) * 2.0**-53


def seat(count: np.ndarray, new: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables after `count` customers (descending) of a dish sat down; new: the weight of a new table; key: of each dish."""
    tables = (count > 0).astype(float)
    least, done = -count, 1
    while (active := int(np.searchsorted(least, -done, "left"))) > 0:  # those with more than `done` customers
        block = max(1, done // 16)
        weight = new[:active]
        chance = weight / (weight + np.maximum(done - discount * tables[:active], 1e-12))
        if block == 1:
            tables[:active] += _drawn(key[:active], done) < chance
        else:
            dish, nth = index_in(np.minimum(block, count[:active] - done))
            tables[:active] += np.bincount(dish[_drawn(key[dish], done + nth) < chance[dish]], minlength=active)
        done += block
    return tables


def _seated(count: np.ndarray, new: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """seat() for counts in any order."""
    order = np.argsort(-count, kind="stable")
    out = np.empty(len(count))
    out[order] = seat(count[order].astype(np.int64), new[order], discount, key[order])
    return out


def parents(served: np.ndarray, context: np.ndarray, base: np.ndarray, key: np.ndarray, discount: float, total: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tables of upper restaurants under the root, for each pair of a context and a word, after each sweep, and the tables of each
    context. served: their customers; base: the root's probability of the word; total: all tables of each context after so
    many sweeps, of which the given pairs may be a part."""
    tables = (served > 0).astype(float)
    every = total(0, tables)
    for sweep in range(1, PARENT_SWEEPS + 1):
        tables = _seated(served, (STRENGTH + discount * (every[context] - tables)) * base, discount, _stream(key, 11, sweep))
        every = total(sweep, tables)
        yield tables, every


def parent_probability(served: np.ndarray, context: np.ndarray, base: np.ndarray, key: np.ndarray, discount: float, customers: np.ndarray, total: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The probability of each pair's word after its context, averaged over the sweeps; customers: all of each context."""
    p = sum(np.maximum(served - discount * t, 0) + (STRENGTH + discount * every[context]) * base for t, every in parents(served, context, base, key, discount, total))
    return (p / PARENT_SWEEPS / (STRENGTH + customers[context])).astype(np.float32).astype(float)


def _pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context) + word)


def discount_of(count: np.ndarray) -> float:
    return discount_from(int((count == 1).sum()), int((count == 2).sum()))


def discount_from(once: int, twice: int) -> float:
    """From how many dishes have one and two customers, with half a dish of each assumed."""
    return float(np.clip((once + 0.5) / (once + 0.5 + 2 * (twice + 0.5)), 0.1, 0.95))


class Part:
    """The restaurants of one part. A posting's restaurant is its context (the preceding token, which one of the part's),
    below which those of (context, token two back) stand; types are the distinct (context, back, word) of all postings."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: r["piece"])
        each = []
        for r in rows:
            b, w, n = np.frombuffer(r["sizes"], np.int64)
            each.append(_unzip(r["data"], (np.uint64, b), (np.uint32, b), (np.uint64, w), (_kind(w), n), (np.uint16, n), (np.uint16, n)))
        before, known = [np.cumsum(e[0], dtype=np.uint64) for e in each], [np.cumsum(e[2], dtype=np.uint64) for e in each]
        self.contexts, self.words = np.unique(np.concatenate(before)), np.unique(np.concatenate(known))
        context = np.concatenate([np.repeat(np.searchsorted(self.contexts, b), e[1]) for b, e in zip(before, each)]).astype(np.uint32)
        word = np.concatenate([np.searchsorted(self.words, w)[np.cumsum(e[3], dtype=e[3].dtype)] for w, e in zip(known, each)]).astype(np.uint32)
        back, self.doc = (np.concatenate([e[i] for e in each]) for i in (4, 5))
        self.part, self.pieces, self.sizes = rows[0]["part"], [r["piece"] for r in rows], np.array([len(e[5]) for e in each])
        del each
        train = (self.doc & 1).astype(bool)
        self.count_of_word = np.bincount(word[train], minlength=len(self.words))  # in training
        bits = max(len(self.words) - 1, 1).bit_length()
        pair = context.astype(np.uint64) << np.uint64(bits) | word  # (context, word)
        pairs, at = np.unique(pair, return_inverse=True)
        self.context, self.word = (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)
        key = at.astype(np.uint64) << np.uint64(CONTEXT_BITS) | back  # (pair, back)
        types, self.type = np.unique(key, return_inverse=True)
        self.pair = (types >> np.uint64(CONTEXT_BITS)).astype(np.int64)
        self.count = np.bincount(self.type[train], minlength=len(types))
        self.pair_key = _pair_key(self.contexts[self.context], self.words[self.word])
        below = self.context[self.pair].astype(np.uint64) << np.uint64(CONTEXT_BITS) | (types & np.uint64((1 << CONTEXT_BITS) - 1))
        _, self.below = np.unique(below, return_inverse=True)  # the restaurant of each type
        self.trained = np.flatnonzero(self.count)
        self.trained = self.trained[np.argsort(-self.count[self.trained], kind="stable")]
        self.customers = np.bincount(self.below, weights=self.count)
        self.key = mix(self.pair_key[self.pair[self.trained]] + (types[self.trained] & np.uint64((1 << CONTEXT_BITS) - 1)) + np.uint64(1))
        self.discount = discount_of(self.count)

    def keys(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the part asks for, sorted: its words (with 0 in the low bits) and the pairs of contexts that other parts may hold,
        too (the context's number in `shared`, from 1); which words and which pairs these are, in this order."""
        at = np.minimum(np.searchsorted(shared, self.contexts), max(len(shared) - 1, 0))
        slot = np.where(shared[at] == self.contexts, at + 1, 0).astype(np.uint64) if len(shared) else np.zeros(len(self.contexts), np.uint64)
        pair = np.flatnonzero(slot[self.context])
        keys = np.concatenate([self.words << SLOT, self.words[self.word[pair]] << SLOT | slot[self.context[pair]]])
        order = np.argsort(keys, kind="stable")
        return keys[order], order, pair

    def served(self, tables: np.ndarray) -> np.ndarray:
        """The customers of each pair in the upper restaurants: the tables below that serve its word."""
        return np.bincount(self.pair, weights=tables, minlength=len(self.context))

    def least(self) -> np.ndarray:
        """The least seating: each type that training has sits at one table."""
        return np.minimum(self.count, 1).astype(float)

    def reseated(self, tables: np.ndarray, p: np.ndarray, seed: int, sweep: int) -> np.ndarray:
        """Each type's tables after a sweep. p: the parents' probability of each pair's word."""
        t = self.trained
        there = np.bincount(self.below, weights=tables)[self.below[t]] - tables[t]
        out = np.zeros(len(tables))
        out[t] = seat(self.count[t], (STRENGTH + self.discount * there) * p[self.pair[t]], self.discount, _stream(self.key, seed, sweep))
        return out

    def states(self, root: np.ndarray, sweeps: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """The plain sampler of a part whose restaurants are all whole, parents seated in every sweep, too: each type's tables, each
        pair's tables, and the discount of the upper restaurants. root: the root's probability of each word."""
        tables, upper = self.least(), None
        for r in range(sweeps):
            served = self.served(tables)  # customers of (context, word)
            discount = discount_of(served)
            if upper is None:
                upper = (served > 0).astype(float)
            tables = self.reseated(tables, self.upper(served, np.minimum(upper, served), discount, root), seed, r)
            served = self.served(tables)
            there = np.bincount(self.context, weights=upper)[self.context] - upper
            upper = _seated(served, (STRENGTH + discount * there) * root[self.word], discount, _stream(self.pair_key, seed, r))
            yield tables, upper, discount

    def upper(self, served: np.ndarray, upper: np.ndarray, discount: float, root: np.ndarray) -> np.ndarray:
        """The probability of each pair's word after its context."""
        n, t = np.bincount(self.context, weights=served), np.bincount(self.context, weights=upper)
        return (np.maximum(served - discount * upper, 0) + (STRENGTH + discount * t[self.context]) * root[self.word]) / (STRENGTH + n[self.context])

    def probability(self, tables: np.ndarray, upper: np.ndarray, discount: float, root: np.ndarray) -> np.ndarray:
        """The probability of each type's word after its context and the token before that, in a state of states()."""
        return self.under(tables, self.upper(self.served(tables), upper, discount, root))

    def under(self, tables: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The same under parents of which only their probability of each pair's word is known."""
        t = np.bincount(self.below, weights=tables)[self.below]
        return (np.maximum(self.count - self.discount * tables, 0) + (STRENGTH + self.discount * t) * p[self.pair]) / (STRENGTH + self.customers[self.below])


def _asks(merged: DataFrame, parts: int, shared: np.ndarray) -> DataFrame:
    """Of each part, by the part of the words (`asked`): its words, how often they occur in training there, and in how many of the
    upper restaurants that no other part shares; and the pairs of those that others may share, with their customers here.
    In a part's first row, how many types and how many pairs of its own have one and two customers."""

    def run(table: pa.Table) -> pa.Table:
        part = Part(table.to_pylist())
        keys, order, pair = part.keys(shared)
        served = part.served(part.least()).astype(np.int64)
        own = np.ones(len(served), bool)
        own[pair] = False
        count = np.concatenate([part.count_of_word, np.zeros(len(pair), np.int64)])[order]
        customers = np.concatenate([np.bincount(part.word[own & (served > 0)], minlength=len(part.words)), served[pair]])[order]
        few = [int((x == n).sum()) for x in (part.count, served[own]) for n in (1, 2)]
        to = _word_part(keys >> SLOT, parts)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(parts + 1))
        out = []
        for p in np.flatnonzero(np.diff(cut)):
            k = order[cut[p] : cut[p + 1]]
            out.append((int(p), part.part, len(k), _zip(_steps(keys[k]), count[k].astype(np.int64), customers[k].astype(np.int64)), *(few if not out else [0] * 4)))
        return pa.Table.from_batches([_rows(ASKS, out)])

    return merged.filter("part >= 0").groupBy("part").applyInArrow(run, ASKS)


def _word_part(tokens: np.ndarray, parts: int) -> np.ndarray:
    return (mix(tokens) % np.uint64(parts)).astype(np.int64)


GATHERED = "asked int, parts binary, sizes binary, index binary, keys binary, counts binary, served binary, tokens bigint, distinct bigint, customers bigint, once bigint, twice bigint, types_once bigint, types_twice bigint, pairs_once bigint, pairs_twice bigint"


def _gathered(asks: DataFrame) -> DataFrame:
    """One row for each part of the words: their counts and root customers, the customers of the pairs of shared contexts, and which
    of them every part asked for."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        each = [_unzip(r["data"], (np.uint64, r["n"]), (np.int64, r["n"]), (np.int64, r["n"])) for r in rows]
        known, index = np.unique(np.concatenate([np.cumsum(e[0], dtype=np.uint64) for e in each]), return_inverse=True)
        total = lambda i: np.bincount(index, weights=np.concatenate([e[i] for e in each]), minlength=len(known)).astype(np.int64)
        n, k = total(1), total(2)
        root, at, _ = _apart(known)
        pair = k[~root]
        k[root] += np.bincount(at[~root][pair > 0], minlength=int(root.sum()))  # a shared context is one, however many parts hold it
        few = [sum(r[c] for r in rows) for c in FEW]
        few[2] += int((pair == 1).sum())
        few[3] += int((pair == 2).sum())
        ends = np.cumsum([r["n"] for r in rows])
        steps = np.concatenate([_steps(index[e - r["n"] : e].astype(np.uint32)) for r, e in zip(rows, ends)])
        row = (rows[0]["asked"], np.array([r["part"] for r in rows], np.int32).tobytes(), np.array([r["n"] for r in rows], np.int64).tobytes(), _zip(steps), known.tobytes(), n.tobytes(), k.tobytes(), int(n.sum()), int((n > 0).sum()), int(k[root].sum()), int((k[root] == 1).sum()), int((k[root] == 2).sum()), *few)
        return pa.Table.from_batches([_rows(GATHERED, [row])])

    return asks.groupBy("asked").applyInArrow(run, GATHERED)


def _apart(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: which are words, the place among these of each key's word, and the number of its context, from 0."""
    slot = (keys & np.uint64((1 << int(SLOT)) - 1)).astype(np.int64)
    return slot == 0, np.cumsum(slot == 0) - 1, slot - 1


@dataclass
class Model:
    """The root's sums, those of the shared contexts, and the discounts."""

    tokens: int  # in training
    distinct: int
    discount: float
    customers: float
    tables: list[float]  # of the root after each sweep; [0]: one for each dish
    types_discount: float
    pairs_discount: float
    shared: np.ndarray
    shared_customers: np.ndarray
    shared_tables: list[np.ndarray]

    @property
    def base(self) -> float:
        return 1 / (self.distinct + 1)

    def seated(self, customers: np.ndarray, words: np.ndarray, sweep: int) -> np.ndarray:
        """Tables of each word at the root after the sweep, from its customers."""
        new = (STRENGTH + self.discount * max(self.tables[sweep - 1] - 1, 0)) * self.base
        return _seated(customers, np.full(len(customers), new), self.discount, _stream(mix(words), 71, sweep))

    def root(self, customers: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The root's probability of each word, averaged over its sweeps."""
        p = 0.0
        for s in range(1, ROOT_SWEEPS + 1):
            own = np.maximum(customers - self.discount * self.seated(customers, words, s), 0)
            p += (own + (STRENGTH + self.discount * self.tables[s]) * self.base) / (STRENGTH + self.customers)
        return (p / ROOT_SWEEPS).astype(np.float32).astype(float)

    def pairs(self, keys: np.ndarray, served: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The root's probability of each key's word, and what parents() takes of the keys that are pairs of a shared context."""
        root, at, slot = _apart(keys)
        p = self.root(served[root], keys[root] >> SLOT)[at]
        key = _pair_key(self.shared[slot[~root]], keys[~root] >> SLOT)
        return p, (served[~root], slot[~root], p[~root], key, self.pairs_discount)


def _model_of(gathered: DataFrame, shared: np.ndarray) -> Model:
    names = ["tokens", "distinct", "customers", "once", "twice", *FEW]
    s = gathered.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    model = Model(s["tokens"], s["distinct"], discount_from(s["once"], s["twice"]), float(s["customers"]), [float(s["distinct"])], discount_from(*s[5:7]), discount_from(*s[7:9]), shared, np.zeros(len(shared)), [])

    def summed(tell: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all parts of the words of what is told of their keys and customers: a few numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, served in zip(batch.column("keys"), batch.column("served")):
                    said = tell(np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(served.as_py(), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(said))), pa.array(said.astype(float))], ["at", "n"])

        rows = gathered.select("keys", "served").mapInArrow(run, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(max([r["at"] + 1 for r in rows], default=0))
        out[[r["at"] for r in rows]] = [r["n"] for r in rows]
        return out

    for sweep in range(1, ROOT_SWEEPS + 1):

        def at_root(keys: np.ndarray, served: np.ndarray, model: Model = model, sweep: int = sweep) -> np.ndarray:
            root = _apart(keys)[0]
            return np.array([model.seated(served[root], keys[root] >> SLOT, sweep).sum()])

        model.tables.append(float(summed(at_root).sum()))
    if len(shared):
        n = len(shared)

        def whole(keys: np.ndarray, served: np.ndarray) -> np.ndarray:
            root, _, slot = _apart(keys)
            slot, served = slot[~root], served[~root]
            return np.concatenate([np.bincount(slot, weights=served, minlength=n), np.bincount(slot, weights=served > 0, minlength=n)])

        model.shared_customers, first = summed(whole).reshape(2, n)
        model.shared_tables.append(first)
        for _ in range(PARENT_SWEEPS):

            def at_parents(keys: np.ndarray, served: np.ndarray, model: Model = model) -> np.ndarray:
                known = model.shared_tables
                _, pairs = model.pairs(keys, served)
                tables = next(t for s, (t, _) in enumerate(parents(*pairs, lambda s, _: known[min(s, len(known) - 1)]), 1) if s == len(known))
                return np.bincount(pairs[1], weights=tables, minlength=n)

            model.shared_tables.append(summed(at_parents))
    return model


def _answers(gathered: DataFrame, model: Model) -> DataFrame:
    """For each part and part of words: probability (at the root or in the shared context) and training count of what was asked for,
    in the order of the asking."""
    schema = "part int, asked int, n bigint, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                keys, n = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64)
                p, pairs = model.pairs(keys, np.frombuffer(r["served"], np.int64))
                if len(pairs[0]):
                    p[~_apart(keys)[0]] = parent_probability(*pairs, model.shared_customers, lambda s, _: model.shared_tables[s])
                parts, size = np.frombuffer(r["parts"], np.int32), np.frombuffer(r["sizes"], np.int64)
                (steps,) = _unzip(r["index"], (np.uint32, int(size.sum())))
                out = []
                for q, m, b in zip(parts, size, np.cumsum(size)):
                    index = np.cumsum(steps[b - m : b], dtype=np.uint32)
                    out.append((int(q), r["asked"], int(m), _zip(p[index].astype(np.float32), n[index])))
                yield _rows(schema, out)

    return gathered.mapInArrow(run, schema)


def _scored(merged: DataFrame, answers: DataFrame, model: Model, parts: int, sweeps: int, burn_in: int) -> DataFrame:
    """Partial sums of each part for each piece: documents, log10 probabilities, base scores and known tokens."""
    schema = "piece bigint, docs binary, score binary, base binary, known binary"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            said = [_unzip(r["data"], (np.float32, r["n"]), (np.int64, r["n"])) for r in sorted(right.to_pylist(), key=lambda r: r["asked"])]
            part = Part(left.to_pylist())
            part.discount = model.types_discount
            keys, place, pair = part.keys(model.shared)
            order = place[np.argsort(_word_part(keys >> SLOT, parts), kind="stable")]
            p, seen = np.empty(len(order)), np.empty(len(order), np.int64)
            p[order], seen[order] = np.concatenate([x for x, _ in said]), np.concatenate([x for _, x in said])
            tables = part.least()
            of_pair = np.empty(len(part.context))
            of_pair[pair] = p[len(part.words) :]
            own = np.ones(len(of_pair), bool)
            own[pair] = False
            context, served = part.context[own], part.served(tables)[own]
            tables_of = lambda _, t: np.bincount(context, weights=t, minlength=len(part.contexts))
            of_pair[own] = parent_probability(served, context, p[part.word[own]], part.pair_key[own], model.pairs_discount, tables_of(0, served), tables_of)
            total, samples = np.zeros(len(part.count)), 0
            for r in range(1, sweeps + 1):
                tables = part.reseated(tables, of_pair, 5, r)
                if r > burn_in:
                    total += part.under(tables, of_pair)
                    samples += 1
            word = part.word[part.pair][part.type]
            score = np.log10(np.minimum(total / samples, 1.0))[part.type]
            base = np.log10((seen[: len(part.words)] + 1) / (model.tokens + model.distinct + 1))[word]
            known = (seen[: len(part.words)] > 0)[word]
            end = np.cumsum(part.sizes)
            for piece, a, b in zip(part.pieces, end - part.sizes, end):
                doc = (part.doc[a:b] >> 1).astype(np.int64)
                has = np.flatnonzero(np.bincount(doc))
                sums = [np.bincount(doc, weights=x[a:b])[has] for x in (score, base, known)]
                out.append((int(piece), has.astype(np.uint16).tobytes(), sums[0].tobytes(), sums[1].tobytes(), sums[2].astype(np.uint32).tobytes()))
        return pa.Table.from_batches([_rows(schema, out)])

    return merged.filter("part >= 0").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, schema)


def _bucketed(df: DataFrame, buckets: int, scratch: Scratch) -> tuple[DataFrame, str]:
    """df as a table of the shared folder in buckets of `part`, so that what is joined by part comes to it; and its name."""
    spark = df.sparkSession
    name = f"ledgerline_{uuid.uuid4().hex}"
    scratch.also(spark, f"{shared_folder(spark)}/{name}")
    dealt = df.repartition(buckets, "part").sortWithinPartitions("part", "piece")
    with tidy(spark):
        dealt.write.bucketBy(buckets, "part").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def _frequent(rows: DataFrame, n: int, parts: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent tokens, sorted, and over how many parts each goes; from a sample of about SAMPLE_DOCS texts, which
    only decides how work is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            kinds, often = np.unique(_sequence(*utf8(batch.column("text")))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(often)], ["token", "n"])

    chance = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, SAMPLE_DOCS / max(n, 1))))
    sample = scratch.keep(rows.filter(chance).select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")))
    sampled = sample.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = sample.filter(F.col("n") >= max(1, HOT * sampled)).orderBy(F.desc("n"), "token").limit(int(1 / HOT)).collect() if sampled else []
    if not most:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hot = np.array([r["token"] for r in most], np.int64).view(np.uint64)
    order = np.argsort(hot)
    share = np.array([r["n"] for r in most])[order] / sampled
    return hot[order], np.clip(np.ceil(share * parts * 2), 1, parts).astype(np.int64)


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", sweeps: int = 3, burn_in: int = 1) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows where `train` holds train."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(LEAST_PARTS, math.ceil(whole["bytes"] / PART_BYTES))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    names = [f.split()[0] for f in schema.split(", ")]

    with Scratch() as scratch:
        dealt = _frequent(rows, whole["n"], parts, scratch)
        tables = [_bucketed(_packed(rows, parts, *dealt, turn, ROUNDS), buckets, scratch) for turn in range(ROUNDS)]
        shared = dealt[0][dealt[1] > 1]
        gathered = scratch.keep(_gathered(reduce(DataFrame.union, [_asks(t, parts, shared) for t, _ in tables])))
        model = _model_of(gathered, shared)
        # a piece's documents, and the partial sums of all parts for them
        no = F.lit(b"")
        own = tables[0][0].filter("part < 0").select("piece", F.lit(True).alias("whole"), F.col("sizes").alias("docs"), F.col("data").alias("score"), no.alias("base"), no.alias("known"))
        answers = scratch.keep(_answers(gathered, model))
        partial = reduce(DataFrame.union, [_scored(t, answers.filter(F.col("part") % ROUNDS == turn), model, parts, sweeps, burn_in) for turn, (t, _) in enumerate(tables)])
        partial = partial.select("piece", F.lit(False).alias("whole"), "docs", "score", "base", "known")
        n_train = model.tokens

        def total(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            head = next(r for r in rows if r["whole"])
            n = int(np.frombuffer(head["docs"], np.int64)[0])
            ids, size, flags = _unzip(head["score"], (np.int64, n), (np.int64, n), (np.uint8, n))
            score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
            for r in rows:
                if not r["whole"]:
                    at = np.frombuffer(r["docs"], np.uint16)
                    score[at] += np.frombuffer(r["score"], np.float64)
                    base[at] += np.frombuffer(r["base"], np.float64)
                    known[at] += np.frombuffer(r["known"], np.uint32)
            return pa.table([pa.array(ids, mask=(flags & 2) > 0), pa.array((flags & 1) > 0), pa.array(size), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), n_train)), pa.array(base), pa.array(score)], names)

        out = settled(own.union(partial).groupBy("piece").applyInArrow(total, schema))
        for _, name in tables:
            spark.sql(f"DROP TABLE {name}")
        return out.withColumnRenamed("id", id_col)
