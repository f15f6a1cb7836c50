"""Text similarity of whole columns of pairs: the scores of functions.similarity, from bit-parallel subsequences in numpy.

A longest common subsequence keeps a row of bits for each pair, in 64-bit words, and steps through the second texts
together: all pairs of a batch take the same step at once. Partial ratios first bound every window by the characters
that it shares with the shorter text, again for all pairs at once, and then compare windows from the highest bound on, until no
bound is above the best. Pairs with a text of more than LONG characters go to the plain functions, one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LONG = 256
#: So many pairs are looked at together.
PAIRS = 4096
#: In one round, so many windows of a pair are compared.
WINDOWS = 4


def _codes(*columns: Sequence[str]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Each column of texts as rows of character numbers from 1 (0 behind their ends), and the lengths; how many numbers there are."""
    flat = np.frombuffer("".join("".join(c) for c in columns).encode("utf-32-le"), np.uint32)
    kinds, numbers = np.unique(flat, return_inverse=True)
    tables, sizes, start = [], [], 0
    for c in columns:
        size = np.fromiter(map(len, c), np.int64, len(c))
        table = np.zeros((len(c), int(size.max(initial=0))), np.int32)
        inside = np.arange(table.shape[1]) < size[:, None]
        table[inside] = numbers[start : start + int(size.sum())] + 1
        start += int(size.sum())
        tables.append(table)
        sizes.append(size)
    return tables, sizes, len(kinds) + 1


def common_lengths(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, kinds: int) -> np.ndarray:
    """Lengths of the longest common subsequences of rows a and rows b of character numbers."""
    n, words = len(a), max(1, -(-a.shape[1] // 64))
    rows = np.arange(n)
    masks = np.zeros((n, kinds, words), np.uint64)
    for i in range(a.shape[1]):
        masks[rows, a[:, i], i // 64] |= np.uint64(1 << (i % 64))
    masks[:, 0] = 0  # nothing stands behind the ends
    full = np.zeros((n, words), np.uint64)
    for w in range(words):
        bits = np.clip(a_size - 64 * w, 0, 64)
        full[:, w] = np.where(bits == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << bits.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
    state = full.copy()
    for j in range(b.shape[1]):
        hit = masks[rows, b[:, j]] & state
        if words == 1:
            state = (state + hit) | (state - hit)
            continue
        carry = np.zeros(n, np.uint64)
        for w in range(words):
            s, u = state[:, w], hit[:, w]
            once = s + u
            twice = once + carry
            carry = ((once < s) | (twice < once)).astype(np.uint64)
            state[:, w] = twice | (s - u)
    return a_size - np.bitwise_count(state & full).sum(1).astype(np.int64)


def _ratio(common: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    return np.where(a_size + b_size > 0, 200 * common / np.maximum(a_size + b_size, 1), 100.0)


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """similarity.ratio of each pair."""
    (x, y), (m, n), kinds = _codes(a, b)
    return _ratio(common_lengths(x, m, y, kinds), m, n)


def best_windows(short: Sequence[str], long: Sequence[str]) -> np.ndarray:
    """The best ratio of each short text with windows of its length in the long one, cut off at its ends."""
    (s, t), (n, m), kinds = _codes(short, long)
    count, ends = len(s), s.shape[1] + t.shape[1]
    rows = np.arange(count)
    lacking = np.zeros((count, kinds), np.int32)
    for i in range(s.shape[1]):
        lacking[rows, s[:, i]] += 1
    bound = np.full((count, ends + 1), -1.0)
    shared = np.zeros(count, np.int64)
    padded = np.concatenate([t, np.zeros((count, ends + 1 - t.shape[1]), np.int32)], 1)
    for e in range(1, ends + 1):  # the window ends before e
        c = padded[:, e - 1]
        new = c > 0
        shared += new & (lacking[rows, c] > 0)
        lacking[rows, c] -= new
        gone = e - 1 - n
        c = np.where((gone >= 0) & (gone < m), padded[rows, np.maximum(gone, 0)], 0)
        old = c > 0
        lacking[rows, c] += old
        shared -= old & (lacking[rows, c] > 0)
        size = np.minimum(e, m) - np.maximum(0, e - n)
        bound[:, e] = np.where((e < n + m) & (size > 0), 200 * shared / (n + np.maximum(size, 1)), -1.0)
    best = np.zeros(count)
    active = rows
    while len(active := active[bound[active].max(1) > best[active]]):
        k = min(WINDOWS, bound.shape[1])
        top = np.argpartition(-bound[active], k - 1, axis=1)[:, :k]
        pair, e = np.repeat(active, k), top.ravel()
        worth = bound[pair, e] > best[pair]
        pair, e = pair[worth], e[worth]
        bound[pair, e] = -1.0
        first, last = np.maximum(0, e - n[pair]), np.minimum(e, m[pair])
        at = first[:, None] + np.arange(s.shape[1])
        window = np.where(at < last[:, None], padded[pair[:, None], np.minimum(at, padded.shape[1] - 1)], 0)
        got = _ratio(common_lengths(s[pair], n[pair], window, kinds), n[pair], last - first)
        np.maximum.at(best, pair, got)
    return best


def _partial(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    out = best_windows(short, long)
    same = [i for i, (x, y) in enumerate(zip(a, b)) if len(x) == len(y)]
    if same:
        out[same] = np.maximum(out[same], best_windows([long[i] for i in same], [short[i] for i in same]))
    return out


def _chunk(a: list[str], b: list[str], identifier: bool) -> np.ndarray:
    spaced = lambda words: " ".join(sorted(words))
    sort_a, sort_b = [spaced(x.split()) for x in a], [spaced(x.split()) for x in b]
    n = len(a)
    if identifier:
        all_ = ratios(a + sort_a, b + sort_b)
        return np.minimum(100.0, 0.4 * all_[:n] + 0.3 * _partial(a, b) + 0.3 * all_[n:])
    with_a, with_b, least = [], [], np.zeros(n)
    for i, (x, y) in enumerate(zip(a, b)):
        u, v = set(x.split()), set(y.split())
        both, left, right = u & v, u - v, v - u
        if not u or not v or (both and (not left or not right)):
            least[i] = 100.0 if u and v else 0.0
            with_a.append("")
            with_b.append("x")  # has nothing in common
            continue
        common = spaced(both)
        with_a.append(" ".join(sorted(both) + sorted(left)))
        with_b.append(" ".join(sorted(both) + sorted(right)))
        if both:  # the shared words begin both texts
            k = len(common)
            least[i] = max(200 * k / (k + len(with_a[-1])), 200 * k / (k + len(with_b[-1])))
    all_ = ratios(a + sort_a + with_a, b + sort_b + with_b)
    return np.minimum(100.0, 0.3 * all_[:n] + 0.2 * _partial(a, b) + 0.25 * all_[n : 2 * n] + 0.25 * np.maximum(all_[2 * n :], least))


def scores(a: Sequence[str], b: Sequence[str], kind: str = "text") -> np.ndarray:
    """similarity.text_similarity, or identifier_similarity, of each pair."""
    from . import similarity

    out = np.zeros(len(a))
    plain = similarity.identifier_similarity if kind == "identifier" else similarity.text_similarity
    known: dict[tuple[str, str], list[int]] = {}  # values repeat: each pair is scored once
    for i, pair in enumerate(zip(a, b)):
        known.setdefault(pair, []).append(i)
    quick = []
    for pair, at in known.items():
        if not pair[0] or not pair[1]:
            continue
        if max(map(len, pair)) > LONG:
            out[at] = plain(*pair)
        else:
            quick.append(pair)
    quick.sort(key=lambda p: len(p[0]) + len(p[1]))  # texts of like length meet
    for start in range(0, len(quick), PAIRS):
        part = quick[start : start + PAIRS]
        for pair, score in zip(part, _chunk([x for x, _ in part], [y for _, y in part], kind == "identifier").tolist()):
            out[known[pair]] = score
    return out
