"""Upper bounds of similarity for all pairs of two lists of values at once, cheap enough to leave most pairs unscored.

A common subsequence can't be longer than the characters that two texts share, whatever their order. Shared characters
are bounded by counting them in classes: the sum over classes of the lesser count. Words are treated alike, by classes of
their hashes, for the part of a score that compares sets of words. No bound is below the score it stands for.
"""

from __future__ import annotations

import zlib

import numpy as np

CLASSES = 64
#: Room for how sums of rounded numbers differ.
SLACK = 1e-7


class Texts:
    """What bounds need of a list of texts (trimmed; None counts as empty)."""

    def __init__(self, texts: list[str | None]) -> None:
        n = len(texts)
        self.chars, self.words = np.zeros((n, CLASSES), np.int32), np.zeros((n, CLASSES), np.int32)
        sizes = np.zeros((6, n), np.int32)
        for i, text in enumerate(texts):
            text = text or ""
            words = text.split()
            kept = set(words)
            solid = "".join(words)
            letters = sum(map(len, kept))
            sizes[:, i] = len(text), len(text) - len(solid), len(words), len(solid), letters, len(kept)
            if solid:
                self.chars[i] = np.bincount(np.frombuffer(solid.encode("utf-32-le"), np.uint32) % CLASSES, minlength=CLASSES)
            for w in kept:
                self.words[i, zlib.crc32(w.encode()) % CLASSES] += len(w)
        self.size, self.blank, self.n_words, self.solid, self.letters, self.n_kept = sizes

    def part(self, rows: slice) -> Texts:
        out = object.__new__(Texts)
        for k, v in vars(self).items():
            setattr(out, k, v[rows])
        return out


def _lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int32)
    for k in np.flatnonzero(a.any(0) & b.any(0)):
        out += np.minimum(a[:, k, None], b[None, :, k])
    return out


def bound(a: Texts, b: Texts, identifier: bool = False) -> np.ndarray:
    """For all pairs: at least text_similarity (identifier_similarity) of texts that differ."""
    col, row = lambda x: x[:, None], lambda x: x[None, :]
    over = lambda common, x, y: 200.0 * common / np.maximum(x + y, 1)
    solid = _lesser(a.chars, b.chars)
    m, n = col(a.size), row(b.size)
    common = np.minimum(solid + np.minimum(col(a.blank), row(b.blank)), np.minimum(m, n))
    least = np.minimum(m, n)
    ratio = over(common, m, n)
    partial = np.where(common >= least, 100.0, 200.0 * common / np.maximum(least + common, 1))
    spaces = np.maximum(np.minimum(col(a.n_words), row(b.n_words)) - 1, 0)
    joined = lambda x: x.solid + np.maximum(x.n_words - 1, 0)
    ordered = over(np.minimum(solid + spaces, np.minimum(col(joined(a)), row(joined(b)))), col(joined(a)), row(joined(b)))
    if identifier:
        total = 0.4 * ratio + 0.3 * partial + 0.3 * ordered
    else:
        kept = lambda x: x.letters + np.maximum(x.n_kept - 1, 0)
        x, y = col(kept(a)), row(kept(b))
        sets = over(np.minimum(solid + spaces, np.minimum(x, y)), x, y)
        shared = _lesser(a.words, b.words)
        length = np.minimum(shared + np.maximum(np.minimum(col(a.n_kept), row(b.n_kept)) - 1, 0), np.minimum(x, y))
        with_shared = np.where(shared >= np.minimum(col(a.letters), row(b.letters)), 100.0, 200.0 * length / np.maximum(length + np.minimum(x, y), 1))
        sets = np.where(shared > 0, np.maximum(sets, with_shared), sets)
        total = 0.3 * ratio + 0.2 * partial + 0.25 * ordered + 0.25 * sets
    return np.where((m > 0) & (n > 0), np.minimum(total, 100.0) + SLACK, 0.0)
