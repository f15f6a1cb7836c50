"""Spelling variants: words that differ by one edit, found by two-dimensional range reporting on wavelet trees.

Take words of m letters, sorted as they are (forward) and by their reversed letters (reverse). The words that agree with
some word except for one letter at place i share its first i letters, an interval of the forward order, and its last
m - 1 - i, an interval of the reverse order. Each word is a point (forward rank, reverse rank), and a wavelet tree over the
points reports those in both intervals in a number of steps that is logarithmic for each. Replaced letters are asked for
by words of m letters, inserted ones by words of m - 1 (deletions are these, seen from the other side).

No tree holds the whole vocabulary. A frame (m, lo, hi) stands for edits at places lo to hi - 1 of words of m letters, which
leave the letters before lo and from hi on alone; words that share these form a group, and each has a small tree of its
own. A word is in four frames at first: both halves for m = its length, and both for one letter more. Groups are
counted before any word is moved; one of more than MOST words has its frame halved, which adds letters to its key, until
groups are small. A frame of one place holds at most a word for each letter, so this ends, and no word is left out.

Defined results: null and empty texts have no words; a null id counts as an empty one where words are told from it; runs
and words of any length are taken whole; repeated rows count as often as they stand there; ties go to the word that is
smaller in code points; an empty table gives an empty result; further columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, settled, whole_groups

#: Groups of more words than this are divided.
MOST = 4096
#: A task looks at groups of so many rows together.
AT_ONCE = 16384
BETWEEN = r"[^A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_TIMES, DROP = 5, 3, 97


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, drop: int | None = DROP) -> DataFrame:
    """word, n: the words of at least so many letters that occur at least so many times.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Where `drop` divides h, the unsigned crc32 of
    "<id>:<run>", a run loses its letter h % length (from 0); None takes runs as they are.
    """
    low = F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.split(low, BETWEEN)).alias("run")).filter(F.length("run") >= least_letters)
    word: Column = F.col("run")
    if drop is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % drop == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_times)


# ------------------------------------------------------------------ frames


def _framed(words: DataFrame, frames: Column) -> DataFrame:
    """A row for each word and frame: key, m, lo, hi, word, n, is_point (of m letters, not one less)."""
    rows = words.select("word", "n", F.explode(frames).alias("f")).select("word", "n", "f.m", "f.lo", "f.hi").filter("hi > lo")
    kept = F.length("word") - (F.col("m") - F.col("hi"))  # where the letters behind the frame begin
    head, tail = F.substring("word", F.lit(1), F.col("lo")), F.substring("word", kept + 1, F.col("m") - F.col("hi"))
    return rows.select(F.xxhash64("m", "lo", "hi", head, tail).alias("key"), "m", "lo", "hi", "word", "n", (F.length("word") == F.col("m")).alias("is_point"))


def _halves(m: Column, lo: Column, hi: Column) -> list[Column]:
    mid = F.floor((lo + hi) / 2).cast("int")
    frame = lambda a, b: F.struct(m.alias("m"), a.alias("lo"), b.alias("hi"))
    return [frame(lo, mid), frame(mid, hi)]


def _groups(words: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """All frames, divided until every group has at most `most` rows or its frame is one place."""
    size = F.length("word")
    open_ = _framed(words, F.array(*_halves(size, F.lit(0), size), *_halves(size + 1, F.lit(0), size + 1)))
    done = None
    while True:
        large = scratch.keep(open_.filter(F.col("hi") - F.col("lo") > 1).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > most).select("key"))
        if large.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        divided = lambda how: open_.join(large, "key", how)
        rest = divided("left_anti").select(*open_.columns)
        done = rest if done is None else done.unionByName(rest)
        open_ = scratch.keep(_framed(divided("left_semi"), F.array(*_halves(F.col("m"), F.col("lo"), F.col("hi")))))


# ------------------------------------------------------- inside tasks: trees


class WaveletTree:
    """Points (place, value) of a permutation, a level for each bit of the values, as counts of zeros before each place."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(int(len(values) - 1).bit_length(), 1)
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rectangles [left, right) x [low, high): the number of the rectangle and the value, for each point inside."""
        which, value = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - 1 - level)
            l0, r0 = zeros[left], zeros[right]
            l1, r1 = zeros[-1] + left - l0, zeros[-1] + right - r0
            left, right = np.concatenate([l0, l1]), np.concatenate([r0, r1])
            which, value = np.concatenate([which, which]), np.concatenate([value, value + half])
            inside = (left < right) & (value < high[which]) & (value + half > low[which])
            left, right, which, value = left[inside], right[inside], which[inside], value[inside]
        return which, value


def _shared(words: list[str], group: np.ndarray) -> np.ndarray:
    """How many letters each word shares with the one before, from its start; -1 where a group begins."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    out = np.where(np.concatenate([[True], group[1:] != group[:-1]]), -1, 0)
    at, d = np.flatnonzero(out == 0), 0
    while len(at):
        at = at[(size[at] > d) & (size[at - 1] > d)]
        at = at[letters[start[at] + d] == letters[start[at - 1] + d]]
        d += 1
        out[at] = d
    return out


def _interval(shared: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in an order: the interval of those that share so many letters with it."""
    first = np.flatnonzero(shared < letters)
    run = np.cumsum(shared < letters) - 1
    return first[run], np.append(first[1:], len(shared))[run]


def near_in_frame(words: list[str], group: np.ndarray, is_point: np.ndarray, m: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of places: b has m letters and arises from a by an edit at a place in [lo, hi).

    Rows come sorted by group, then word. Words are distinct within (group, is_point). An inserted letter that repeats the
    one before it counts at the first such place only, so that no frame finds a pair again.
    """
    backward = np.array(sorted(range(len(words)), key=lambda i: (group[i], words[i][::-1])), np.int64)
    place = np.empty(len(words), np.int64)
    place[backward] = np.arange(len(words))
    forward_shared = _shared(words, group)
    backward_shared = _shared([words[i][::-1] for i in backward], group[backward])
    points = np.concatenate([[0], np.cumsum(is_point)])  # points before each place, forward
    backward_points = np.concatenate([[0], np.cumsum(is_point[backward])])
    at = np.flatnonzero(is_point)
    by_value = backward[is_point[backward]]
    tree = WaveletTree(backward_points[place[at]])
    asks = []
    for i in range(lo, hi):
        left, right = _interval(forward_shared, i)
        low, high = _interval(backward_shared, m - 1 - i)
        box = points[left], points[right], backward_points[low[place]], backward_points[high[place]]
        ask = np.flatnonzero((box[1] - box[0] > is_point) & (box[3] - box[2] > is_point))  # more than itself
        asks.append((ask, np.full(len(ask), i), *[x[ask] for x in box]))
    row, where, *box = (np.concatenate(x) for x in zip(*asks))
    which, value = tree.report(*box)
    a, b, i = row[which], by_value[value], where[which]
    other = a != b
    a, b, i = a[other], b[other], i[other]
    again = np.fromiter((not p and k > 0 and words[x][k - 1] == words[y][k] for x, y, k, p in zip(a.tolist(), b.tolist(), i.tolist(), is_point[a].tolist())), bool, len(a))
    return a[~again], b[~again]


_NEAR = "word string, n_near bigint, best_n bigint, best string"


def _near_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by m, lo, hi, key, word: for each of them with near words in its group, how many and the most frequent."""
    for table, _ in whole_groups(batches, "key", AT_ONCE):
        kind = np.stack([table.column(c).to_numpy() for c in ("m", "lo", "hi")], 1)
        cuts = [0, *(np.flatnonzero((kind[1:] != kind[:-1]).any(1)) + 1).tolist(), len(kind)]
        for start, end in zip(cuts, cuts[1:]):
            part = table.slice(start, end - start)
            words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
            key = part.column("key").to_numpy()
            group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            is_point = part.column("is_point").to_numpy(zero_copy_only=False).astype(bool)
            a, b = near_in_frame(words, group, is_point, *map(int, kind[start]))
            inserted = ~is_point[a]
            x, y = np.concatenate([a, b[inserted]]), np.concatenate([b, a[inserted]])
            order = np.lexsort((y, -n[y], x))  # within a group, places follow the words
            x, y = x[order], y[order]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(x)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in x[first]], pa.string()), pa.array(count, pa.int64()), pa.array(n[y[first]], pa.int64()), pa.array([words[i] for i in y[first]], pa.string())],
                names=["word", "n_near", "best_n", "best"])


# ------------------------------------------------------------------ results


def near_words(words: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """word, n_near, best_n, best for each of the distinct words (word, n) that has near ones; best: the most frequent, ties to the smaller."""
    rows = _groups(words, scratch, most).repartition("key").sortWithinPartitions("m", "lo", "hi", "key", "word")
    found = rows.mapInArrow(_near_in_groups, _NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("best"))
    return found.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.best").alias("best"))


def variant_groups(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n).

    form: the near word of largest n, if that is at least twice the word's own; root: where following forms ends. Since n
    doubles from form to form, ways are short, and a round of pointer jumping doubles what of them is covered.
    """
    with Scratch() as scratch:
        words = scratch.keep(words)
        near = words.join(near_words(words, scratch, most), "word", "left")
        has = F.col("best_n") >= 2 * F.col("n")
        known = scratch.keep(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
        ways = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
        bounds = known.agg(F.min("n"), F.max("n")).first()
        steps = math.floor(math.log2(bounds[1] / bounds[0])) if bounds[0] else 0
        for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
            on = ways.select(F.col("word").alias("at"), F.col("root").alias("next"))
            ways = scratch.keep(ways.join(on, ways["root"] == on["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            if ways.filter("moved").isEmpty():
                break
        roots = ways.select("word", "root")
        return settled(known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
