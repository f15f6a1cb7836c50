"""The closest number or day of a table for each of another's, without comparing pairs.

A score falls on either side of the value asked for, so the best target is a neighbour in order, or, where several targets
score `perfect`, the first by position of a range. Distinct targets are cut into blocks along (key, value); each distinct
source value goes to the few blocks that hold its neighbours and the ends of its perfect range, and the blocks that lie
wholly inside that range are known by their least positions. Where rounding could decide, at the ends of the range and among
values nearer to each other than BAND, scores are computed and compared.

Keys are 64-bit hashes, 0 if there are none. Values are finite.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct targets of a block, about; sources of a group.
BLOCK, SLICE = 16_384, 1 << 19
#: Sampled targets for each block, from which its ends are taken; they only decide how work is dealt.
SAMPLED = 32
#: Relative distances within which rounding may decide: of values among each other, of values copied to both sides of a
#: block's end, of the ends of perfect ranges.
BAND, COPIED, EDGE = 1e-11, 1e-10, 1e-9
NONE = np.iinfo(np.int64).max


def value_scores(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """similarity.numeric_score or date_score of all pairs."""
    with np.errstate(all="ignore"):
        if kind == "numeric":
            near = np.maximum(0.0, 100.0 - np.abs(a - b) / np.abs(b) * 100)
            same = (a == b) | (np.isnan(a) & np.isnan(b))
            return np.where(same, 100.0, np.where(b == 0, 0.0, np.where(np.isnan(near), np.inf, near)))  # as Spark orders NaN
        d = np.abs(a - b)
        return np.select([d == 0, d == 1, d <= 7, d <= 30], [100.0, 95.0, 95.0 - (d - 1) * 5.0, np.maximum(0.0, 65.0 - (d - 7) * 2.8)], 0.0)


def reach(kind: str, a: np.ndarray, perfect: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outer and inner low end, inner and outer high end: between the inner ends all values score `perfect`, beyond the outer ones none."""
    if kind == "date":
        days = np.count_nonzero(value_scores(kind, np.arange(31.0), np.zeros(31)) >= perfect) - 1
        return a - days, a - days, a + days, a + days
    one, other = a * (100 / (200 - perfect)), a * (100 / perfect)
    low, high, room = np.minimum(one, other), np.maximum(one, other), EDGE * np.abs(a) + 1e-300
    return low - room, np.minimum(low + room, a), np.maximum(high - room, a), high + room


def place(keys: np.ndarray, values: np.ndarray, k: np.ndarray, v: np.ndarray, after: bool = False) -> np.ndarray:
    """How many of the ordered (keys, values) lie before (k, v); `after`: those equal to it too."""
    low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = values[np.minimum(mid, len(values) - 1)]
        go = open_ & ((at <= v) if after else (at < v))
        low, high = np.where(go, mid + 1, low), np.where(open_ & ~go, mid, high)
    return low


class _Least:
    """The least of any range of an array, by the least of ranges of 1, 2, 4, ... from each place."""

    def __init__(self, x: np.ndarray) -> None:
        self.rows = [x]
        while 2 << (len(self.rows) - 1) <= len(x):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = np.full(len(start), NONE, np.int64)
        size = np.maximum(stop - start, 0)
        level = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
        for n in np.unique(level[size > 0]):
            at = np.flatnonzero((size > 0) & (level == n))
            out[at] = np.minimum(self.rows[n][start[at]], self.rows[n][stop[at] - (1 << int(n))])
        return out


class _Blocks:
    """Ends of the blocks, and what each holds: first and last (key, value), and the least position of its own targets."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values, self.n = keys, values, len(keys) + 1

    def tell(self, rows: list) -> None:
        at = np.array([r["block"] for r in rows], np.int64)
        self.full, self.ends = np.zeros(self.n, bool), {}
        self.full[at] = True
        for side in ("first", "last"):
            k, v = np.zeros(self.n, np.int64), np.zeros(self.n)
            k[at], v[at] = [r[side]["k"] for r in rows], [r[side]["v"] for r in rows]
            self.ends[side] = k, v
        least = np.full(self.n, NONE, np.int64)
        least[at] = [NONE if r["least"] is None else r["least"] for r in rows]
        self.least = _Least(least)
        number = np.arange(self.n)
        self.before = np.concatenate([[-1], np.maximum.accumulate(np.where(self.full, number, -1))[:-1]])
        later = np.minimum.accumulate(np.where(self.full, number, self.n)[::-1])[::-1]
        self.behind = np.append(later[1:], self.n)

    def of(self, k: np.ndarray, v: np.ndarray) -> np.ndarray:
        return place(self.keys, self.values, k, v, after=True)

    def visited(self, kind: str, perfect: float, k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which source, its block), all that it has to see; and for each source the least position of the blocks between."""
        own = self.of(k, v)
        low_out, low, high, high_out = (self.of(k, x) for x in reach(kind, v, perfect))
        between = self.least.of(low + 1, high)
        wanted = [np.where(self.full[own], own, -1)]
        for side, other in (("first", self.before), ("last", self.behind)):
            (end_k, end_v), to = self.ends[side], other[own]
            outside = ~self.full[own] | (end_k[own] != k) | ((v < end_v[own]) if side == "first" else (v > end_v[own]))
            there = (to >= 0) & (to < self.n)
            facing = self.ends["last" if side == "first" else "first"][0][np.clip(to, 0, self.n - 1)]
            wanted.append(np.where(outside & there & (facing == k), to, -1))
        for start, stop in ((low_out, low), (high, high_out)):
            for step in range(int((stop - start).max(initial=0)) + 1):
                wanted.append(np.where(start + step <= stop, start + step, -1))
        all_ = np.sort(np.stack(wanted, 1), 1)
        keep = all_ >= 0
        keep[:, 1:] &= all_[:, 1:] != all_[:, :-1]
        which, at = np.nonzero(keep)
        return which, all_[which, at], between


def _best_of(kind: str, least: float, perfect: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block, the best target of each source that has one above `least`."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        k, v, at = (left.column(c).to_numpy() for c in ("k", "v", "between"))
        keys, values, pos = (right.column(c).to_numpy() for c in ("k", "v", "t_pos"))
        order = np.lexsort((values, keys))
        keys, values, pos = keys[order], values[order], pos[order]
        begin, end = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        low_out, low, high, high_out = reach(kind, v, perfect)
        bound = lambda x, after: place(keys, values, k, x, after)
        first, last = bound(low, False), bound(high, True)
        at = np.minimum(at, _Least(pos).of(first, last)) if len(pos) else at.copy()
        below = np.where(at < NONE, 0.0, np.inf)
        imperfect = at == NONE

        def take(row: np.ndarray, target: np.ndarray) -> None:
            """One target for each of the rows."""
            score = value_scores(kind, v[row], values[target])
            worse, under, p = score < perfect, np.where(score >= perfect, 0.0, -score), pos[target]
            is_, was = imperfect[row], below[row]
            better = (score > least) & ((worse < is_) | ((worse == is_) & ((under < was) | ((under == was) & (p < at[row])))))
            row = row[better]
            imperfect[row], below[row], at[row] = worse[better], under[better], p[better]

        def along(row: np.ndarray, start: np.ndarray, goes_on: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int) -> None:
            target = start
            while len(row):
                inside = (target >= begin[row]) & (target < end[row])
                row, target = row[inside], target[inside]
                on = goes_on(row, target)
                row, target = row[on], target[on]
                take(row, target)
                target = target + step

        every = np.arange(len(v))
        along(every, bound(low_out, False), lambda r, t: t < first[r], 1)
        along(every, last, lambda r, t: values[t] <= high_out[r], 1)
        open_ = np.flatnonzero(imperfect)
        here = bound(v, False)
        for step, start in ((1, here), (-1, here - 1)):
            near = values[np.clip(start, 0, max(len(values) - 1, 0))] if len(values) else v
            along(open_, start[open_], lambda r, t: np.abs(values[t] - near[r]) <= BAND * np.abs(near[r]), step)  # noqa: B023
        has = at < NONE
        return pa.table({"k": k[has], "v": v[has], "t_pos": at[has], "imperfect": imperfect[has], "below": below[has]})

    return run


def nearest(source: DataFrame, targets: DataFrame, kind: str, least: float, perfect: float, block: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """k, v, t_pos, imperfect, below: for each distinct (k, v) of `source`, candidates of `targets` (k, v, t_pos) with their order;
    the least by (imperfect, below, t_pos) is the best of all targets of the key. 0 <= least < perfect <= 100."""
    block, slice_rows = block or BLOCK, slice_rows or SLICE
    asked = source.select("k", "v").distinct()
    known = targets.groupBy("k", "v").agg(F.min("t_pos").cast("bigint").alias("t_pos"))
    n = known.count()
    blocks = -(-n // block)
    keys, values = np.zeros(0, np.int64), np.zeros(0)
    if blocks > 1:
        chance = F.pmod(F.xxhash64("k", "v", F.lit(29)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLED * blocks / n)))
        drawn = known.filter(chance).select("k", "v").toPandas().sort_values(["k", "v"])
        cut = drawn.iloc[np.unique(np.arange(1, blocks) * len(drawn) // blocks)] if len(drawn) else drawn
        keys, values = cut["k"].to_numpy(np.int64), cut["v"].to_numpy(float)
    all_ = _Blocks(keys, values)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, v, pos = (batch.column(c).to_numpy() for c in ("k", "v", "t_pos"))
            room = COPIED * np.abs(v)
            own, first, last = all_.of(k, v), all_.of(k, v - room), all_.of(k, v + room)
            for step in range(int((last - first).max(initial=0)) + 1):
                to = first + step
                on = to <= last
                yield pa.RecordBatch.from_pydict({"block": to[on], "k": k[on], "v": v[on], "t_pos": pos[on], "own": (to == own)[on]})

    placed = known.mapInArrow(dealt, "block bigint, k bigint, v double, t_pos bigint, own boolean")
    at = F.struct("k", "v")
    all_.tell(placed.groupBy("block").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min(F.when(F.col("own"), F.col("t_pos"))).alias("least")).collect())

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, v = (batch.column(c).to_numpy() for c in ("k", "v"))
            which, to, between = all_.visited(kind, perfect, k, v)
            yield pa.RecordBatch.from_pydict({"block": to, "k": k[which], "v": v[which], "between": between[which]})

    going = asked.mapInArrow(visits, "block bigint, k bigint, v double, between bigint")
    slices = F.lit(1)
    if crowded := {r["block"]: -(-r["count"] // slice_rows) for r in going.groupBy("block").count().filter(F.col("count") > slice_rows).collect()}:
        slices = F.coalesce(F.create_map(*[F.lit(x).cast("bigint") for pair in crowded.items() for x in pair])[F.col("block")], F.lit(1).cast("bigint"))
    going = going.withColumn("slice", F.pmod(F.xxhash64("k", "v"), slices).cast("int"))
    placed = placed.drop("own").withColumn("slice", F.explode(F.sequence(F.lit(0), slices.cast("int") - 1)))
    tasks = max(1, min(all_.n + sum(crowded.values()), 10_000))
    going, placed = (df.repartition(tasks, "block", "slice") for df in (going, placed))
    return going.groupBy("block", "slice").cogroup(placed.groupBy("block", "slice")).applyInArrow(_best_of(kind, least, perfect), "k bigint, v double, t_pos bigint, imperfect boolean, below double")
