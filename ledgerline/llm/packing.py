"""Best-fit packing of documents into sequences of several permitted lengths.

Texts are counted in words, plus one for the end of each document. A document longer than the longest sequence is cut
into full sequences and a rest; rests and shorter documents are then packed by best fit, longest first: each goes into
the open bin that it fills most. If none can take it, a new bin is opened. Its capacity is the one of least cost for a
token that it is going to hold: for each permitted capacity the lengths still to be packed are looked through for what
would fill it, and the bin is priced at the least capacity for that content. Costs are a fixed part, a part for each token
of capacity and one for its square (attention), so the permitted lengths are weighed against each other by the lengths at
hand. All this is done for every menu, a choice of the permitted capacities that has the longest; the menu with the least
total cost counts. When all is packed, every bin shrinks to the least permitted capacity that holds its contents.

Packing is local to a group of about `group_docs` documents dealt by a hash of the id and the number of tokens, so groups are
alike, no task holds more than a group, only ids and lengths move, and the result doesn't depend on how the table is
partitioned. Rows that are alike in both are counted, and dealt in runs of up to RUN, each to a group of its own.

Defined results: null and empty texts have one token, the end; texts of any length are cut as above; repeated rows are packed
each; ties go by id, of bins with equal room the one that got it last is taken; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import token_count

CAPACITIES = (512, 1024, 2048, 4096)
#: Rows of one id and length that are dealt together.
RUN = 1000


def cost(capacity: int, fixed: float = 16.0, square: float = 1 / 32768) -> float:
    return fixed + capacity + square * capacity * capacity


class _Left:
    """Lengths still to be packed, by value."""

    def __init__(self, lengths: Sequence[int]):
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.values = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.count[n]
            self.values.pop(bisect_left(self.values, n))

    def fill(self, room: int) -> int:
        """How many of `room` tokens the lengths fill, longest first."""
        left, i = room, bisect_right(self.values, room) - 1
        while i >= 0:
            v = self.values[i]
            left -= v * min(self.count[v], left // v)
            i = min(i, bisect_right(self.values, left)) - 1
        return room - left


def _best_fit(lengths: Sequence[int], menu: Sequence[int], capacities: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Best fit with bins of the menu's capacities: the bin and the offset of each length, and each bin's contents."""
    holds = lambda n: capacities[bisect_left(capacities, n)]
    left = _Left(lengths)
    room: dict[int, list[int]] = {}  # free tokens -> bins
    free: list[int] = []  # the keys of `room`, ascending
    filled: list[int] = []
    where, offset = [], []
    for n in lengths:
        left.take(n)
        i = bisect_left(free, n)
        if i < len(free):
            space = free[i]
            b = room[space].pop()
            if not room[space]:
                del room[space]
                free.pop(i)
        else:
            space, least = 0, math.inf
            for c in menu:
                if c >= n:
                    content = n + left.fill(c - n)
                    if (price := cost(holds(content)) / content) < least:
                        space, least = c, price
            b = len(filled)
            filled.append(0)
        where.append(b)
        offset.append(filled[b])
        filled[b] += n
        if space > n:
            if space - n not in room:
                room[space - n] = []
                free.insert(bisect_left(free, space - n), space - n)
            room[space - n].append(b)
    return where, offset, filled


def menus(capacities: Sequence[int]) -> list[tuple[int, ...]]:
    """Choices of capacities, all with the longest: every one of up to four, else the longest few of them."""
    *rest, longest = sorted(capacities)
    if len(rest) <= 3:
        return [(*some, longest) for n in range(len(rest), -1, -1) for some in combinations(rest, n)]
    return [(*rest[i:], longest) for i in range(len(rest) + 1)]


def pack(lengths: Sequence[int], capacities: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """The bin and the offset of each length, in the given order, and the capacity of each bin when done."""
    capacities = sorted(capacities)
    best, least = ([], [], []), math.inf
    for menu in menus(capacities):
        where, offset, filled = _best_fit(lengths, menu, capacities)
        sizes = [capacities[bisect_left(capacities, f)] for f in filled]
        total = sum(map(cost, sizes))
        if total < least:
            best, least = (where, offset, sizes), total
    return best


def dealt(docs: DataFrame, id_col: str, text_col: str, group_docs: int) -> DataFrame:
    """id, tokens, copies, group: rows alike in id and tokens are one row for each run of them."""
    sized = docs.select(F.col(id_col).alias("id"), (token_count(F.col(text_col)) + 1).alias("tokens"))
    same = sized.groupBy("id", "tokens").agg(F.count("*").alias("copies"))
    groups = max(1, math.ceil(docs.count() / group_docs))
    runs = same.select("id", "tokens", "copies", F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / RUN).cast("int"))).alias("run"))
    copies = F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN)
    return runs.select("id", "tokens", copies.cast("int").alias("copies"), F.pmod(F.xxhash64("id", "tokens", "run"), F.lit(groups)).cast("int").alias("group"))


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, id_col: str = "doc_id", text_col: str = "text", group_docs: int = 5000) -> DataFrame:
    """A row for each document or part of one: its id, part (from 0), first_token and n_tokens in the document, bin_id,
    bin_capacity and bin_offset. Bins are numbered within their group: bin_id is "group-number".
    """
    longest = max(capacities)
    rows = dealt(docs, id_col, text_col, group_docs)
    kind = rows.schema["id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "tokens", "copies"], kind="stable")
        rows = rows.loc[rows.index.repeat(rows.copies)].reset_index(drop=True)
        whole = (rows.tokens - 1) // longest  # full sequences before the rest
        parts = rows.loc[rows.index.repeat(whole + 1)].copy()
        parts["part"] = parts.groupby(level=0).cumcount()
        parts["first_token"] = parts.part * longest
        parts["n_tokens"] = (parts.tokens - parts.first_token).clip(upper=longest)
        parts = parts.reset_index(drop=True).sort_values("n_tokens", ascending=False, kind="stable")
        where, offset, capacity = pack(parts.n_tokens.tolist(), capacities)
        group = int(rows["group"].iloc[0])
        parts["bin_id"] = [f"{group}-{b}" for b in where]
        parts["bin_capacity"] = [capacity[b] for b in where]
        parts["bin_offset"] = offset
        return parts[["id", "part", "first_token", "n_tokens", "bin_id", "bin_capacity", "bin_offset"]]

    out = rows.groupBy("group").applyInPandas(run, f"id {kind}, part int, first_token bigint, n_tokens bigint, bin_id string, bin_capacity int, bin_offset int")
    return out.withColumnRenamed("id", id_col)
