"""Exact k best inner products by a Voronoi join.

1. Pivots are a number of different data vectors in proportion to sqrt(n), within a bound. Queries and data are grouped by
   their nearest pivot.
2. Summaries: each cell's data vectors nearest to its pivot, a bounded number. Every query scores all of these; its k-th best
   score there is the least that can still matter for it. A query cell keeps its least such score and its reach, the
   greatest distance of one of its queries from the pivot.
3. For a query q of the cell with pivot p and a data vector s, q.s = p.s + (q - p).s <= p.s + reach |s|. A data vector is sent
   to a query cell only if this is not below the cell's least score, so nothing that could matter is left out.
4. Query cells that need nearly the same data are put together in groups of bounded size. Each group meets its data in parts
   of bounded size, as many as its own data fill, and keeps its queries' k best; these are merged by rank.

Where cells reach as far as vectors are long (unclustered vectors of many dimensions) nothing can be left out; then all queries
of a block meet all data, a block at a time.

Defined results: a vector takes part if it and all its components are finite and present and its id isn't null; shorter
vectors count as padded with zeros, vectors without components too; rows that share a query's id are not its candidates; a
query id that occurs in several rows asks once, with its least vector; equal scores go to the smaller id. Fewer than k
candidates give fewer rows, an empty table none. A score among the best that leaves 64 bits is an error. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Doubles hold every integer up to this one.
EXACT = float(1 << 53)
MOST_PIVOTS, SUMMARY = 256, 8
#: Rounding of scores and distances is far below this share of the sizes that they are made of.
SLACK = 1e-9


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (array<double>: floor(scale * component), whole numbers) of the rows that take part."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == math.inf))
    usable = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(~bad)

    def whole(c: Column) -> Column:
        y = c.cast("double") * scale
        return F.when(F.abs(y) < EXACT, F.floor(F.when(F.abs(y) < EXACT, y)).cast("double")).otherwise(y)

    return usable.select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(float)


def _padded(lists: list, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _assigned(rows: DataFrame, pivots: np.ndarray, dim: int, kind: str) -> DataFrame:
    """rows: id, v, is_query. Gives id, v (bytes), is_query, cell and dist, the distance to its pivot."""
    length = (pivots**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _padded(part.column("v").to_pylist(), dim)
                cell = (length[None] - 2 * (x @ pivots.T)).argmin(1)
                dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                raw = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), raw, part.column("is_query"), pa.array(cell.astype(np.int32)), pa.array(dist)], ["id", "v", "is_query", "cell", "dist"])

    return rows.mapInArrow(run, "id bigint, v binary, is_query boolean, cell int, dist double")


def _with_least(queries: DataFrame, ids: np.ndarray, summary: np.ndarray, k: int, dim: int, kind: str) -> DataFrame:
    """queries with `least`: the k-th best score among the summary's rows of other ids, less what rounding may do."""
    longest = float(np.sqrt((summary**2).sum(1)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                q = _matrix(part.column("v"), dim, kind)
                score = q @ summary.T
                score[part.column("id").to_numpy()[:, None] == ids[None]] = -np.inf
                best = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
                least = best - SLACK * longest * np.sqrt((q**2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least)], [*part.schema.names, "least"])

    return queries.mapInArrow(run, "id bigint, v binary, cell int, dist double, least double")


def _needs(x: np.ndarray, points: np.ndarray, reach: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which data vectors (rows) could be among the best of a query in which query cells (columns)."""
    size = np.sqrt((x**2).sum(1))[:, None]
    most = x @ points.T + reach[None] * size
    return most + SLACK * size * (np.sqrt((points**2).sum(1)) + reach)[None] >= least[None]


def _groups(cells: list[int], asks: dict[int, int], need: np.ndarray, sizes: np.ndarray, between: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """Query cells (numbers of the rows of `need`) in groups, and into how many blocks of queries each is dealt.

    A near cell joins a group if there is room for its queries and that sends fewer data: need[c, d] vectors of data cell d
    may matter for query cell c, and together they are no more than the cell holds.
    """
    left, out = set(range(len(cells))), []
    while left:
        c = max(left, key=lambda i: (asks[cells[i]], -i))
        left.discard(c)
        group, n, wanted = [c], asks[cells[c]], need[c].astype(float)
        for o in sorted(left, key=lambda i: (between[c, i], i)):
            both = np.minimum(wanted + need[o], sizes)
            if n + asks[cells[o]] <= most and both.sum() <= 0.75 * (wanted.sum() + need[o].sum()):
                left.discard(o)
                group.append(o)
                n, wanted = n + asks[cells[o]], both
        out.append((group, -(-n // most)))
    return out


def _best(q_ids: np.ndarray, q: np.ndarray, s_ids: np.ndarray, s: np.ndarray, k: int, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of s for each q, ties to the smaller id, never one with the query's id. top: the greatest square length."""
    order = np.argsort(s_ids, kind="stable")
    s_ids, s = s_ids[order], s[order]
    st = s.T
    unsure = 0.0 if top < EXACT else 8 * s.shape[1] * 2.0**-53  # a share of the lengths' product: what doubles may be off by
    s_size = np.sqrt((s**2).sum(1))
    got = []
    for a in range(0, len(q), 128):
        x = q[a : a + 128]
        score = x @ st
        score[q_ids[a : a + 128, None] == s_ids[None]] = -np.inf
        n = min(k, score.shape[1])
        off = unsure * np.sqrt((x**2).sum(1))[:, None] * s_size[None]
        least = np.partition(score - off, -n, axis=1)[:, -n]
        i, j = np.nonzero((score + off >= least[:, None]) & (score > -np.inf))
        if unsure:
            exact = [sum(int(u) * int(v) for u, v in zip(x[b], s[c])) for b, c in zip(i, j)]
            ranked = sorted(range(len(i)), key=lambda r: (i[r], -exact[r], s_ids[j[r]]))
            i, j, found = i[ranked], j[ranked], [exact[r] for r in ranked]
        else:
            found = score[i, j]
            ranked = np.lexsort((s_ids[j], -found, i))
            i, j, found = i[ranked], j[ranked], found[ranked]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        found = [f for f, keep in zip(found, first) if keep] if unsure else found[first].astype(np.int64)
        if unsure and any(not -(1 << 63) <= f < 1 << 63 for f in found):
            raise OverflowError("a score among the best leaves 64 bits")
        got.append((q_ids[a + i[first]], s_ids[j[first]], np.array(found, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3


class Plan:
    """What is sent where: the integer vectors of data and queries with their cells, and groups of query cells."""

    data: DataFrame  # id, v, is_query, cell, dist
    queries: DataFrame  # id, v, cell, dist, least
    groups: list[tuple[list[int], int]]
    sent: list[int]  # how many data vectors each group is sent at most
    n: int


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int | None = None, queries_per_block: int = 2048, data_per_part: int = 16384, seen: Plan | None = None) -> DataFrame:
    """query_id, rank (from 1), the candidate's id in id_col, and score, for each row where is_query holds.

    pivots: how many, sqrt(n) / 2 within 16 and MOST_PIVOTS if not given. seen: filled with what was decided.
    """
    asks = F.coalesce(is_query, F.lit(False))
    rows = settled(integers(vectors, id_col, vector_col, scale).withColumnRenamed("id", id_col).withColumn("is_query", asks).withColumnRenamed(id_col, "id"))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    largest = F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c)))
    whole = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("top"), F.max(largest).alias("most")).first()
    if not whole["n"] or not whole["dim"]:
        return _without_vectors(rows, k, id_col)
    dim, top, n = whole["dim"], whole["top"], whole["n"]
    if top == math.inf:
        raise OverflowError("vectors too long for 64-bit scores")
    kind = "<i2" if whole["most"] < 1 << 15 else "<i4" if whole["most"] < 1 << 31 else "<f8"
    wanted = pivots or min(MOST_PIVOTS, max(16, math.isqrt(n) // 2))
    chosen = rows.orderBy(F.xxhash64("id"), "v").limit(wanted).collect()  # bounded: MOST_PIVOTS or the parameter
    points = np.unique(_padded([r["v"] for r in chosen], dim), axis=0)
    once = Window.partitionBy("id").orderBy("v")
    asked_once = rows.filter("is_query").withColumn("nth", F.row_number().over(once)).filter("nth = 1").select("id", "v", "is_query")
    data = settled(_assigned(rows, points, dim, kind))
    near = Window.partitionBy("cell").orderBy("dist", "id")
    close = data.select("cell", "dist", "id", "v").withColumn("nth", F.row_number().over(near)).filter(F.col("nth") <= max(SUMMARY, k + 1)).collect()  # pivots * SUMMARY
    ids, summary = np.array([r["id"] for r in close]), np.stack([np.frombuffer(r["v"], kind).astype(float) for r in close])
    queries = settled(_with_least(_assigned(asked_once, points, dim, kind).drop("is_query"), ids, summary, k, dim, kind))
    cells = queries.groupBy("cell").agg(F.max("dist").alias("reach"), F.min("least").alias("least"), F.count("*").alias("n")).orderBy("cell").collect()  # pivots
    used = [r["cell"] for r in cells]
    at, reach, least = points[used], np.array([r["reach"] for r in cells]), np.array([r["least"] for r in cells])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros((len(used), len(points)), np.int64), np.zeros(len(points), np.int64)
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            size += np.bincount(cell, minlength=len(points))
            for a in range(0, batch.num_rows, 2048):
                d, c = np.nonzero(_needs(_matrix(batch.column("v").slice(a, 2048), dim, kind), at, reach, least))
                total += np.bincount(c * len(points) + cell[a + d], minlength=total.size).reshape(total.shape)
        both = np.vstack([total, size[None]])
        c, d = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(both[c, d])], ["c", "d", "n"])

    need, sizes = np.zeros((len(used), len(points)), np.int64), np.zeros(len(points), np.int64)
    if used:
        for r in data.select("v", "cell").mapInArrow(counted, "c bigint, d bigint, n bigint").groupBy("c", "d").agg(F.sum("n").alias("n")).collect():  # pivots ** 2
            if r["c"] == len(used):
                sizes[r["d"]] = r["n"]
            else:
                need[r["c"], r["d"]] = r["n"]
    between = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)) if used else np.zeros((0, 0))
    groups = _groups(used, {r["cell"]: r["n"] for r in cells}, need, sizes, between, queries_per_block)
    sent = [int(np.minimum(need[members].sum(0), sizes).sum()) for members, _ in groups]
    parts = [max(1, math.ceil(x / data_per_part)) for x in sent]
    if seen is not None:
        seen.data, seen.queries, seen.groups, seen.sent, seen.n = data, queries, groups, sent, n

    of_cell = {used[c]: g for g, (members, _) in enumerate(groups) for c in members}
    look = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values or [0]]), i + 1)
    asked = queries.withColumn("group", look([of_cell.get(c, 0) for c in range(len(points))], F.col("cell")))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), look([b for _, b in groups], F.col("group"))).cast("int"))
    asked = asked.select("id", "v", "group", "block", F.explode(F.sequence(F.lit(0), look(parts, F.col("group")) - 1)).alias("part"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                some = batch.slice(a, 2048)
                wants = _needs(_matrix(some.column("v"), dim, kind), at, reach, least)
                salt = some.column("salt").to_numpy() + np.arange(a, a + some.num_rows)  # repeated rows part, too
                for g, (members, blocks) in enumerate(groups):
                    hit = np.flatnonzero(wants[:, members].any(1))
                    for b in range(blocks if len(hit) else 0):
                        out = some.select(["id", "v"]).take(pa.array(hit))
                        yield pa.RecordBatch.from_arrays([*out.columns, pa.array((salt[hit] % parts[g]).astype(np.int32)), pa.array(np.full(len(hit), g, np.int32)), pa.array(np.full(len(hit), b, np.int32))], ["id", "v", "part", "group", "block"])

    salted = data.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)).alias("salt"))
    spread = salted.mapInArrow(needed, "id bigint, v binary, part int, group int, block int")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        q, s = left.combine_chunks(), right.combine_chunks()
        of = lambda t: (t.column("id").to_numpy(), _matrix(t.column("v"), dim, kind))
        a, b, c = _best(*of(q), *of(s), k, top) if q.num_rows and s.num_rows else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": a, "id": b, "score": c})

    keys = ["group", "block", "part"]
    local = asked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(solve, "query_id bigint, id bigint, score bigint")
    return _ranked(local, k, id_col)


def _ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _without_vectors(rows: DataFrame, k: int, id_col: str) -> DataFrame:
    """No vector has a component: every score is 0, and the smallest other ids win."""
    first = rows.groupBy("id").count().orderBy("id").limit(k + 1)
    asked = rows.filter("is_query").select(F.col("id").alias("query_id")).distinct()
    ids = [r["id"] for r in first.collect() for _ in range(min(r["count"], k))]
    pairs = asked.withColumn("id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in ids]) if ids else F.array().cast("array<bigint>")))
    return _ranked(pairs.filter("id <> query_id").withColumn("score", F.lit(0).cast("bigint")), k, id_col)
