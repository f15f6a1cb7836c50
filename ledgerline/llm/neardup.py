"""Near-duplicate documents by a chosen-path similarity join.

A document's set are the distinct shingles of two words of its lower-cased text. Documents with equal sets form a class,
and only one of a class, its representative, goes on, in three steps:

1. Candidates. Independent trees branch the representatives by minwise tokens: the root of each by the token that is least
   under the tree's own hash, and every node of more than 2 * LEAF documents again by one or more tokens that the node chooses,
   1 / 0.8 of them on average. In small nodes all signatures are compared; only a star of the likely pairs leaves the
   node. What is connected is a candidate cluster, so every pair of similar documents that met in a node is in one cluster.
   A node that is still large at the last level holds alike documents and becomes part of one cluster as it is.
2. Small clusters are compared exhaustively on full sets, each in one task. No pair leaves the task, only who links
   with whom.
3. Larger clusters are branched again by chosen paths, deeper, down to nodes that one task can compare on full sets.
   Before that, blocks dealt by a salt and given the same pivots link what is very alike; nodes whose documents are all in
   one component by then are left out. What the last level leaves large is compared in blocks: documents outside the
   node's largest component with all of the node.

Nothing but nodes of bounded size is held in a task, and rows that move are in proportion to documents, but for the blocks
of the last resort. Recall: documents of similarity 0.8 part in all of 14 roots with a chance of 0.2 ** 14; a branching keeps
their expected number of common nodes at one for each tree. The signatures' estimate may be low by 3.5 standard deviations.

Components are found with alternating large-star and small-star steps in Spark.

Defined results: a document with a single word has one shingle, that word; null texts and texts without words have an
empty set and link with nothing; very long texts are sets like others; rows with equal ids and sets count as one document,
rows with one id and different texts are told apart and each gets its own component; a null id gets no component and isn't
kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, least_labels, mix, pieces, settled, utf8, whole_groups, words

COORDS, TREES = 64, 14
#: Documents that one node or block compares in a task, and bytes of their full sets there.
LEAF, LEAF_BYTES = 2048, 32 << 20
#: Levels below the roots: for candidates, and inside large clusters.
LEVELS, DEEP = 3, 10
PIVOTS = 8
_MULTIPLY = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_FLIP = mix(np.arange(1001, 1065, dtype=np.uint64))
_SECOND = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of a shingle's hash that the full sets hold: two documents' sets have no equal hashes by chance in 10**9 pairs.
SET_BYTES = 6


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within the text, and how many each has."""
    hashes, count = words(data, ends)
    out, sizes = [], np.zeros(len(count), np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    n = max(len(hashes) - width + 1, 0)
    joined = hashes[:n].copy()
    for i in range(1, width):
        joined = mix(joined * _SECOND + hashes[i : n + i])
    for d in range(len(count)):
        a, b = at[d], at[d + 1]
        if b - a >= width:
            own = np.sort(joined[a : b - width + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:  # the whole sequence as one
            whole = hashes[a : a + 1]
            for i in range(a + 1, b):
                whole = mix(whole * _SECOND + hashes[i : i + 1])
            own = mix(whole ^ _SECOND)
        else:
            continue
        sizes[d] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least hash under each of COORDS functions, for texts with a set."""
    starts = np.cumsum(sizes[sizes > 0]) - sizes[sizes > 0]
    out = np.empty((len(starts), COORDS), np.int32)
    for j in range(COORDS):
        least = np.minimum.reduceat((sets ^ _FLIP[j]) * _MULTIPLY[j], starts)
        out[:, j] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _named(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that name each text's set; zeros without one."""
    k1, k2, has = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(has):
        starts = np.cumsum(sizes[has]) - sizes[has]
        k1[has] = np.add.reduceat(mix(sets + np.uint64(1)), starts)
        k2[has] = np.add.reduceat(mix(sets ^ _SECOND), starts)
    return k1.view(np.int64), k2.view(np.int64)


def _features(rows: DataFrame, width: int) -> DataFrame:
    """rows: id, own, text. Gives id, own, n (size of the set), k1 and k2 (which name the set), path (the least hashes) and
    sig (a byte of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            sets, sizes = shingle_sets(*utf8(batch.column("text")), width)
            path = np.zeros((len(sizes), COORDS), np.int32)
            if len(sets):
                path[sizes > 0] = signatures(sets, sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * COORDS), pa.array(path.ravel()))
            sig = pa.array([r.tobytes() for r in path.view(np.uint8)[:, ::4]], pa.binary())
            k1, k2 = _named(sets, sizes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(sizes), pa.array(k1), pa.array(k2), lists, sig], ["id", "own", "n", "k1", "k2", "path", "sig"])

    own = rows.schema["own"].dataType.simpleString()
    return rows.mapInArrow(run, f"id bigint, own {own}, n bigint, k1 bigint, k2 bigint, path array<int>, sig binary")


def _full_sets(rows: DataFrame, width: int) -> DataFrame:
    """rows: least (an id), text. Gives least, n, k1, k2 and the whole set as sorted numbers of SET_BYTES bytes, in `set`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            sets, sizes = shingle_sets(*utf8(batch.column("text")), width)
            raw = (sets >> np.uint64(64 - 8 * SET_BYTES)).view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes)]) * SET_BYTES
            k1, k2 = _named(sets, sizes)
            own = pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("least"), pa.array(sizes), pa.array(k1), pa.array(k2), own], ["least", "n", "k1", "k2", "set"])

    return rows.mapInArrow(run, "least bigint, n bigint, k1 bigint, k2 bigint, set binary")


# ------------------------------------------------------------------------ trees


def _roots(reps: DataFrame, *also: str) -> DataFrame:
    """A row for each tree: node, id, path and further columns of the representatives."""
    tree = F.posexplode(F.slice("path", 1, TREES)).alias("tree", "token")
    return reps.select("id", "path", "n", *also, tree).select(F.xxhash64("tree", "token", *[c for c in also if c == "cluster"]).alias("node"), "id", "path", "n", *also)


def _branch(nodes: DataFrame, level: int) -> DataFrame:
    """The children of nodes: a node's own hash chooses one coordinate, or two for a quarter of them."""
    draw = F.xxhash64("node", F.lit(level))
    coord = lambda i: (F.lit(TREES + 1) + F.pmod(F.shiftright(draw, 8 * i), F.lit(COORDS - TREES))).cast("int")
    chosen = F.when(F.pmod(F.shiftright(draw, 40), F.lit(4)) == 0, F.array_distinct(F.array(coord(0), coord(1)))).otherwise(F.array(coord(0)))
    child = nodes.withColumn("c", F.explode(chosen))
    return child.withColumn("node", F.xxhash64("node", "c", F.element_at("path", F.col("c")))).drop("c")


def _grown(rows: DataFrame, levels: int, scratch: Scratch, leaf: int, of_components: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Leaves (rows of nodes that one task can compare) and what is still in larger nodes at the last level.

    With of_components, nodes whose rows are all in one component are left out.
    """
    leaves = []
    for level in range(levels + 1):
        sizes = [F.count("*").alias("docs"), F.sum(F.col("n") * SET_BYTES).alias("bytes")]
        is_large = f"docs > {leaf}"
        if of_components:
            counts = scratch.keep(rows.groupBy("node").agg(*sizes, (F.min("component") < F.max("component")).alias("mixed")).filter("mixed"))
            rows = scratch.keep(rows.join(counts.select("node"), "node", "left_semi"))
            is_large += f" or docs > 1 and bytes > {LEAF_BYTES}"
        else:
            counts = rows.groupBy("node").agg(*sizes)
        large = scratch.keep(counts.filter(is_large).select("node"))
        if large.isEmpty():
            leaves.append(rows)
            return reduce(DataFrame.union, leaves), None
        leaves.append(rows.join(large, "node", "left_anti"))
        big = rows.join(large, "node", "left_semi")
        if level < levels:
            rows = scratch.keep(_branch(big, level))
    return reduce(DataFrame.union, leaves), big


# ------------------------------------------------------- comparisons inside tasks


def _likely(sig: np.ndarray, n: np.ndarray, ends: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose sizes and signatures allow enough similarity."""
    fits = lambda i, j: 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    size = np.diff(ends)
    found = []
    small = np.repeat(np.where(size <= 32, size, 0), size)  # of small groups: row i with row i + k, for all at once
    place = np.arange(len(n)) - np.repeat(ends[:-1], size)
    for k in range(1, 32):
        i = np.flatnonzero(place + k < small)
        if not len(i):
            break
        i = i[fits(i, i + k)]
        i = i[(sig[i] == sig[i + k]).sum(1) >= least]
        found.append((i, i + k))
    for g in np.flatnonzero(size > 32):
        lo, hi = ends[g], ends[g + 1]
        across = np.ascontiguousarray(sig[lo:hi].T)
        for a in range(0, hi - lo, 256):
            b = min(a + 256, hi - lo)
            same = np.zeros((b - a, hi - lo - a), np.uint8)
            for row in across:
                same += row[a:b, None] == row[None, a:]
            i, j = np.nonzero(same >= least)
            i, j = i[j > i] + lo + a, j[j > i] + lo + a
            ok = fits(i, j)
            found.append((i[ok], j[ok]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _star(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each linked row with the least of those it is connected with, by place."""
    label = least_labels(len(ids), a, b)
    own = np.flatnonzero(label != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[label[own]])], ["a", "b"])


def _likely_links(leaves: DataFrame, percent: int) -> DataFrame:
    """Stars (a, b) of the likely pairs in each node. leaves: node, id, n, sig."""
    share = percent / 100
    least = int(COORDS * share - 3.5 * (COORDS * share * (1 - share)) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in whole_groups(batches, "node"):
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, COORDS)
            a, b = _likely(sig, table.column("n").to_numpy(), ends, max(least, 1), percent)
            ids = table.column("id").to_numpy()
            known, at = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
            yield _star(known, at[: len(a)], at[len(a) :])

    return leaves.repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "a bigint, b bigint")


def _numbers(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // SET_BYTES, 8), np.uint8)
    wide[:, :SET_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SET_BYTES)
    return wide.view(np.uint64).ravel()


def exact_links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j with 100 * intersection >= percent * union.

    Shingles that few sets share are counted one by one, those that many share by a product of 0/1 matrices.
    """
    n = np.array([len(x) for x in sets])
    if len(sets) == 2:
        common = np.array([len(np.intersect1d(sets[0], sets[1], assume_unique=True))])
        hit = (common > 0) & (100 * common >= percent * (n.sum() - common))
        return np.zeros(hit.sum(), np.int64), np.ones(hit.sum(), np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = often[column]
    few = max(8, len(n) // 12)
    common = np.zeros((len(n), len(n)))
    rare = np.flatnonzero((often > 1) & (often <= few))
    rare = rare[np.argsort(column[rare], kind="stable")]
    c, o = column[rare], owner[rare]
    for k in range(1, few):
        i = np.flatnonzero(c[k:] == c[:-k])
        if not len(i):
            break
        np.add.at(common, (o[i], o[i + k]), 1)
    many = np.flatnonzero(often > few)
    if len(many):
        used, c = np.unique(column[many], return_inverse=True)
        o = owner[many]
        order = np.argsort(c, kind="stable")
        c, o = c[order], o[order]
        for at in range(0, len(used), 4096):
            lo, hi = np.searchsorted(c, [at, at + 4096])
            x = np.zeros((len(n), min(4096, len(used) - at)), np.float32)
            x[o[lo:hi], c[lo:hi] - at] = 1
            common += x @ x.T
    i, j = np.nonzero(np.triu(100 * common >= percent * (n[:, None] + n[None] - common), 1) & (common > 0))
    return i, j


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """Stars (a, b) of the links in each group, on full sets. rows: node, id, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in whole_groups(batches, "node", 64):
            ids = table.column("id").to_numpy()
            for lo, hi in zip(ends, ends[1:]):
                if hi - lo > 1:
                    sets = [_numbers(raw) for raw in table.column("set").slice(lo, hi - lo).to_pylist()]
                    yield _star(ids[lo:hi], *exact_links(sets, percent))

    return rows.select("node", "id", "set").repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "a bigint, b bigint").filter("a <> b")


# -------------------------------------------------------------------- large clusters


def _salted(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of large clusters in blocks by a salt, each with its cluster's pivots: node, id, set. members: cluster, id, n."""
    size = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / (LEAF // 2)), F.ceil(F.sum("n") * SET_BYTES / (LEAF_BYTES // 2))).cast("int").alias("blocks"))
    order = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("id"), "id"))
    pivots = members.select("cluster", "id").withColumn("nth", order).filter(F.col("nth") <= PIVOTS).join(size, "cluster")
    everywhere = pivots.select("cluster", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = members.join(size, "cluster").select("cluster", "id", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).alias("block"))
    return dealt.union(everywhere).distinct().select(F.xxhash64("cluster", "block").alias("node"), "id").join(sets, "id")


def _blocks(stuck: DataFrame) -> DataFrame:
    """Of nodes that no branching made small: rows of blocks (node, id) in which every document outside the node's largest
    component meets every document of the node. stuck: node, id, n, component."""
    sizes = stuck.groupBy("node", "component").agg(F.count("*").alias("docs"))
    main = sizes.groupBy("node").agg(F.max_by("component", F.struct("docs", "component")).alias("main"))
    marked = stuck.join(main, "node").withColumn("outside", F.col("component") != F.col("main"))
    blocks = lambda of: F.greatest(F.ceil(F.count(of) / (LEAF // 2)), F.ceil(F.coalesce(F.sum(F.when(of.isNotNull(), F.col("n"))), F.lit(0)) * SET_BYTES / (LEAF_BYTES // 2)), F.lit(1)).cast("int")
    shape = marked.groupBy("node").agg(blocks(F.when(F.col("outside"), F.col("id"))).alias("down"), blocks(F.col("id")).alias("across"))
    spread = marked.join(shape, "node")
    row, column = F.pmod(F.xxhash64("id", F.lit(2)), F.col("down")), F.pmod(F.xxhash64("id", F.lit(3)), F.col("across"))
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asks = spread.filter("outside").select("node", "id", row.cast("int").alias("r"), every("across").alias("c"))
    meets = spread.select("node", "id", every("down").alias("r"), column.cast("int").alias("c"))
    return asks.union(meets).distinct().select(F.xxhash64("node", "r", "c").alias("node"), "id")


def _parts_of_large(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """id and component inside clusters that no task can compare whole, of ids with links. members: cluster, id, n, path; sets: id, set."""

    def linked(blocks: DataFrame, parts: DataFrame | None = None) -> DataFrame:
        """The components when the links of further blocks are added."""
        links = _linked(blocks, percent)
        return components(links.union(parts.select("id", "component")) if parts is not None else links, scratch)

    def placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
        return scratch.keep(rows.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")))

    parts = linked(_salted(members.select("cluster", "id", "n"), sets))
    rows = placed(members, parts)
    leaves, stuck = _grown(_roots(rows, "cluster", "component"), DEEP, scratch, LEAF, of_components=True)
    parts = linked(leaves.select("node", "id").join(sets, "id"), parts)
    if stuck is not None:
        parts = linked(_blocks(placed(stuck.select("node", "id", "n"), parts)).join(sets, "id"), parts)
    return parts


# --------------------------------------------------------------------- components


def _hooked(around: DataFrame, large: bool) -> DataFrame:
    """A star step, as links (a, b) with b < a: the neighbours v of u, the larger ones or u and the smaller ones, are linked
    with the least of u and v. Neighbours pass in order, and what repeats is left out."""
    along = Window.partitionBy("u").orderBy("v")
    least, before = F.first("v").over(along), F.lag("v").over(along)
    met = around.select("u", "v", F.least("u", least).alias("m"), before.alias("before")).filter("before IS NULL OR before < v")
    moved = met.filter("v > u").select(F.col("v").alias("a"), "m") if large else met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), "m")
    return moved.withColumnRenamed("m", "b")


def components(links: DataFrame, scratch: Scratch | None = None, most: int = 40) -> DataFrame:
    """id and component (the least id reachable) of every id in links (a, b): alternating large-star and small-star, each one
    shuffle, until every id has one least id and that has none itself."""
    with Scratch() as rounds:
        edges = links.filter("a <> b")
        for _ in range(most):
            ways = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
            edges = rounds.keep(_hooked(_hooked(edges.select(ways).select("e.*"), True).toDF("u", "v"), False))
            none = F.lit(None).cast("bigint")
            ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("up")), F.struct(F.col("b").alias("id"), none.alias("up")))).alias("e")).select("e.*")
            is_open = (F.count("up") > 0) & ((F.count("up") < F.count("*")) | (F.min("up") < F.max("up")))
            told = settled(ends.groupBy("id").agg(F.coalesce(F.min("up"), "id").alias("component"), is_open.alias("open")), scratch)
            if not told.agg(F.max("open")).first()[0]:
                return told.select("id", "component")
        raise RuntimeError("components did not settle")


def _grouped(rows: DataFrame, width: int, percent: int, leaf: int) -> DataFrame:
    """rows: id, own, text. Gives id, own, n and component (the least id of the group; null without an id or a set)."""
    with Scratch() as scratch:
        feats = scratch.keep(_features(rows, width))
        classes = feats.filter("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("least"), F.first("path").alias("path"), F.first("sig").alias("sig"))
        classes = scratch.keep(classes)
        shared = scratch.keep(classes.groupBy("least").count().filter("count > 1").select("least"))  # one id, several texts
        key = F.when(F.col("shared").isNotNull(), F.xxhash64("k1", "k2", "n")).otherwise(F.col("least"))
        reps = classes.join(shared.withColumn("shared", F.lit(1)), "least", "left").withColumn("id", key).drop("shared")

        leaves, stuck = _grown(_roots(reps, "sig"), LEVELS, scratch, 2 * leaf)
        likely = _likely_links(leaves.select("node", "id", "n", "sig"), percent)
        if stuck is not None:  # alike documents: one cluster, whatever their signatures say
            likely = likely.union(stuck.join(stuck.groupBy("node").agg(F.min("id").alias("b")), "node").select(F.col("id").alias("a"), "b"))
        clusters = components(likely, scratch).withColumnRenamed("component", "cluster")
        members = scratch.keep(reps.join(clusters, "id").select("id", "cluster", "n", "least", "k1", "k2", "path"))
        size = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum(F.col("n") * SET_BYTES).alias("bytes"))
        large = scratch.keep(size.filter(f"docs > {leaf} or bytes > {LEAF_BYTES}").select("cluster"))

        texts = rows.select(F.col("id").alias("least"), "text").join(members.select("least").distinct(), "least", "left_semi")
        once = F.row_number().over(Window.partitionBy("id").orderBy("least"))
        sets = _full_sets(texts, width).join(members.select("id", "least", "k1", "k2", "n"), ["least", "k1", "k2", "n"]).select("id", "least", "set")
        sets = scratch.keep(sets.withColumn("nth", once).filter("nth = 1").select("id", "set"))
        small = members.join(large, "cluster", "left_anti").select(F.col("cluster").alias("node"), "id")
        parts = _linked(small.join(sets, "id"), percent).select(F.col("a").alias("id"), F.col("b").alias("component"))  # a cluster in one task
        if not large.isEmpty():
            inside = scratch.keep(members.join(large, "cluster", "left_semi").select("cluster", "id", "n", "path"))
            parts = parts.union(_parts_of_large(inside, sets, percent, scratch))

        parts = scratch.keep(parts)
        named = reps.select("k1", "k2", "n", "id", "least").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
        # a component is named by the least id in it, not by a made key
        top = named.groupBy("component").agg(F.min("least").alias("top")).filter("component <> top")
        named = named.join(top, "component", "left").select("k1", "k2", "n", F.coalesce("top", "component").alias("component"))
        out = feats.select("id", "own", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
        return settled(out.select("id", "own", "n", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 80, leaf: int = LEAF) -> DataFrame:
    """doc id, n_shingles, component_id and kept of every row; ids have to be whole numbers."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.lit(0).alias("own"), F.col(text_col).alias("text"))
    out = _grouped(rows, width, percent, leaf)
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 80, leaf: int = LEAF) -> DataFrame:
    """The documents, with their columns: of each group one row, that of the least id (null comes last).

    Ids may be null or repeat: rows are told apart by a hash of their text, and rows with equal texts are copies, whatever
    their ids. Every row with an empty set (no words) stays. Only ids and hashes are grouped; texts are read again and
    filtered by what stays.
    """
    text = F.col(text_col)
    worded = F.coalesce(text.rlike(WORD), F.lit(False))
    hashed = F.xxhash64(text)
    told = _grouped(docs.filter(worded).select(hashed.alias("id"), F.col(id_col).alias("own"), text.alias("text")), width, percent, leaf)
    first = F.struct(F.col("own").isNull(), "own", "id")
    stays = told.groupBy("component").agg(F.min(first).alias("s")).select("component", F.col("s.own").alias("own"), F.col("s.id").alias("id"))
    rows = told.groupBy("component", "own", "id").agg(F.count("*").alias("times"))
    same = [rows["component"] == stays["component"], rows["own"].eqNullSafe(stays["own"]), rows["id"] == stays["id"]]
    stays = settled(rows.join(stays, same).select(rows["id"].alias("k"), rows["own"].alias("own"), "times"))

    named = docs.filter(worded).select(hashed.alias("k"), F.col(id_col).alias("own"), F.struct("*").alias("row"))
    met = lambda of: named.join(of, (named["k"] == of["k"]) & named["own"].eqNullSafe(of["own"])).select(named["k"], named["own"], "row")
    once = met(stays.filter("times = 1")).select("row.*")
    nth = F.row_number().over(Window.partitionBy("k", "own").orderBy(F.lit(0)))
    repeated = met(stays.filter("times > 1")).withColumn("nth", nth).filter("nth = 1").select("row.*")
    return once.unionByName(repeated).unionByName(docs.filter(~worded))
