"""A trie of the beginnings that conversations share, by distributed MSD radix partitioning over dictionary-encoded turns.

Turns (role, text) get ids from a dictionary; only ids, and how many code points each text has, travel on. Rows of a
conversation are numbered by a sorted range partitioning, so one conversation may hold any part of all rows. Conversations
that say the same are told by 128 bits over their ids and places, and become one weighted sequence, so copies
cost nothing further down.

The root's bucket holds all sequences. A bucket is dealt out by the next turn's id; each id makes a node and the node's
bucket. Counts are aggregated before anything is labelled, so a bucket with most of the sequences is dealt out by
all tasks. Buckets of up to MOST rows are local: one task finishes each by multikey quicksort, whose recursion emits the
nodes below. A larger bucket of one sequence is a chain of nodes and needs no sorting; other larger ones go another round,
so there are as many rounds as different conversations with more than MOST turns between them go on together.
Sums over subtrees come from below: from local buckets and chains, then up the rounds.

A node is known by its depth and its smallest conversation. Which conversations end at it is told by a digest over their
ids in order; the ids stream through one task for each sequence, joined into pieces before, since SHA-256 reads in order.

Defined results: rows without a conversation id belong to none; null roles and texts are empty; null turns come first, and
turns of one number go by the digest of role and text; repeated rows are turns of their own; texts are read whole; an
empty table has no nodes, not even a root; further columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, settled, whole_groups

#: Buckets of up to so many rows (turns of different conversations) are finished by one task.
MOST = 4096
#: So many conversation ids are joined before they go to the task that digests them.
PIECE = 4096


# ------------------------------------------------------- ids and numbering


def encoded(turns: DataFrame, scratch: Scratch, conv_id: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, nth, turn (an id, in the order of digests), chars: one row for each row with a conversation id."""
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256))
    rows = turns.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("bigint").alias("conv"), F.col(order).alias("nth"), digest.alias("digest"), F.length(said).cast("bigint").alias("chars"))
    dictionary = scratch.keep(rows.select("digest").distinct().repartitionByRange("digest").sortWithinPartitions("digest").withColumn("turn", F.monotonically_increasing_id()))
    return scratch.keep(rows.join(dictionary, "digest").select("conv", "nth", "turn", "chars"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers rows sorted by conv, from 0 for each conv in this partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv").to_numpy()
        first = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
        at = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
        if last == conv[0]:
            at[: first[1] if len(first) > 1 else len(at)] += seen
        last, seen = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(at), batch.column("turn"), batch.column("chars"), pa.array(np.full(len(conv), part, np.int32))], names=["conv", "at", "turn", "chars", "part"])


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, pos, turn, chars: the rows of a kept table, numbered from 0 within each conv by nth, then turn.

    Rows are dealt by ranges, which may cut through a conv. What of a conv stands in partitions before is added from a table
    of at most one row for each partition.
    """
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("conv", "nth", "turn", "row").sortWithinPartitions("conv", "nth", "turn", "row").select("conv", "turn", "chars")
    placed = scratch.keep(dealt.mapInArrow(_places, "conv bigint, at bigint, turn bigint, chars bigint, part int"))
    before, last, seen = [], None, 0
    for part in placed.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "at")).alias("last")).orderBy("part").collect():
        ahead = seen if part["first"] == last else 0
        if ahead:
            before.append((part["part"], part["first"], ahead))
        if part["last"]["conv"] != part["first"]:
            ahead = 0
        last, seen = part["last"]["conv"], ahead + part["last"]["at"] + 1
    ahead = rows.sparkSession.createDataFrame(before, "part int, conv bigint, ahead bigint")
    return placed.join(F.broadcast(ahead), ["part", "conv"], "left").select("conv", (F.col("at") + F.coalesce("ahead", F.lit(0))).alias("pos"), "turn", "chars")


def with_heads(rows: DataFrame, scratch: Scratch, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one: (conv, pos, turn, chars) and (conv, len) of all.

    Of conversation `base` the first `heads` turns (`most` at most; both columns over conv) come first, then the conversation's own after its
    first `heads`. A base that does not exist has no turns.
    """
    rows = scratch.keep(rows)
    first = rows.filter(F.col("pos") < most).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "chars"))).alias("head"))
    convs = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).select("conv", "own", base.alias("base"), heads.alias("heads"))
    first = first.select(F.col("conv").alias("base"), "head")
    head = F.slice("head", F.lit(1), F.col("heads"))
    convs = scratch.keep(convs.join(first, "base", "left").select("conv", "own", "heads", F.coalesce(head, F.array().cast("array<struct<pos:bigint,turn:bigint,chars:bigint>>")).alias("head")))
    moved = F.size("head").cast("bigint")
    shared = convs.select("conv", F.inline("head")).select("conv", "pos", "turn", "chars")
    own = rows.join(convs.select("conv", "heads", moved.alias("moved")), "conv").filter(F.col("pos") >= F.col("heads")).select("conv", (F.col("pos") - F.col("heads") + F.col("moved")).alias("pos"), "turn", "chars")
    return scratch.keep(shared.unionByName(own)), convs.select("conv", (moved + F.greatest(F.col("own") - F.col("heads"), F.lit(0))).alias("len"))


# ------------------------------------------------------- inside tasks


_NODES = "conv bigint, depth bigint, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, end_seq bigint, top boolean"


def sorted_nodes(turns: list[list[int]], chars: list[list[int]], names: list[int], weights: list[int]) -> list[list]:
    """Multikey quicksort of different sequences; each part that is equal at a place is a node, told when it is found.

    Returns for each node: the number of the node above (-1: none), depth from 1, least name, weight, code points of its last turn, the
    name of the sequence that ends there or None. Nodes come after those above them.
    """
    nodes: list[list] = []
    stack = [(list(range(len(turns))), 0, -1)]
    while stack:
        part, d, above = stack.pop()
        if len(part) == 1:  # nothing left to tell apart
            (i,) = part
            if d == len(turns[i]) and above >= 0:
                nodes[above][5] = names[i]
            for k in range(d, len(turns[i])):
                nodes.append([above, k + 1, names[i], weights[i], chars[i][k], names[i] if k + 1 == len(turns[i]) else None])
                above = len(nodes) - 1
            continue
        at = lambda i: turns[i][d] if d < len(turns[i]) else -1  # noqa: B023, E731
        pivot = at(part[len(part) // 2])
        less, same, more = [], [], []
        for i in part:
            (same if at(i) == pivot else less if at(i) < pivot else more).append(i)
        stack += [(x, d, above) for x in (less, more) if x]
        if pivot < 0:  # sequences differ, so one ends here
            nodes[above][5] = names[same[0]]
        else:
            nodes.append([above, d + 1, min(names[i] for i in same), sum(weights[i] for i in same), chars[same[0]][d], None])
            stack.append((same, d + 1, len(nodes) - 1))
    return nodes


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node, seq, pos: the nodes of each bucket, from the bucket's own on."""
    for table, ends in whole_groups(batches, "node"):
        col = {c: table.column(c).to_numpy() for c in ("seq", "turn", "chars", "weight", "depth", "node")}
        parent = table.column("parent").to_pylist()
        out: list[list] = [[] for _ in range(9)]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            seq = col["seq"][a:b]
            cuts = [0, *(np.flatnonzero(seq[1:] != seq[:-1]) + 1).tolist(), b - a]
            split = lambda c: [col[c][a + x : a + y].tolist() for x, y in zip(cuts, cuts[1:])]  # noqa: B023, E731
            nodes = sorted_nodes(split("turn"), split("chars"), [int(seq[x]) for x in cuts[:-1]], [int(col["weight"][a + x]) for x in cuts[:-1]])
            children, leaves = [0] * len(nodes), [0] * len(nodes)
            saved = [(n - 1) * said for _, _, _, n, said, _ in nodes]
            for i in range(len(nodes) - 1, -1, -1):
                leaves[i] = leaves[i] or 1
                if (above := nodes[i][0]) >= 0:
                    children[above] += 1
                    leaves[above] += leaves[i]
                    saved[above] += saved[i]
            base = int(col["depth"][a]) - 1
            for i, (above, depth, conv, n, _, end) in enumerate(nodes):
                for column, value in zip(out, (conv, base + depth, parent[a] if above < 0 else nodes[above][2], n, children[i], leaves[i], saved[i], end, above < 0)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.bool_() if i == 8 else pa.int64()) for i, x in enumerate(out)], names=["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "end_seq", "top"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seq, conv: pieces of comma-joined ids of one seq, with the first id of each."""
    for batch in batches:
        seq, conv = batch.column("seq").to_numpy(), batch.column("conv").to_numpy()
        cuts = sorted({0, len(seq), *range(0, len(seq), PIECE), *(np.flatnonzero(seq[1:] != seq[:-1]) + 1).tolist()})
        spans = list(zip(cuts, cuts[1:]))
        yield pa.RecordBatch.from_arrays([pa.array([int(seq[a]) for a, _ in spans], pa.int64()), pa.array([int(conv[a]) for a, _ in spans], pa.int64()), pa.array([",".join(map(str, conv[a:b].tolist())) for a, b in spans], pa.string())], names=["seq", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by seq, first: one digest for each seq, read piece by piece."""
    at, digest = None, None
    one = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["end_seq", "sha"])
    for batch in batches:
        for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
            if seq == at:
                digest.update(b",")
            else:
                if at is not None:
                    yield one()
                at, digest = seq, hashlib.sha256()
            digest.update(ids.encode())
    if at is not None:
        yield one()


# ------------------------------------------------------------------ results


def _ends(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """end_seq, sha: the digest over the conversations of each sequence."""
    alone = sequences.filter("weight = 1").select(F.col("seq").alias("end_seq"), F.sha2(F.col("seq").cast("string"), 256).alias("sha"))
    rows = members.join(sequences.filter("weight > 1").select("seq"), "seq").select("seq", "conv")
    pieces = rows.repartitionByRange("seq", "conv").sortWithinPartitions("seq", "conv").mapInArrow(_joined, "seq bigint, first bigint, ids string")
    return alone.unionByName(pieces.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_digested, "end_seq bigint, sha string"))


def _chains(rows: DataFrame) -> DataFrame:
    """The nodes of buckets of a single sequence: one for each of its rows from the bucket's depth on."""
    piece = F.floor(F.col("pos") / PIECE)
    later = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    rows = rows.withColumn("piece", piece)
    sums = rows.groupBy("seq", "piece").agg(F.sum("chars").alias("total")).select("seq", "piece", F.expr(f"sum(total) OVER (PARTITION BY seq ORDER BY piece {later}) - total").alias("behind"))
    summed = rows.join(sums, ["seq", "piece"]).withColumn("rest", F.col("behind") + F.expr(f"sum(chars) OVER (PARTITION BY seq, piece ORDER BY pos {later})"))
    depth, top = F.col("pos") + 1, F.col("pos") + 1 == F.col("depth")
    return summed.select(
        F.col("seq").alias("conv"), depth.alias("depth"), F.when(top, F.col("parent")).otherwise(F.col("seq")).alias("parent"), F.col("weight").alias("n_convs"), F.when(depth < F.col("len"), 1).otherwise(0).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"), ((F.col("weight") - 1) * F.col("rest")).alias("saved"), F.when(depth == F.col("len"), F.col("seq")).alias("end_seq"), top.alias("top"))


def trie_nodes(rows: DataFrame, convs: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """The nodes of kept tables rows (conv, pos from 0 without gaps, turn, chars) and convs (conv, len), which has the turnless, too.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    code = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "turn"))
    same = ["len", "x", "y"]
    told = scratch.keep(convs.join(rows.groupBy("conv").agg(code(1).alias("x"), code(2).alias("y")), "conv", "left").select("conv", "len", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y")))
    grouped = scratch.keep(told.groupBy(*same).agg(F.min("conv").alias("seq"), F.count(F.lit(1)).alias("weight")))
    members, sequences = told.join(grouped, same).select("conv", "seq"), grouped.select("seq", "weight", "len")
    texts = scratch.keep(rows.join(sequences, rows["conv"] == sequences["seq"]).select("seq", "pos", "turn", "chars", "weight", "len"))
    root = grouped.agg(F.min("seq").alias("conv"), F.sum("weight").alias("n_convs"), F.min(F.when(F.col("len") == 0, F.col("seq"))).alias("end_seq")).filter("conv IS NOT NULL")
    least = root.first()
    if least is None:
        return rows.sparkSession.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")

    levels: list[DataFrame] = []  # of depth 1, 2, ...: the nodes that dealing out has made
    ready: list[DataFrame] = []
    here = texts.filter(F.col("pos") == 0).withColumn("bucket", F.lit(least["conv"]))
    while True:
        depth = len(levels) + 1
        nodes = scratch.keep(here.groupBy("bucket", "turn").agg(
            F.min("seq").alias("node"), F.sum("weight").alias("n_convs"), F.max("chars").alias("chars"), F.min(F.when(F.col("len") == depth, F.col("seq"))).alias("end_seq"),
            F.sum(F.col("len") - (depth - 1)).alias("size"), F.count(F.lit(1)).alias("seqs")))
        nodes = nodes.withColumn("kind", F.when(F.col("size") <= most, "local").when(F.col("seqs") == 1, "chain").otherwise("open"))
        labelled = here.select("seq", "bucket", "turn").join(nodes.select("bucket", "turn", "node", "kind"), ["bucket", "turn"])
        levels.append(nodes)
        if nodes.filter("kind = 'open'").isEmpty():
            ready.append(labelled.select("seq", "node", "kind", F.col("bucket").alias("parent"), F.lit(depth).cast("bigint").alias("depth")))
            break
        labelled = scratch.keep(labelled)
        ready.append(labelled.filter("kind <> 'open'").select("seq", "node", "kind", F.col("bucket").alias("parent"), F.lit(depth).cast("bigint").alias("depth")))
        here = texts.filter(F.col("pos") == depth).join(labelled.filter("kind = 'open'").select("seq", F.col("node").alias("bucket")), "seq")

    placed = ready[0]
    for more in ready[1:]:
        placed = placed.unionByName(more)
    below = texts.join(placed, "seq").filter(F.col("pos") >= F.col("depth") - 1)
    local = below.filter("kind = 'local'").repartition("node").sortWithinPartitions("node", "seq", "pos").mapInArrow(_local, _NODES)
    done = scratch.keep(local.unionByName(_chains(below.filter("kind = 'chain'"))))

    # up the rounds: what the children of a node sum up to
    upper: list[DataFrame] = []
    sums = [F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")]
    beneath = None
    for depth in range(len(levels), -1, -1):
        finished = done.filter(F.col("top") & (F.col("depth") == depth)).select("parent", "n_leaves", "saved")
        if depth and beneath is not None:
            opened = levels[depth - 1].filter("kind = 'open'").join(beneath.groupBy("parent").agg(*sums).withColumnRenamed("parent", "node"), "node")
            opened = opened.select(F.col("node").alias("conv"), F.lit(depth).cast("bigint").alias("depth"), F.col("bucket").alias("parent"), "n_convs", "n_children", "n_leaves", (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"), "end_seq")
            upper.append(scratch.keep(opened))
            finished = finished.unionByName(upper[-1].select("parent", "n_leaves", "saved"))
        if depth:
            beneath = finished
    top = beneath.agg(*sums).select("n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    top = top.select(*[F.lit(least[c]).cast("bigint").alias(c) for c in ("conv", "n_convs", "end_seq")], F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent"), "*")
    nodes = done.drop("top").unionByName(top)
    for more in upper:
        nodes = nodes.unionByName(more)
    ended = nodes.join(_ends(members, sequences), "end_seq", "left")
    return ended.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, base: Column | None = None, heads: Column | None = None, most_heads: int = 0, most: int = MOST, conv_id: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of all conversations as they are or, with base and heads (columns over conv), as with_heads rebuilds them."""
    with Scratch() as scratch:
        rows = numbered(encoded(turns, scratch, conv_id, order, role, text), scratch)
        if base is None or heads is None:
            base, heads, most_heads = F.col("conv"), F.lit(0), 0
        rows, convs = with_heads(rows, scratch, base, heads, most_heads)
        return settled(trie_nodes(rows, convs, scratch, most))
