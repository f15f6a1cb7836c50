"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The tree has one level for each entry of `levels` (say domain, language, source); its leaves hold documents. A budget of
tokens goes down the tree. Each node divides its budget among its children by their weights; a child that holds less
than its share (its tokens times max_epochs) takes what it has, and what it leaves goes to its siblings by weight before
anything goes back to the level above. All of it is integer arithmetic, so budgets add up exactly.

A leaf then reads its documents in epochs, each in an order of its own drawn from the seed, until its budget is used up:
whole epochs first, then the prefix of one more epoch, whose last document is cut at a token. That prefix is found
with sums over slices of the order, so no task ever holds a leaf.

Defined results: null levels form the node "?"; null and empty texts have no tokens and are never taken; texts of any length
are taken whole but for the last of a leaf; children whose needs are equal for their weights, and odd tokens, go by name,
a document's place in an epoch comes from its id and its text, so neither null or repeated ids nor the order of the input
matter, and copies of both go by the carried columns; weights not given are 1, a weight of 0 excludes; repeated rows count each; an
empty table gives an empty result; further columns
(whatever their names) are kept out unless `carry` names them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settled

#: Documents of one slice of a leaf's order, about.
SLICE = 250
#: Up to so many leaves, the table of budgets may be broadcast: under 200 bytes each.
FEW_LEAVES = 20_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def token_prefix(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def weight_of(path: Sequence[str], weights: Mapping[tuple, int], depth: int) -> Column:
    """The weight of the node that the first depth + 1 columns of `path` name; 1 unless given. `weights` is configuration."""
    known = [(k, v) for k, v in weights.items() if len(k) == depth + 1]
    out = F.lit(1)
    for k, v in known:
        # None in a path stands for any name
        out = F.when(_all(F.col(c) == F.lit(x) for c, x in zip(path, k) if x is not None), F.lit(int(v))).otherwise(out)
    return out.cast("long")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def share_out(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Add `granted`: the integer part of the column `budget` (of the parent) that each node gets.

    nodes: parents, name, weight, capacity, budget. Children in the order of capacity over weight are full up to some
    point; the others share what is left by weight, and single tokens left by rounding go one each to the first of them.
    """
    among = Window.partitionBy(*parents)
    by = among.orderBy(F.col("capacity") / F.col("weight"), name)
    up_to = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = lambda c: c.cast("decimal(19,0)")
    out = nodes.withColumn("before", F.sum("capacity").over(up_to) - F.col("capacity"))
    out = out.withColumn("left_weight", F.sum("weight").over(among) - F.sum("weight").over(up_to) + F.col("weight"))
    full = big(F.col("capacity")) * big(F.col("left_weight")) <= big(F.col("weight")) * big(F.col("budget") - F.col("before"))
    out = out.withColumn("full", full & (F.col("budget") >= F.col("before")))
    open_ = lambda c: F.when(~F.col("full"), c)
    out = out.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(among), F.lit(0)))
    out = out.withColumn("rest_weight", F.coalesce(F.sum(open_(F.col("weight"))).over(among), F.lit(1)))
    out = out.withColumn("part", open_(F.expr("(cast(weight as decimal(19,0)) * cast(rest as decimal(19,0))) div rest_weight")))
    out = out.withColumn("odd", F.col("rest") - F.coalesce(F.sum("part").over(among), F.lit(0)))
    out = out.withColumn("nth", F.sum(F.when(~F.col("full"), 1).otherwise(0)).over(up_to))
    granted = F.when(F.col("full"), F.col("capacity")).otherwise(F.col("part") + (F.col("nth") <= F.col("odd")).cast("long"))
    return out.withColumn("granted", granted).drop("before", "left_weight", "full", "rest", "rest_weight", "part", "odd", "nth")


def leaf_budgets(leaves: DataFrame, path: Sequence[str], weights: Mapping[tuple, int], total: int, max_epochs: int) -> DataFrame:
    """leaves: path, tokens (over 0). Adds `granted` to each."""
    for d in range(len(path)):
        leaves = leaves.withColumn(f"weight_{d}", weight_of(path, weights, d))
    leaves = leaves.filter(_all(F.col(f"weight_{d}") > 0 for d in range(len(path)))).withColumn("capacity", F.col("tokens") * F.lit(max_epochs))
    granted = None
    for d in range(len(path)):
        nodes = leaves.groupBy(*path[: d + 1]).agg(F.sum("capacity").alias("capacity"), F.first(f"weight_{d}").alias("weight"))
        nodes = nodes.withColumn("budget", F.lit(total)) if granted is None else nodes.join(granted.withColumnRenamed("granted", "budget"), list(path[:d]))
        granted = share_out(nodes, path[:d], path[d]).select(*path[: d + 1], "granted")
    return leaves.select(*path, "tokens").join(granted, list(path))


def mix_sources(docs: DataFrame, levels: Sequence[tuple[str, Column]], weights: Mapping[tuple, int], share: float = 0.8, total_tokens: int | None = None, max_epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """The documents taken: id, the levels, epoch (from 0), n_tokens, take_tokens (n_tokens, or less for the last one of
    a leaf), budget (of the leaf), and the columns that `carry` names, prefixed "carry_".

    total_tokens: the budget of the root; if None, `share` of all tokens. No more is given than the tree can take.
    """
    path = [f"level_{i}" for i in range(len(levels))]
    measured = docs.select(F.col(id_col).alias("id"), *[F.coalesce(e.cast("string"), F.lit("?")).alias(p) for p, (_, e) in zip(path, levels)], token_count(F.col(text_col)).alias("n_tokens"), F.md5(text_col).alias("digest"), *[F.col(c).alias(f"carry_{c}") for c in carry]).filter("n_tokens > 0")
    small = settled(measured.drop(*[f"carry_{c}" for c in carry]))
    leaves = settled(small.groupBy(*path).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    whole = leaves.agg(F.sum("tokens").alias("tokens"), F.max("docs").alias("docs"), F.count("*").alias("n")).first()
    has = whole["tokens"] or 0
    capacity = leaves
    for d in range(len(path)):
        capacity = capacity.filter(weight_of(path, weights, d) > 0)
    most = (capacity.agg(F.sum("tokens")).first()[0] or 0) * max_epochs
    total = min(int(has * share) if total_tokens is None else total_tokens, most)
    budgets = leaf_budgets(leaves, path, weights, total, max_epochs)
    budgets = settled(budgets.select(*path, F.col("granted").alias("budget"), F.expr("granted div tokens").alias("whole_epochs"), F.expr("granted % tokens").alias("rest")))

    few = (lambda d: F.broadcast(d)) if whole["n"] <= FEW_LEAVES else (lambda d: d)
    digits = max(1, math.ceil(math.log((whole["docs"] or 1) / SLICE + 1, 16)))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole_epochs").cast("string"), F.col("id").cast("string"), "digest"))
    ordered = lambda d: d.join(few(budgets), path).withColumn("order", order).withColumn("slice", F.substring("order", 1, digits))
    sums = ordered(small).groupBy(*path, "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    along = Window.partitionBy(*path).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("before", F.sum("slice_tokens").over(along) - F.col("slice_tokens")).drop("slice_tokens")
    inside = Window.partitionBy(*path, "slice").orderBy("order", *[f"carry_{c}" for c in carry if c != text_col]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = ordered(measured if carry else small).join(sums, [*path, "slice"])
    taken = taken.withColumn("ahead", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    last = F.greatest(F.least(F.col("rest") - F.col("ahead"), F.col("n_tokens")), F.lit(0))
    epochs = F.concat(
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("whole_epochs").cast("int") - 1, F.lit(0))), lambda e: F.struct(e.alias("epoch"), F.when(e < F.col("whole_epochs"), F.col("n_tokens")).otherwise(F.lit(0)).alias("take"))),
        F.array(F.struct(F.col("whole_epochs").cast("int").alias("epoch"), last.alias("take"))),
    )
    taken = taken.withColumn("e", F.explode(F.filter(epochs, lambda e: e["take"] > 0)))
    return taken.select(F.col("id").alias(id_col), *[F.col(p).alias(n) for p, (n, _) in zip(path, levels)], F.col("e.epoch").alias("epoch"), "n_tokens", F.col("e.take").alias("take_tokens"), "budget", *[f"carry_{c}" for c in carry])
