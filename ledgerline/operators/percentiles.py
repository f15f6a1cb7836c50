"""Exact percentiles of all groups of a table at once, however many groups there are and however large one is."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import every
from ..session import q, require

#: Groups of more values than this are narrowed by a sketch before any are put in order; SALTS tasks share the rows of one.
LARGE, SALTS = 1_000_000, 64
#: How far on either side of a share the range is taken, above the sketch's error of 1 in ACCURACY.
MARGIN, ACCURACY = 3e-4, 10_000


def _places(share: float, n: Column) -> tuple[Column, Column]:
    """The two ranks (from 0) between which the percentile of n values lies."""
    at = F.lit(share) * (n - 1)
    return F.floor(at), F.ceil(at)


def _met(rows: DataFrame, bounds: DataFrame, ks: Sequence[str]) -> DataFrame:
    """Each row with the bounds of its group, if that has any; the rows of one group are dealt out by a salt."""
    salted = bounds.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = salted.select(*[F.col(k).alias(f"o{k}") for k in [*ks, "s"]], F.struct(*[c for c in bounds.columns if c not in ks]).alias("b"))
    same = every([F.col(k).eqNullSafe(F.col(f"o{k}")) for k in ks] + [F.col("s") == F.col("os")])
    return rows.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, same, "left").drop("s", *[f"o{k}" for k in [*ks, "s"]])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float], large: int = LARGE, count_as: str | None = None) -> DataFrame:
    """For each group: keys, how many values aren't null (if `count_as` names a column) and each wanted percentile,
    interpolated between neighbours.

    wanted: column name to share (0 to 1). Null is a key; a group without values gets nulls; NaN counts as the largest number.
    Without keys the whole table is one group. Values are counted before they are put in order. In a group of more than
    `large` values only those around each percentile are: sketches say where, and the exact number of values below is
    counted. Should a sketch miss, the group's values are all put in order, so results are exact either way.
    """
    require(df, [*keys, value], "the table")
    if odd := [s for s in wanted.values() if not 0 <= s <= 1]:
        raise ValueError(f"a share lies between 0 and 1, not {odd[0]}")
    ks, shares = [f"k{i}" for i in range(len(keys))], list(wanted.values())
    rows = df.select(*[F.col(q(c)).alias(k) for c, k in zip(keys, ks)], F.col(q(value)).cast("double").alias("v"))
    ends = F.array(*[F.lit(e) for s in shares for e in (max(s - MARGIN, 0.0), min(s + MARGIN, 1.0))])
    sketch = rows.groupBy(*ks).agg(F.count("v").alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("e")).filter(F.col("n") > large)

    low, high = (lambda i: F.col("b.e")[2 * i]), (lambda i: F.col("b.e")[2 * i + 1])
    told = _met(rows, sketch, ks).filter(F.col("b").isNotNull()).groupBy(*ks).agg(
        F.max("b.n").alias("n"), F.max("b.e").alias("e"), *[x for i in range(len(shares)) for x in (F.count_if(F.col("v") < low(i)).alias(f"below{i}"), F.count_if(F.col("v") <= high(i)).alias(f"upto{i}"))])
    ranges = []
    for i, s in enumerate(shares):
        first, last = _places(s, F.col("n"))
        held = (F.col(f"below{i}") <= first) & (last < F.col(f"upto{i}"))
        ranges.append(F.struct(F.lit(i).alias("i"), F.when(held, F.col("e")[2 * i]).alias("low"), F.when(held, F.col("e")[2 * i + 1]).alias("high"), F.when(held, F.col(f"below{i}")).otherwise(F.lit(0)).alias("below")))
    bounds = told.select(*ks, "n", F.array(*ranges).alias("r"))

    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("bigint").alias("below")))
    inside = F.filter("b.r", lambda r: r["low"].isNull() | ((F.col("v") >= r["low"]) & (F.col("v") <= r["high"])))
    parts = _met(rows, bounds, ks).select(*ks, "v", F.col("b.n").alias("n"), F.explode(F.when(F.col("b").isNull(), whole).otherwise(inside)).alias("r"))
    counted = parts.groupBy(*ks, F.col("r.i").alias("i"), "v").agg(F.count("v").alias("c"), F.max("n").alias("n"), F.max("r.below").alias("below"))
    group = Window.partitionBy(*ks, "i")
    before = F.coalesce(F.sum("c").over(group.orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
    placed = counted.withColumn("before", before).withColumn("n", F.coalesce("n", F.sum("c").over(group)))
    picks = []
    for i, s in enumerate(shares):
        for name, rank in zip(("a", "z"), _places(s, F.col("n"))):
            here = F.col("i").isin(-1, i) & (F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))
            picks.append(F.max(F.when(here, F.col("v"))).alias(f"{name}{i}"))
    found = placed.groupBy(*ks).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *picks)
    out = []
    for i, (name, s) in enumerate(wanted.items()):
        a, z, at = F.col(f"a{i}"), F.col(f"z{i}"), F.lit(s) * (F.col("n") - 1)
        out.append(F.when(a == z, a).otherwise(a + (z - a) * (at - F.floor(at))).alias(name))
    counts = [F.col("n").alias(count_as)] if count_as else []
    return found.select(*[F.col(k).alias(c) for k, c in zip(ks, keys)], *counts, *out)
