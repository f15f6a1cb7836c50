"""Reconciliation: rule-based matching of table A with table B.

A rule compares a column of A with one of B. `equals` and `date_equals` rules become keys of a hash or sort-merge join.
Without any, a `tolerance` rule becomes one: numbers fall in logarithmic buckets no narrower than the tolerance, so a
match lies in the same bucket or the next; that is a join on buckets instead of all pairs. What is left of the rules is
checked on the pairs that the join finds.

Modes. many_to_many: all pairs. one_to_many: each row of A takes its first row of B, which others may take too.
many_to_one: each row of B is used once, by the first row of A. one_to_one: greedy in the order of A, then B. First
means least by the position column. If keys decide everything, one_to_many keeps B's first row of each key before the
join and one_to_one joins equal ranks within a key, so a key that many rows share makes no more pairs than rows.

Null equals null in `equals`, `tolerance` and `fuzzy`; in `date_equals` values that are no dates are equal to each other
and to null. Tolerances are per cent of B's value.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import characters, every, fuzzy_of, same_text, within_percent
from ..functions.canon import date_of, number_of, text_of, type_of
from ..functions.nearfree import Free
from ..session import free_name, q, require, shared_folder

MODES = ("one_to_many", "many_to_many", "many_to_one", "one_to_one")
KINDS = ("equals", "tolerance", "fuzzy", "date_equals")
#: Ranks within a key are numbered in slices of so many positions, so no task orders a whole hot key.
SLICE_ROWS = 1_000_000
#: Rounds in which one_to_one with further rules takes mutual first choices, and how many pairs a key has at most without them.
ROUNDS, FEW_PAIRS = 12, 1 << 18
#: One-to-one by keys and one tolerance: a key of more rows than HOT_ROWS is dealt out by pieces and blocks of BLOCK_ROWS of a side;
#: keys are first counted in so many counters. A task has about SWEPT_ROWS rows.
HOT_ROWS, BLOCK_ROWS, COUNTERS, SWEPT_ROWS = 1 << 19, 1 << 19, 1 << 16, 1 << 18
#: Above so many pairs with equal keys, rows of equal values meet together and the pairs of a key are dealt to several tasks:
#: CELL of them to one at most, CELL_ROWS rows of a side, LIST positions of a row; of positions so far apart (SPAN) lists differ.
#: A pair of texts weighs as much as TEXT_WEIGHT others.
DENSE, TEXT_WEIGHT, CELL, CELL_ROWS, LIST, SPAN = 20_000_000, 50, 1 << 24, 4096, 4096, 1 << 20
#: Pairs for each task, about, and the most tasks.
TASK_PAIRS, MOST_TASKS = 4_000_000, 10_000


@dataclass(frozen=True)
class Rule:
    left: str
    right: str
    kind: str = "equals"
    tolerance: float | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown rule {self.kind!r}; known: {', '.join(KINDS)}")
        if self.kind in ("tolerance", "fuzzy") and self.tolerance is None:
            raise ValueError(f"a {self.kind} rule needs a tolerance")


@dataclass
class Reconciled:
    """matched: FileA_ and FileB_ columns of each pair; unmatched rows of either side with their own columns."""

    matched: DataFrame
    unmatched_a: DataFrame
    unmatched_b: DataFrame
    pairs: DataFrame  # a_pos, b_pos


def validate(a: DataFrame, b: DataFrame, rules: Sequence[Rule]) -> None:
    require(a, [r.left for r in rules], "table A")
    require(b, [r.right for r in rules], "table B")


def _prepared(df: DataFrame, rules: Sequence[Rule], left: bool, pos: str, other: DataFrame | None = None) -> DataFrame:
    """Position and, for each rule, the canonical values it needs; nothing else goes into the join."""
    out = [F.col(q(pos)).alias("a_pos" if left else "b_pos")]
    tag = "a" if left else "b"
    for i, r in enumerate(rules):
        name = r.left if left else r.right
        if r.kind == "equals":
            beside = type_of(other, r.right if left else r.left) if other is not None else None
            out.append(F.lower(text_of(df, name, beside)).alias(f"{tag}{i}"))
        elif r.kind == "date_equals":
            out.append(date_of(df, name).alias(f"{tag}{i}"))
        elif r.kind == "fuzzy":
            text = F.lower(F.trim(F.coalesce(text_of(df, name), F.lit(""))))
            out += [text.alias(f"{tag}{i}"), *([characters(text).alias(f"a{i}_chars")] if left else [])]
        else:
            out += [number_of(df, name).alias(f"{tag}{i}"), F.col(q(name)).isNull().alias(f"{tag}{i}_null")]
    return df.select(*out)


def _holds(i: int, r: Rule) -> Column:
    a, b = F.col(f"a{i}"), F.col(f"b{i}")
    if r.kind == "equals":
        return same_text(a, b)
    if r.kind == "date_equals":
        return a.eqNullSafe(b)
    if r.kind == "fuzzy":
        return fuzzy_of(a, F.col(f"a{i}_chars"), b, r.tolerance)
    return within_percent(a, b, F.col(f"a{i}_null"), F.col(f"b{i}_null"), r.tolerance)


#: Zero, null and text that is no number have single buckets far away from the others.
NULL_BUCKET, NO_NUMBER_BUCKET, ZERO_BUCKET = 1 << 60, (1 << 60) + 4, (1 << 60) + 8


def log_bucket(x: Column, is_null: Column, percent: float) -> Column:
    """A bucket number: values within `percent` of each other differ by one at most. Odd values have buckets of their own."""
    width = -math.log1p(-percent / 100) * (1 + 1e-9) + 1e-12
    size = F.floor(F.log(F.when(x != 0, F.abs(x))) / width).cast("bigint")
    # signs are one bit apart
    return F.when(is_null, F.lit(NULL_BUCKET)).when(x.isNull() | F.isnan(x), F.lit(NO_NUMBER_BUCKET)).when(x == 0, F.lit(ZERO_BUCKET)).otherwise(size * 2 + (x < 0).cast("bigint"))


def candidate_pairs(a: DataFrame, b: DataFrame, rules: Sequence[Rule], nested_loop: bool = False, hot_keys: bool = False, also: Sequence[Column] = ()) -> DataFrame:
    """All pairs (a_pos, b_pos and the values compared) for which every rule holds. a, b: from _prepared. also: further conditions.

    hot_keys: join on a tolerance rule's buckets besides the keys, so that the rows of a frequent key only meet rows of
    about the same amount; each row of B then moves three times.
    """
    keys = [i for i, r in enumerate(rules) if r.kind in ("equals", "date_equals")]
    rest = [i for i in range(len(rules)) if i not in keys]
    on = [F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in keys]
    bucketed = next((i for i in rest if rules[i].kind == "tolerance" and 0 < rules[i].tolerance < 50), None)
    if bucketed is None and not keys:
        exact = next((i for i in rest if rules[i].kind == "tolerance" and rules[i].tolerance == 0), None)
        if exact is not None:
            on = [F.col(f"a{exact}").eqNullSafe(F.col(f"b{exact}"))]
        elif not nested_loop:
            raise ValueError("no rule gives a join key; add an equals, date_equals or narrow tolerance rule, or allow nested_loop")
    elif bucketed is not None and (hot_keys or not keys):
        i = bucketed
        a = a.withColumn("bucket", log_bucket(F.col(f"a{i}"), F.col(f"a{i}_null"), rules[i].tolerance))
        own = log_bucket(F.col(f"b{i}"), F.col(f"b{i}_null"), rules[i].tolerance)
        b = b.withColumn("bucket_b", F.explode(F.transform(F.array(F.lit(-2), F.lit(0), F.lit(2)), lambda d: own + d)))
        on = [*on, F.col("bucket") == F.col("bucket_b")]
    held = [_holds(i, rules[i]) for i in rest] + list(also)
    if on and held:
        alike = keys or [i for i in rest if "bucket" not in a.columns]
        met_a = [F.col(f"a{i}").alias(f"k{i}") for i in alike] + [F.col(c) for c in a.columns if c == "bucket"]
        met_b = [F.col(f"b{i}").alias(f"k{i}") for i in alike] + [F.col(c).alias("bucket") for c in b.columns if c == "bucket_b"]
        kept_a, kept_b = a.withColumn("cell", F.struct(*met_a)), b.withColumn("cell", F.struct(*met_b))
        sizes = kept_a.groupBy("cell").agg(F.count("*").alias("na")).join(kept_b.groupBy("cell").agg(F.count("*").alias("nb")), "cell")
        pairs = sizes.agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0))).first()[0]
        if pairs * (TEXT_WEIGHT if any(rules[i].kind == "fuzzy" for i in rest) else 1) > DENSE:
            return dense_pairs(kept_a, kept_b, pairs, held).drop("bucket", "bucket_b")
    joined = a.join(b, every(on + held), "inner") if on else a.crossJoin(b).filter(every(held))
    return joined.drop("bucket", "bucket_b")


def _lists(df: DataFrame, side: str) -> DataFrame:
    """Rows of equal values as one, with their positions in lists of LIST at most."""
    pos = f"{side}_pos"
    whole = df.schema[pos].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    span = F.floor(F.col(pos) / SPAN) if whole else F.pmod(F.xxhash64(pos), F.lit(1024))
    values = [c for c in df.columns if c != pos]
    listed = df.groupBy(*values, span.alias("span")).agg(F.collect_list(pos).alias("all"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / LIST).cast("int")), lambda i: F.slice("all", i * LIST + 1, LIST))
    return listed.withColumn(f"{side}_list", F.explode(parts)).drop("all", "span")


def dense_pairs(a: DataFrame, b: DataFrame, pairs: float, held: Sequence[Column]) -> DataFrame:
    """The pairs of equal `cell` for which all of `held` hold; pairs: about how many are to be judged.

    Rows of equal values are judged once, and their pairs are only written out. The rows of a cell are dealt to a grid of
    slices, so that no slice has much more than CELL pairs to judge and write, however many rows share a key or a value.
    """
    a, b = _lists(a, "a"), _lists(b, "b")
    rows = lambda df, side: df.groupBy("cell").agg(F.sum(F.size(f"{side}_list")).alias(f"n{side}"))
    sizes = rows(a, "a").join(rows(b, "b"), "cell")
    fewer = F.least("na", "nb", F.lit(CELL_ROWS))  # rows that a slice has of the smaller side
    more = F.greatest(F.floor(F.lit(CELL) / fewer), F.lit(1))
    parts = lambda n, other: F.ceil(F.col(n) / F.when(F.col(n) <= F.col(other), fewer).otherwise(more))
    grid = sizes.select("cell", parts("na", "nb").cast("int").alias("sa"), parts("nb", "na").cast("int").alias("sb"))
    tasks = int(min(max(pairs / TASK_PAIRS, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS))

    def dealt(df: DataFrame, side: str) -> DataFrame:
        own, other = ("sa", "sb") if side == "a" else ("sb", "sa")
        mine = F.pmod(F.xxhash64(*[c for c in df.columns if c != "cell"]), F.col(own)).cast("int")
        all_ = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        cut = df.join(grid, "cell").withColumn("mine", mine).withColumn("theirs", all_)
        slices = ("mine", "theirs") if side == "a" else ("theirs", "mine")
        cut = cut.withColumn(f"{side}_met", F.struct("cell", F.col(slices[0]).alias("of_a"), F.col(slices[1]).alias("of_b")))
        return cut.drop("cell", "sa", "sb", "mine", "theirs").repartition(tasks, f"{side}_met")

    judged = dealt(a, "a").join(dealt(b, "b"), every([F.col("a_met") == F.col("b_met"), *held])).drop("a_met", "b_met")
    return judged.withColumn("a_pos", F.explode("a_list")).drop("a_list").withColumn("b_pos", F.explode("b_list")).drop("b_list")


def in_pieces(a: DataFrame, b: DataFrame, rules: Sequence[Rule], i: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a_piece or b_piece and a_whole or b_whole; rows that can have no partner go. a, b: from _prepared.

    Rows of a key fall into pieces where no amount of tolerance rule i has one near it: an empty bucket lies between, so no
    pair joins two pieces. A piece is whole if each of its amounts of A is near each of B; nulls and zeros are such. The
    pieces come from one row for each key and bucket that occurs, which pass in order, not from the rows.
    """
    keys, percent = [k for k, r in enumerate(rules) if r.kind in ("equals", "date_equals")], rules[i].tolerance
    ks = [f"k{k}" for k in keys]
    bucket = lambda side: log_bucket(F.col(f"{side}{i}"), F.col(f"{side}{i}_null"), percent)
    sides, ends = {"a": a.withColumn("bucket", bucket("a")), "b": b.withColumn("bucket", bucket("b"))}, []
    for side, df in sides.items():
        ends.append(df.groupBy(*[F.col(f"{side}{k}").alias(f"k{k}") for k in keys], "bucket").agg(F.min(f"{side}{i}").alias(f"{side}_low"), F.max(f"{side}{i}").alias(f"{side}_high"), F.lit(True).alias(side)))
    buckets = ends[0].unionByName(ends[1], allowMissingColumns=True).groupBy(*ks, "bucket").agg(*[F.max(c).alias(c) for c in ("a", "b", "a_high", "b_high")], *[F.min(c).alias(c) for c in ("a_low", "b_low")])
    line = Window.partitionBy(*ks, F.pmod("bucket", F.lit(2))).orderBy("bucket")  # amounts above zero, and those below
    begins = F.when(F.coalesce(F.col("bucket") - F.lag("bucket").over(line) > 2, F.lit(True)), F.col("bucket"))
    named = buckets.withColumn("begins", begins).withColumn("piece", F.last("begins", ignorenulls=True).over(line))
    piece = Window.partitionBy(*ks, "piece")
    low, high = {s: F.min(f"{s}_low").over(piece) for s in "ab"}, {s: F.max(f"{s}_high").over(piece) for s in "ab"}
    least = percent * (1 - 1e-9)  # rounding leaves pieces at the very edge to the pairs
    near = [F.abs(x - y) / F.when(y != 0, F.abs(y)) * 100 <= least for x in (low["a"], high["a"]) for y in (low["b"], high["b"])]
    whole = F.when(F.col("piece").isin(NULL_BUCKET, ZERO_BUCKET), True).otherwise(F.coalesce(every(near), F.lit(False)))
    both = F.coalesce(F.max("a").over(piece) & F.max("b").over(piece), F.lit(False)) & (F.col("piece") != NO_NUMBER_BUCKET)
    told = named.select(*ks, F.col("bucket").alias("of"), "piece", whole.alias("whole"), both.alias("both")).filter("both")

    def tagged(side: str) -> DataFrame:
        same = every([F.col(f"{side}{k}").eqNullSafe(F.col(f"k{k}")) for k in keys] + [F.col("bucket") == F.col("of")])
        return sides[side].join(told, same).drop(*ks, "of", "both", "bucket").withColumnsRenamed({"piece": f"{side}_piece", "whole": f"{side}_whole"})

    return tagged("a"), tagged("b")


def first_pairs(pairs: DataFrame, of: str, first: str) -> DataFrame:
    """For each `of`, its pair with the least `first`; partial minima are taken before the shuffle."""
    return pairs.groupBy(of).agg(F.min(first).alias(first)).select("a_pos", "b_pos")


def ranked(df: DataFrame, keys: Sequence[str], pos: str, slice_rows: int = SLICE_ROWS, into: str = "rank") -> DataFrame:
    """Add `into`, from 1 by pos within the keys (null is a key). Each (key, slice of positions) is numbered by itself
    and shifted by the rows of the key's slices before it; the sums are one row for each key and slice."""
    named: list[str] = [*df.columns, into]

    def fresh(base: str) -> str:
        named.append(free_name(named, base))
        return named[-1]

    part, within, before, n = (fresh(x) for x in ("slice", "within", "before", "n"))
    others = [fresh(f"key{i}") for i in range(len(keys))]
    part_of = fresh("slice_of")
    cut = df.withColumn(part, F.floor(F.col(q(pos)) / slice_rows))
    own = [q(k) for k in keys]
    counts = cut.groupBy(*own, part).agg(F.count("*").alias(n))
    along = Window.partitionBy(*own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(o) for k, o in zip(own, others)], F.col(part).alias(part_of), F.coalesce(F.sum(n).over(along), F.lit(0)).alias(before))
    same = every([F.col(k).eqNullSafe(F.col(o)) for k, o in zip(own, others)] + [F.col(part) == F.col(part_of)])
    order = F.row_number().over(Window.partitionBy(*own, part).orderBy(q(pos)))
    out = cut.withColumn(within, order).join(counts, same).withColumn(into, F.col(within) + F.col(before))
    return out.drop(part, within, before, part_of, *others)


class Written:
    """Tables written below one folder of the shared ones, so that a lost executor costs a read and lineage stays short."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.names = spark, f"{shared_folder(spark)}/ledgerline-pairs-{uuid.uuid4().hex}", set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.names.discard(name)

    def drop_but(self, name: str) -> None:
        for each in self.names - {name}:
            self.drop(each)


def _one_to_one(pairs: DataFrame, keys: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    """One-to-one with rules beyond the keys, as if the pairs were taken in the order of A, then B, while both rows are free.

    In rounds: a pair that is the first of its A row and whose A row is the first of its B row comes before all pairs that
    could bar it, so it is taken, and the pairs of the rows used go. Each round is aggregations and joins, however many rows
    a key has. Where many rows may all have each other a round takes only one of them; what `rounds` leave is taken in order,
    key by key, remembering the rows already used of the key at hand. Keys of FEW_PAIRS pairs at most are taken so at once,
    as all their pairs go to one task anyway. Of the tables written on the way only the result stays.
    """
    key = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    tables, made = Written(pairs.sparkSession), 0
    try:
        all_ = tables.keep(pairs.select(key.alias("key"), "a_pos", "b_pos"), "pairs")
        large = tables.keep(all_.groupBy("key").count().filter(F.col("count") > FEW_PAIRS).select("key"), "large")
        if large.isEmpty():
            return tables.keep(_in_order(all_), "chosen")
        few, left, taken = all_.join(large, "key", "left_anti"), tables.keep(all_.join(large, "key", "left_semi"), "left0"), []
        while made < rounds and not left.isEmpty():
            first_b, first_a = left.groupBy("a_pos").agg(F.min("b_pos").alias("b_pos")), left.groupBy("b_pos").agg(F.min("a_pos").alias("a_pos"))
            now = tables.keep(first_b.join(first_a, ["a_pos", "b_pos"]).select("a_pos", "b_pos"), f"taken{made}")
            taken.append(now)
            left = tables.keep(left.join(now.select("a_pos"), "a_pos", "left_anti").join(now.select("b_pos"), "b_pos", "left_anti").select("key", "a_pos", "b_pos"), f"left{made + 1}")
            tables.drop(f"left{made}")
            made += 1
        return tables.keep(reduce(DataFrame.union, [*taken, _in_order(left), _in_order(few)]), "chosen")
    finally:
        for name in ["pairs", "large", f"left{made}", *[f"taken{n}" for n in range(made + 1)]]:
            tables.drop(name)


def _in_order(pairs: DataFrame) -> DataFrame:
    """Each key's pairs in the order of A, then B, taken while both rows are free; pairs stream past."""
    ordered = pairs.repartition("key").sortWithinPartitions("key", "a_pos", "b_pos")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used_a, used_b = None, set(), set()
        for batch in batches:
            keep = []
            for k, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if k != at:
                    at, used_a, used_b = k, set(), set()
                free = x not in used_a and y not in used_b
                if free:
                    used_a.add(x)
                    used_b.add(y)
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a_pos", "b_pos"])

    kind = lambda c: ordered.schema[c].dataType.simpleString()
    return ordered.mapInArrow(take, f"a_pos {kind('a_pos')}, b_pos {kind('b_pos')}")


def _swept(rows: DataFrame, keys: Sequence[str], percent: float, n_rows: int) -> DataFrame:
    """Rows of either side (see _near_rows), about n_rows: the pairs of one-to-one within equal keys. One key's amounts of B are held, no pairs."""
    tasks = min(max(n_rows // SWEPT_ROWS + 1, rows.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)
    rows = rows.select(*keys, "of_a", "a_pos", "b_pos", "amount")
    ordered = rows.repartition(tasks, *keys) if keys else rows.coalesce(1)
    ordered = ordered.sortWithinPartitions(*keys, "of_a", "a_pos", "b_pos")
    n_keys = len(keys)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, free, amounts, held = None, None, [], None  # of the key at hand; held: its positions of B from batches before
        for batch in batches:
            n, marks = batch.num_rows, batch.columns[:n_keys]
            if not n:
                continue
            new = np.zeros(n - 1, bool)
            for c in marks:
                here, before = c.slice(1), c.slice(0, n - 1)
                differ = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(pc.is_null(here), pc.is_null(before)))
                new |= differ.to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [n]])
            of_a, a_pos, b_pos, amount = batch.columns[n_keys:]
            of_a_before = np.concatenate([[0], np.cumsum(of_a.to_numpy(zero_copy_only=False))])
            a_from = cuts[1:] - np.diff(of_a_before[cuts])  # rows of B come before those of A
            amount = amount.to_numpy().tolist()
            first = [c[0].as_py() for c in marks]
            if held is None or at != first:
                free, amounts, held = None, [], b_pos.slice(0, 0)
            before, begin = len(held), 0
            b_pos, took_a, took_b = pa.concat_arrays([held, b_pos]), [], []
            for s, m, e in zip(cuts.tolist(), a_from.tolist(), cuts[1:].tolist()):
                if s:
                    free, amounts, begin = None, [], before + s
                amounts += amount[s:m]
                if not amounts or m == e:
                    continue
                free = free or Free(amounts, percent)
                for i in range(m, e):
                    place = free.take(amount[i])
                    if place is not None:
                        took_a.append(i)
                        took_b.append(begin + place)
            at, held = [c[n - 1].as_py() for c in marks], b_pos.slice(begin, len(amounts))
            yield pa.RecordBatch.from_arrays([a_pos.take(pa.array(took_a, pa.int64())), b_pos.take(pa.array(took_b, pa.int64()))], ["a_pos", "b_pos"])

    kind = lambda c: ordered.schema[c].dataType.simpleString()
    return ordered.mapInArrow(sweep, f"a_pos {kind('a_pos')}, b_pos {kind('b_pos')}")


def _near_rows(df: DataFrame, side: str, keys: Sequence[int], i: int, also: Sequence[str] = ()) -> DataFrame:
    """Rows with of_a, keys k0, k1 ..., the position of their side and the amount of rule i, infinite for null; those that can fit nothing go."""
    x, null = F.col(f"{side}{i}"), F.col(f"{side}{i}_null")
    able = null | (x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    amount = F.when(null, F.lit(math.inf)).otherwise(x).alias("amount")
    return df.filter(able).select(F.lit(side == "a").alias("of_a"), *[F.col(f"{side}{k}").alias(f"k{k}") for k in keys], *also, f"{side}_pos", amount)


def _one_to_one_near(a: DataFrame, b: DataFrame, rules: Sequence[Rule], i: int) -> DataFrame:
    """One-to-one by keys and tolerance rule i alone, in the order of A, then B. a, b: from _prepared.

    No pairs are made: each row of A takes the first free row of B with a near amount, key by key in tasks (_swept). The rows
    are written once, so that they are made once; a key of more than HOT_ROWS rows goes on by pieces. Only the result stays.
    """
    keys = [k for k, r in enumerate(rules) if r.kind in ("equals", "date_equals")]
    ks = [f"k{k}" for k in keys]
    tables = Written(a.sparkSession)
    try:
        rows = tables.keep(_near_rows(a, "a", keys, i).unionByName(_near_rows(b, "b", keys, i), allowMissingColumns=True), "rows")
        counter = F.pmod(F.xxhash64(*ks), F.lit(COUNTERS)) if ks else F.lit(0)
        counted = rows.groupBy(counter.alias("counter")).count().agg(F.sum("count").alias("n"), F.collect_list(F.when(F.col("count") > HOT_ROWS, F.col("counter"))).alias("full")).first()
        n, full = counted.n or 0, counted.full
        hot = tables.keep(rows.filter(counter.isin(full)).groupBy(*ks).count().filter(F.col("count") > HOT_ROWS).drop("count"), "hot") if full and ks else None
        if not full or (hot is not None and hot.isEmpty()):
            return tables.keep(_swept(rows, ks, rules[i].tolerance, n), "chosen")
        if hot is None:
            return tables.keep(_hot_pairs(rows, rules, keys, i, tables), "chosen")
        named = hot.select(*[F.col(k).alias(f"hot_{k}") for k in ks])
        same = every([F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in ks])
        few = _swept(rows.join(F.broadcast(named), same, "left_anti"), ks, rules[i].tolerance, n)
        return tables.keep(few.union(_hot_pairs(rows.join(F.broadcast(named), same, "left_semi"), rules, keys, i, tables)), "chosen")
    finally:
        tables.drop_but("chosen")


def _hot_pairs(rows: DataFrame, rules: Sequence[Rule], keys: Sequence[int], i: int, tables: Written) -> DataFrame:
    """The pairs of keys with very many rows, which fall into pieces; whole pieces are matched by rank.

    Both sides of the others are cut into blocks in the order of positions. Block m of A may meet block n of B once the blocks of
    A before it have met n, and it the blocks of B before n, so all blocks whose numbers have the same sum meet at once, each
    two in a task, and what they leave goes on to the next sum.
    """
    ks, back = [f"k{k}" for k in keys], F.nullif(F.col("amount"), F.lit(math.inf))
    side = lambda s: rows.filter(F.col("of_a") == (s == "a")).select(
        f"{s}_pos", *[F.col(f"k{k}").alias(f"{s}{k}") for k in keys], back.alias(f"{s}{i}"), back.isNull().alias(f"{s}{i}_null"))
    a, b = (tables.keep(df, f"pieces_{s}") for s, df in zip("ab", in_pieces(side("a"), side("b"), rules, i)))
    done = [_by_rank(a.filter("a_whole"), b.filter("b_whole"), [*map(str, keys), "_piece"])]

    def blocks(df: DataFrame, s: str) -> DataFrame:
        numbered = ranked(df.filter(~F.col(f"{s}_whole")), [*[f"{s}{k}" for k in keys], f"{s}_piece"], f"{s}_pos")
        block = F.floor((F.col("rank") - 1) / BLOCK_ROWS).cast("int").alias("block")
        return _near_rows(numbered, s, keys, i, [F.col(f"{s}_piece").alias("piece"), block])

    left = tables.keep(blocks(a, "a").unionByName(blocks(b, "b"), allowMissingColumns=True), "blocks0")
    sides = left.groupBy("of_a").agg(F.max("block").alias("last"), F.count("*").alias("n")).collect()
    last, n_rows = {r.of_a: r.last for r in sides}, sum(r.n for r in sides)
    rounds = sum(last.values()) + 1 if len(last) == 2 else 0
    for n in range(rounds):
        other = F.lit(n) - F.col("block")
        meet = left.filter(other.between(F.lit(0), F.when(F.col("of_a"), last[False]).otherwise(last[True])))
        met = meet.withColumn("of_block", F.when(F.col("of_a"), F.col("block")).otherwise(other))
        done.append(tables.keep(_swept(met, [*ks, "piece", "of_block"], rules[i].tolerance, n_rows), f"met{n}"))
        if n + 1 < rounds:
            now = done[-1]
            free = left.filter("of_a").join(now.select("a_pos"), "a_pos", "left_anti").unionByName(left.filter("NOT of_a").join(now.select("b_pos"), "b_pos", "left_anti"))
            left = tables.keep(free, f"blocks{n + 1}")
            tables.drop(f"blocks{n}")
    return reduce(DataFrame.union, done)


def _by_rank(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The nth row of A with the nth of B, by position, among those with equal keys (names without their a or b)."""
    left = ranked(left, [f"a{k}" for k in keys], "a_pos").withColumnRenamed("rank", "a_rank")
    right = ranked(right, [f"b{k}" for k in keys], "b_pos").withColumnRenamed("rank", "b_rank")
    on = every([F.col(f"a{k}").eqNullSafe(F.col(f"b{k}")) for k in keys] + [F.col("a_rank") == F.col("b_rank")])
    return left.join(right, on).select("a_pos", "b_pos")


def match_pairs(a: DataFrame, b: DataFrame, rules: Sequence[Rule], a_pos: str, b_pos: str, mode: str = "one_to_many", positional: bool = False, nested_loop: bool = False, hot_keys: bool = False) -> DataFrame:
    """The chosen pairs as a_pos, b_pos. Positions have to be unique.

    positional: if no rule is `equals`, row n of A only meets row n of B. nested_loop: allow a join without any key.
    hot_keys: see candidate_pairs.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    if not rules:
        raise ValueError("no rules")
    validate(a, b, rules)
    left, right = _prepared(a, rules, True, a_pos, b), _prepared(b, rules, False, b_pos, a)
    if positional and not any(r.kind == "equals" for r in rules):
        same = F.col("a_pos") == F.col("b_pos")
        return left.join(right, every([same, *[_holds(i, r) for i, r in enumerate(rules)]])).select("a_pos", "b_pos")
    keyed = all(r.kind in ("equals", "date_equals") for r in rules)
    n = range(len(rules))
    if keyed and mode == "one_to_many":
        right = right.groupBy(*[f"b{i}" for i in n]).agg(F.min("b_pos").alias("b_pos"))
        return candidate_pairs(left, right, rules).select("a_pos", "b_pos")
    if keyed and mode == "many_to_one":
        left = left.groupBy(*[f"a{i}" for i in n]).agg(F.min("a_pos").alias("a_pos"))
        return candidate_pairs(left, right, rules).select("a_pos", "b_pos")
    if keyed and mode == "one_to_one":
        return _by_rank(left, right, [str(i) for i in n])
    near = next((i for i in n if rules[i].kind == "tolerance" and 0 < rules[i].tolerance < 50), None)
    if mode == "one_to_one" and near is not None:
        keys = [i for i in n if rules[i].kind in ("equals", "date_equals")]
        if len(keys) == len(rules) - 1:
            return _one_to_one_near(left, right, rules, near)
        left, right = in_pieces(left, right, rules, near)  # another rule may part the rows of a whole piece
        pairs = candidate_pairs(left, right, rules, nested_loop, hot_keys, [F.col("a_piece") == F.col("b_piece")])
        return _one_to_one(pairs, [*[f"a{i}" for i in keys], "a_piece"])
    pairs = candidate_pairs(left, right, rules, nested_loop, hot_keys)
    if mode == "many_to_many":
        return pairs.select("a_pos", "b_pos")
    if mode == "one_to_many":
        return first_pairs(pairs, "a_pos", "b_pos")
    if mode == "many_to_one":
        return first_pairs(pairs, "b_pos", "a_pos")
    return _one_to_one(pairs, [f"a{i}" for i, r in enumerate(rules) if r.kind in ("equals", "date_equals")])


def selection(df: DataFrame, selected: Sequence[str] | None, mandatory: Sequence[str]) -> list[str]:
    """The selected columns and the mandatory ones, in the table's order; all if none are selected."""
    if not selected:
        return list(df.columns)
    wanted = {*selected, *mandatory}
    return [c for c in df.columns if c in wanted]


def mandatory_columns(rules: Sequence[Rule], left: bool, extracts: Sequence = (), filters: Sequence = ()) -> list[str]:
    """Columns that a side must keep: those of its rules, extracts and filters."""
    names = [r.left if left else r.right for r in rules] + [x for e in extracts for x in (e.source, e.name)] + [f.column for f in filters]
    return list(dict.fromkeys(names))


def reconcile(a: DataFrame, b: DataFrame, rules: Sequence[Rule], a_pos: str, b_pos: str, mode: str = "one_to_many", selected_a: Sequence[str] | None = None, selected_b: Sequence[str] | None = None, persist: bool = False, **how) -> Reconciled:
    """Matched rows side by side, and what is left of A and of B. persist: keep the pairs, to read several of these."""
    pairs = match_pairs(a, b, rules, a_pos, b_pos, mode, **how)
    pairs = pairs.persist() if persist else pairs
    keep_a, keep_b = selection(a, selected_a, mandatory_columns(rules, True)), selection(b, selected_b, mandatory_columns(rules, False))
    left = a.select(F.col(q(a_pos)).alias("_a"), *[F.col(q(c)).alias(f"FileA_{c}") for c in keep_a])
    right = b.select(F.col(q(b_pos)).alias("_b"), *[F.col(q(c)).alias(f"FileB_{c}") for c in keep_b])
    matched = pairs.join(left, F.col("a_pos") == F.col("_a")).join(right, F.col("b_pos") == F.col("_b")).drop("a_pos", "b_pos", "_a", "_b")

    def rest(df: DataFrame, pos: str, own: str, keep: Sequence[str]) -> DataFrame:
        taken = free_name(df, "taken")
        return df.join(pairs.select(F.col(own).alias(taken)), F.col(q(pos)) == F.col(taken), "left_anti").select(*[q(c) for c in keep])

    return Reconciled(matched, rest(a, a_pos, "a_pos", keep_a), rest(b, b_pos, "b_pos", keep_b), pairs)


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part / F.when(whole > 0, whole) * 100).otherwise(F.lit(0.0)), 2)


def summary(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: rows of A and B, matched pairs, unmatched rows of either, and the shares matched.

    match_percentage: pairs over the larger side; match_rate_a and _b: rows matched of a side.
    """
    counts = [a.agg(F.count("*").alias("total_a")), b.agg(F.count("*").alias("total_b"))]
    counts.append(pairs.agg(F.count("*").alias("matched"), F.countDistinct("a_pos").alias("used_a"), F.countDistinct("b_pos").alias("used_b")))
    row = reduce(lambda x, y: x.crossJoin(y), counts)  # three tables of one row
    c = F.col
    return row.select(
        "total_a", "total_b", "matched", (c("total_a") - c("used_a")).alias("unmatched_a"), (c("total_b") - c("used_b")).alias("unmatched_b"),
        percent(c("matched"), F.greatest("total_a", "total_b")).alias("match_percentage"), percent(c("used_a"), c("total_a")).alias("match_rate_a"),
        percent(c("used_b"), c("total_b")).alias("match_rate_b"), percent(c("used_a") + c("used_b"), c("total_a") + c("total_b")).alias("completeness"))
