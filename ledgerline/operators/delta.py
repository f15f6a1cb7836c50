"""Delta: the difference between an older and a newer snapshot of a table, as one full outer join.

Every record is UNCHANGED, AMENDED, DELETED (only in the older one) or NEWLY_ADDED. Keys are compared null-safely and
typed loosely: text that is a number equals the number ("007" is 7), whatever its length. Whole numbers, decimals and
numbers in texts are compared exactly; only floating columns are compared as doubles. Of several rows with one key, the
first by position counts; duplicate_keys tells how many there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import date_of, exact_of, is_floating, key_text, number_of, text_of, type_of
from ..functions.predicates import every
from ..session import q, require

KINDS = ("equals", "case_insensitive", "numeric_tolerance", "date_equals")
CATEGORIES = ("UNCHANGED", "AMENDED", "DELETED", "NEWLY_ADDED")
# What is said of rows that only one table has.
DELETED_TEXT, ADDED_TEXT = "Record deleted from newer file", "New record added in newer file"
#: So many changes are spelled out; Total_Changes counts all.
CHANGES_SHOWN = 5


@dataclass(frozen=True)
class Key:
    left: str
    right: str
    kind: str = "equals"


@dataclass(frozen=True)
class Compare:
    left: str
    right: str
    kind: str = "equals"
    tolerance: float | None = None


def _check(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown comparison {kind!r}; known: {', '.join(KINDS)}")
    return kind


def _key_columns(a: DataFrame, b: DataFrame, keys: Sequence[Key], left: bool) -> list[Column]:
    """Join keys of one side. Whole-number types on both sides join as they are, all else by key_text, digit by digit."""
    df, out = (a, []) if left else (b, [])
    for i, k in enumerate(keys):
        name = k.left if left else k.right
        whole = all(isinstance(type_of(x, n), T.IntegralType) for x, n in ((a, k.left), (b, k.right)))
        if whole:
            out.append(F.col(q(name)).cast("bigint").alias(f"_k{i}"))
            continue
        text = key_text(df, name)
        out.append((F.lower(text) if _check(k.kind) == "case_insensitive" else text).alias(f"_k{i}"))
    return out


def _first_rows(df: DataFrame, keys: list[Column], values: list[Column], pos: str) -> DataFrame:
    """For each key, the row with the least position: one hash aggregation with partial results before the shuffle."""
    keyed = df.select(*keys, F.struct(F.col(q(pos)).alias("_pos"), *values).alias("_row"))
    own = [c for c in keyed.columns if c != "_row"]
    return keyed.groupBy(*own).agg(F.min_by("_row", F.struct("_row._pos")).alias("_row"), F.count("*").alias("_n"))


def auto_rules(a: DataFrame, b: DataFrame, keys: Sequence[Key]) -> list[Compare]:
    """Compare all columns that both tables have and that are no keys, in A's order."""
    used = {k.left for k in keys} | {k.right for k in keys}
    return [Compare(c, c) for c in a.columns if c in b.columns and c not in used]


def _same(i: int, r: Compare) -> Column:
    """Whether both values, neither null, count as the same."""
    text_a, text_b, num_a, num_b = (F.col(f"_a._{k}{i}") if s == "a" else F.col(f"_b._{k}{i}") for k, s in (("t", "a"), ("t", "b"), ("n", "a"), ("n", "b")))
    numbers = num_a.isNotNull() & num_b.isNotNull()
    exact_a, exact_b = F.col(f"_a._x{i}"), F.col(f"_b._x{i}")
    exact = exact_a.isNotNull() & exact_b.isNotNull()
    digits_a, digits_b = F.col(f"_a._k{i}"), F.col(f"_b._k{i}")
    by_digits = numbers & digits_a.isNotNull() & digits_b.isNotNull()
    trimmed = F.trim(text_a) == F.trim(text_b)
    if r.kind == "case_insensitive":
        return F.lower(F.trim(text_a)) == F.lower(F.trim(text_b))
    if r.kind == "date_equals":
        return F.col(f"_a._d{i}").eqNullSafe(F.col(f"_b._d{i}"))
    if r.kind == "numeric_tolerance":
        if r.tolerance is None:
            return F.when(by_digits, digits_a == digits_b).when(numbers, num_a == num_b).otherwise(trimmed)
        near = F.when(num_b != 0, F.abs(num_a - num_b) / F.when(num_b != 0, F.abs(num_b)) * 100 <= float(r.tolerance)).otherwise(num_a == 0)
        return F.when(numbers, near).otherwise(trimmed)
    return F.when(exact, F.round(exact_a, 2) == F.round(exact_b, 2)).when(by_digits, digits_a == digits_b).when(numbers, F.round(num_a, 2) == F.round(num_b, 2)).otherwise(trimmed)


def classified(a: DataFrame, b: DataFrame, keys: Sequence[Key], compares: Sequence[Compare] | None = None, a_pos: str | None = None, b_pos: str | None = None, selected_a: Sequence[str] | None = None, selected_b: Sequence[str] | None = None) -> DataFrame:
    """FileA_ and FileB_ columns, Delta_Type, Changes and Total_Changes of every key.

    a is the older table. compares: None compares all common columns that are no keys; [] compares nothing. a_pos, b_pos:
    the order in which the first row of a key is found; by default the keys themselves, so any row of the key. A position
    whose name begins with "_" is no column of the table and isn't returned.
    """
    if not keys:
        raise ValueError("no keys")
    require(a, [k.left for k in keys], "the older table")
    require(b, [k.right for k in keys], "the newer table")
    compares = auto_rules(a, b, keys) if compares is None else list(compares)
    require(a, [r.left for r in compares], "the older table")
    require(b, [r.right for r in compares], "the newer table")
    sides = []
    for left, df, pos, selected in ((True, a, a_pos, selected_a), (False, b, b_pos, selected_b)):
        names = [k.left if left else k.right for k in keys]
        keep = [c for c in df.columns if not (c == pos and c.startswith("_")) and (not selected or c in selected or c in names)]
        values = [F.struct(*[F.col(q(c)).alias(c) for c in keep]).alias("_kept")]
        for i, r in enumerate(compares):
            name = r.left if left else r.right
            beside = type_of(b, r.right) if left else type_of(a, r.left)
            values += [text_of(df, name, beside).alias(f"_t{i}"), number_of(df, name).alias(f"_n{i}"), exact_of(df, name).alias(f"_x{i}")]
            if r.kind == "equals":  # up to 36 digits before the point
                values.append((F.lit(None).cast("decimal(38,2)") if is_floating(type_of(df, name)) else F.when(number_of(df, name).isNotNull(), F.trim(text_of(df, name))).try_cast("decimal(38,2)")).alias(f"_k{i}"))
            if r.kind == "numeric_tolerance" and r.tolerance is None:  # of any length
                values.append((F.lit(None).cast("string") if is_floating(type_of(df, name)) else key_text(df, name)).alias(f"_k{i}"))
            if _check(r.kind) == "date_equals":
                values.append(date_of(df, name).alias(f"_d{i}"))
        rows = _first_rows(df, _key_columns(a, b, keys, left), values, pos or names[0])
        own = [c for c in rows.columns if c not in ("_row", "_n")]
        tag = "_a" if left else "_b"
        sides.append((rows.select(*[F.col(c).alias(f"{c}{tag}") for c in own], F.col("_row").alias(tag)), own, keep))
    (rows_a, own, keep_a), (rows_b, _, keep_b) = sides
    joined = rows_a.join(rows_b, every([F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in own]), "full_outer")

    said = []
    for i, r in enumerate(compares):
        x, y = F.col(f"_a._t{i}"), F.col(f"_b._t{i}")
        changed = F.when(x.isNull() & y.isNull(), False).when(x.isNull() | y.isNull(), True).otherwise(~_same(i, r))
        show = lambda t: F.coalesce(t, F.lit("nan"))
        said.append(F.when(changed, F.concat(F.lit(f"{r.left}: '"), show(x), F.lit("' -> '"), show(y), F.lit("'"))))
    changes = F.array_compact(F.array(*said)) if said else F.array().cast("array<string>")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    joined = joined.withColumn("_changes", F.when(both, changes))
    kind = F.when(F.col("_b").isNull(), "DELETED").when(F.col("_a").isNull(), "NEWLY_ADDED").when(F.size("_changes") == 0, "UNCHANGED").otherwise("AMENDED")
    text = F.when(F.col("_b").isNull(), DELETED_TEXT).when(F.col("_a").isNull(), ADDED_TEXT).when(F.size("_changes") > 0, F.array_join(F.slice("_changes", 1, CHANGES_SHOWN), "; "))
    return joined.select(
        *[F.col("_a._kept")[c].alias(f"FileA_{c}") for c in keep_a], *[F.col("_b._kept")[c].alias(f"FileB_{c}") for c in keep_b],
        kind.alias("Delta_Type"), text.alias("Changes"), F.when(kind == "AMENDED", F.size("_changes")).alias("Total_Changes"))


def categories(delta: DataFrame) -> dict[str, DataFrame]:
    """unchanged, amended, deleted, newly_added, all_changes, and all_combined with Delta_Category; persist `delta` to read several."""
    of = lambda *kinds: delta.filter(F.col("Delta_Type").isin(*kinds))
    out = {c.lower(): of(c) for c in CATEGORIES}
    out["all_changes"] = of(*CATEGORIES[1:])
    out["all_combined"] = delta.withColumn("Delta_Category", F.col("Delta_Type"))
    return out


def summary(delta: DataFrame) -> DataFrame:
    """One row: the count of each category, their sum, and each one's share of it in per cent (2 decimals)."""
    n = lambda c: F.count_if(F.col("Delta_Type") == c)
    counts = delta.agg(*[n(c).alias(c.lower()) for c in CATEGORIES], F.count("*").alias("total_records"))
    rate = lambda part: F.round(F.when(F.col("total_records") > 0, part / F.greatest("total_records", F.lit(1)) * 100).otherwise(F.lit(0.0)), 2)
    named = zip(("stability_percentage", "amendment_rate", "deletion_rate", "addition_rate"), CATEGORIES)
    return counts.select(
        *[c.lower() for c in CATEGORIES], "total_records", *[rate(F.col(c.lower())).alias(name) for name, c in named],
        rate(F.col("amended") + F.col("deleted") + F.col("newly_added")).alias("overall_change_rate"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows share, with their number of rows."""
    require(df, list(keys), "the table")
    return df.groupBy(*[q(k) for k in keys]).agg(F.count("*").alias("rows")).filter("rows > 1")
