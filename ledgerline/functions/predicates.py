"""Filters, pattern conditions, extraction and match predicates, each compiled to one native Column.

Filters never give null, so they can be negated and combined. Regular expressions ignore case.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import ROUND_FLOOR, Decimal, InvalidOperation
from functools import reduce
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import q, require
from .canon import date_of, is_number, normalized_date, number_of, text_number, text_of, type_of

FILTER_KINDS = ("equals", "not_equals", "greater_than", "less_than", "contains", "in")


@dataclass(frozen=True)
class Filter:
    column: str
    kind: str
    value: Any


@dataclass(frozen=True)
class Pattern:
    """A pattern, several of them, or nested conditions, joined by AND or OR."""

    pattern: str | None = None
    patterns: Sequence[str] = ()
    conditions: Sequence[Pattern] = ()
    operator: str = "OR"


@dataclass(frozen=True)
class Extract:
    """A new text column: what the first matching pattern matches in `source`, where `when` holds."""

    name: str
    source: str
    patterns: Sequence[str] = ()
    when: Pattern | None = None


def every(conditions: Sequence[Column], empty: bool = True) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True)) if conditions else F.lit(empty)


def some(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def java_pattern(pattern: str) -> str:
    """The pattern for Java, ignoring case; Python's named groups become Java's."""
    return "(?i)" + pattern.replace("(?P<", "(?<")


# ------------------------------------------------------------------- filters


def filter_column(df: DataFrame, f: Filter) -> Column:
    """Text is compared without case; numbers exactly; comparisons read text as numbers and drop what is none."""
    if f.kind not in FILTER_KINDS:
        raise ValueError(f"unknown filter {f.kind!r}; known: {', '.join(FILTER_KINDS)}")
    require(df, [f.column], "the table")
    c, low = F.col(q(f.column)), F.lower(text_of(df, f.column))
    if f.kind in ("equals", "not_equals"):
        if isinstance(f.value, str):
            same = low == f.value.lower()
        else:
            same = _number(df, f.column, f.value, "eq") if is_number(type_of(df, f.column)) else c == F.lit(f.value)
        return F.coalesce(same, F.lit(False)) if f.kind == "equals" else F.coalesce(~same, F.lit(True))
    if f.kind == "greater_than":
        return F.coalesce(_number(df, f.column, f.value, "gt"), F.lit(False))
    if f.kind == "less_than":
        return F.coalesce(_number(df, f.column, f.value, "lt"), F.lit(False))
    if f.kind == "contains":
        return F.coalesce(text_of(df, f.column).rlike(java_pattern(str(f.value))), F.lit(False))
    values = [v.strip() for v in f.value.split(",")] if isinstance(f.value, str) else [str(v) for v in f.value]
    return F.coalesce(low.isin([v.lower() for v in values]), F.lit(False))


def _number(df: DataFrame, name: str, value: Any, how: str) -> Column:
    """A column against a number: whole numbers and decimals digit by digit, others and numbers in texts as doubles."""
    test = getattr(operator, how)
    kind = type_of(df, name)
    try:
        exact = Decimal(str(value).strip())
    except InvalidOperation:
        exact = None
    if isinstance(kind, T.IntegralType) and exact is not None and exact.is_finite():
        if abs(exact) >= 10**19:  # beyond any whole number of 64 bits
            return F.when(F.col(q(name)).isNotNull(), F.lit(test(0, exact)))
        floor = int(exact.to_integral_value(ROUND_FLOOR))
        if how == "eq":
            return F.when(F.col(q(name)).isNotNull(), F.lit(False)) if floor != exact else F.col(q(name)).cast("decimal(20,0)") == F.lit(floor).cast("decimal(20,0)")
        limit = F.lit(str(floor if how == "gt" or floor == exact else floor + 1)).cast("decimal(20,0)")
        return test(F.col(q(name)).cast("decimal(20,0)"), limit)
    if isinstance(kind, T.DecimalType) and exact is not None and exact.is_finite() and len(exact.as_tuple().digits) <= 18 and exact.as_tuple().exponent >= -18:
        return test(F.col(q(name)), F.lit(exact))
    return test(number_of(df, name), float(value))


def value_kind(df: DataFrame, name: str) -> str:
    """number, or the name of the column's type: values of different kinds are never equal as they are typed."""
    kind = type_of(df, name)
    return "number" if is_number(kind) else "text" if isinstance(kind, T.StringType) else kind.simpleString()


def filtered(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """The rows for which all filters hold."""
    return df.filter(every([filter_column(df, f) for f in filters])) if filters else df


def value_filtered(df: DataFrame, filters: Sequence[tuple[str, Sequence[Any]]]) -> DataFrame:
    """Rows that have, in each column named, one of its values; columns that don't exist are passed over.

    "", "nan" and "null" ask for null. Other values compare as trimmed text; if no row of the whole column has the text,
    they compare as dates. That decision takes one aggregate over the table for all filters together.
    """
    asked = [(c, i, v) for c, values in filters if c in df.columns for i, v in enumerate(values)]
    by_text = {(c, i): F.trim(text_of(df, c)) == str(v).strip() for c, i, v in asked if not _asks_null(v)}
    hits = {}
    if by_text:
        row = df.agg(*[F.coalesce(F.max(t), F.lit(False)).alias(f"h{n}") for n, t in enumerate(by_text.values())]).first()
        hits = dict(zip(by_text, row))
    kept = []
    for name, values in filters:
        if name not in df.columns:
            continue
        masks = []
        for i, v in enumerate(values):
            if _asks_null(v):
                masks.append(F.col(q(name)).isNull())
            elif hits[name, i]:
                masks.append(by_text[name, i])
            else:
                masks.append(date_of(df, name) == normalized_date(str(v)))
        kept.append(F.coalesce(some(masks), F.lit(False)))
    return df.filter(every(kept)) if kept else df


def _asks_null(v: Any) -> bool:
    return v is None or str(v).strip().lower() in ("", "nan", "null")


def exact_filtered(df: DataFrame, filters: Sequence[tuple[str, Sequence[Any]]]) -> DataFrame:
    """Rows whose columns hold one of the given values, compared as they are typed: a text is no number, a number no text."""

    def one_of(name: str, values: Sequence[Any]) -> Column:
        kind = value_kind(df, name)
        fits = {"number": lambda v: isinstance(v, (int, float, Decimal)) and not isinstance(v, bool), "text": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool)}.get(kind, lambda v: v is not None)
        same = [_number(df, name, v, "eq") if kind == "number" else F.col(q(name)) == F.lit(v) for v in values if fits(v)]
        return F.coalesce(some(same), F.lit(False))

    return df.filter(every([one_of(c, values) for c, values in filters])) if filters else df


# ------------------------------------------------- pattern conditions, extraction


def pattern_column(text: Column, p: Pattern) -> Column:
    """Whether the text meets the condition; null text meets none."""
    parts = [text.rlike(java_pattern(x)) for x in ([p.pattern] if p.pattern else []) + list(p.patterns)]
    parts += [pattern_column(text, x) for x in p.conditions]
    if not parts:
        return F.lit(False)
    return F.coalesce(every(parts) if p.operator.upper() == "AND" else some(parts), F.lit(False))


# The ways an amount may be written, tried in this order; group 1 is the amount.
AMOUNTS = [
    r"(?:Amount:?\s*)?(?:[\$€£¥₹]\s*)([\d,]+(?:\.\d{2})?)",
    r"(?:Amount|Price|Value|Cost|Total):\s*([\d,]+(?:\.\d{2})?)",
    r"\b((?:\d{1,3},)+\d{3}(?:\.\d{2})?)\b(?!\d)",
    r"(?:[\$€£¥₹]\s*)(\d+(?:\.\d{2})?)\b",
]
#: Columns of these names get an amount if there is one.
AMOUNT_NAMES = ("amount", "extractedamount", "value")


def amount_in(text: Column, patterns: Sequence[str] = AMOUNTS) -> Column:
    """The first amount over 0 that a pattern finds, as text without commas."""
    found = [F.regexp_replace(F.regexp_extract(text, java_pattern(p), 1), ",", "") for p in patterns]
    return F.coalesce(*[F.when(text_number(x) > 0, x) for x in found])


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """The whole match of the first pattern that matches; null without one."""
    found = [F.when(text.rlike(java_pattern(p)), F.regexp_extract(text, java_pattern(p), 0)) for p in patterns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def extracted(df: DataFrame, extracts: Sequence[Extract]) -> DataFrame:
    """Add a text column for each extract."""
    for e in extracts:
        require(df, [e.source], "the table")
        text = text_of(df, e.source)
        found = first_match(text, e.patterns)
        if e.name.lower() in AMOUNT_NAMES:
            found = F.coalesce(amount_in(text), found)
        if e.when is not None:
            found = F.when(pattern_column(text, e.when), found)
        df = df.withColumn(e.name, found)
    return df


def all_matches(text: Column, pattern: str, most: int = 20) -> Column:
    """array of struct(match, start, end) of up to `most` matches; starts count from 0.

    The pieces between the matches come from a split by the same pattern, so places are those of the matches themselves. An
    empty match may fall inside a character beyond U+FFFF, which counts as two there.
    """
    p = java_pattern(pattern)
    found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    between = F.split(text, p, -1)  # has no piece before an empty match at the very start
    between = F.when(F.size(between) > F.size(found), between).otherwise(F.concat(F.array(F.lit("")), between))
    pairs = F.slice(F.zip_with(found, between, lambda m, gap: F.struct(m.alias("match"), F.length(gap).alias("gap"))), 1, F.least(F.size(found), F.lit(most)))
    first = F.struct(F.array().cast("array<struct<match:string,start:int,end:int>>").alias("found"), F.lit(0).alias("at"))

    def take(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + F.length(m["match"])
        return F.struct(F.concat(acc["found"], F.array(F.struct(m["match"].alias("match"), start.alias("start"), end.alias("end")))).alias("found"), end.alias("at"))

    return F.aggregate(pairs, first, take, lambda acc: acc["found"])


def group_matches(text: Column, pattern: str, most: int | None = 20, ignore_case: bool = True) -> Column:
    """array of struct(match, index, length, groups) of a Python pattern's matches, the first `most` or all (None).

    Places are code points from 0, a group that took no part is null. Null text has no matches. Spark has no function for the
    places of groups, so Python reads the one column, in Arrow batches; the others never leave the JVM.
    """
    try:
        known = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
    except re.error as e:
        raise ValueError(f"Invalid regex pattern: {e}") from e
    made = pa.list_(pa.struct([("match", pa.string()), ("index", pa.int32()), ("length", pa.int32()), ("groups", pa.list_(pa.string()))]))

    @F.arrow_udf("array<struct<match:string,index:int,length:int,groups:array<string>>>")
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            each = islice(known.finditer(t), most) if t is not None else ()
            rows.append([{"match": m[0], "index": m.start(), "length": m.end() - m.start(), "groups": list(m.groups())} for m in each])
        return pa.array(rows, made)

    return found(text)


# ------------------------------------------------------------ match predicates


@dataclass(frozen=True)
class Side:
    """A column of one of two joined tables: its canonical forms, taken before the join."""

    text: Column
    number: Column
    date: Column


def side(df: DataFrame, name: str) -> Side:
    return Side(text_of(df, name), number_of(df, name), date_of(df, name))


def same_text(a: Column, b: Column) -> Column:
    """Equal without case; null equals null."""
    return F.lower(a).eqNullSafe(F.lower(b))


def within_percent(a: Column, b: Column, a_null: Column, b_null: Column, percent: float) -> Column:
    """|a - b| is at most `percent` per cent of |b|. Zero only fits zero; null only fits null; text that is no number fits nothing."""
    share = F.when(b != 0, F.abs(a - b) / F.when(b != 0, F.abs(b)) * 100 <= F.lit(float(percent))).when(b == 0, a == 0)
    return F.when(a_null & b_null, True).otherwise(F.coalesce(share, F.lit(False)))


def shared_characters(a: Column, b: Column) -> Column:
    """How many of a's characters occur anywhere in b, over the longer one's length (0 to 1). It is not symmetric."""
    hits = F.size(F.filter(F.split(a, ""), lambda c: (c != "") & F.contains(b, c)))
    return hits / F.greatest(F.length(a), F.length(b))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def fuzzy_of(a: Column, a_characters: Column, b: Column, least: float) -> Column:
    """fuzzy of texts that are trimmed and in lower case already; texts too short for `least` are told by their lengths."""
    longer, least_ = F.greatest(F.length(a), F.length(b)), F.lit(float(least))
    share = F.size(F.filter(a_characters, lambda c: F.contains(b, c))) / longer
    return F.when((a == "") | (b == ""), (a == "") & (b == "")).when(F.length(a) / longer < least_, False).otherwise(share >= least_)


def fuzzy(a: Column, b: Column, least: float) -> Column:
    """shared_characters of the trimmed lower-case texts is at least `least`; empty and null only fit each other."""
    x, y = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    return F.when((x == "") & (y == ""), True).when((x == "") | (y == ""), False).otherwise(shared_characters(x, y) >= F.lit(float(least)))

