"""Canonical text, numbers and dates of columns, as native expressions.

Text: whole doubles have no ".0", other doubles up to six decimals without trailing zeros; decimals have all their digits;
all else is Spark's cast. Whole numbers and decimals never pass through doubles.
Numbers: commas are no part of a number; text that is no number is null. Dates: see date_of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import q

# Three-letter months in order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_TIME = r"(?:[ t]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:z|[+-]\d{2}:?\d{2})?)?$"
_SEP = r"[-/. ]"


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def number_text(x: Column) -> Column:
    """A double as text: no exponent, no trailing zeros."""
    plain = F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull(), None).when(whole, F.when(whole, x).cast("bigint").cast("string")).when(F.isnan(x) | (F.abs(x) >= 1e15), x.cast("string")).otherwise(plain)


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def plain_decimal(x: Column) -> Column:
    """A decimal as text with all its digits but trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def text_of(df: DataFrame, name: str, beside: T.DataType | None = None) -> Column:
    """The canonical text of a column; null stays null.

    Decimals keep all their digits, unless the type they stand beside is floating: then they are shown as that is.
    """
    kind = type_of(df, name)
    c = F.col(q(name))
    if isinstance(kind, T.DecimalType) and not (beside is not None and is_floating(beside)):
        return plain_decimal(c)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return number_text(c.cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        midnight = F.date_trunc("day", c).cast("timestamp_ntz") == c.cast("timestamp_ntz")
        return F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return c.cast("string")


def number_of(df: DataFrame, name: str) -> Column:
    """The value as a double, null where it is none."""
    kind = type_of(df, name)
    c = F.col(q(name))
    if is_number(kind):
        return c.cast("double")
    return text_number(c.cast("string"))


def text_number(text: Column) -> Column:
    """A text as a double; null for anything that is no plain number."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed).try_cast("double")


#: Digits before and behind the point of an exact number.
EXACT = "decimal(38,12)"
_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def exact_of(df: DataFrame, name: str) -> Column:
    """The value as a decimal; null where it is no number, is floating or has more digits."""
    kind = type_of(df, name)
    c = F.col(q(name))
    if is_floating(kind):
        return F.lit(None).cast(EXACT)
    if is_number(kind):
        return c.try_cast(EXACT)
    text = F.trim(c.cast("string"))
    return F.when(text_number(text).isNotNull(), text).try_cast(EXACT)


def key_text(df: DataFrame, name: str) -> Column:
    """A text that is equal for equal values: numbers of any length without sign, zeros and points that say nothing
    ("007", 7 and 7.0 are "7"), all else trimmed. Doubles count as the shortest decimal that gives them."""
    kind = type_of(df, name)
    c = F.col(q(name))
    if isinstance(kind, T.IntegralType):
        return c.cast("string")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return text_of(df, name)
    shown = plain_decimal(c) if isinstance(kind, T.DecimalType) else F.trim(c.cast("string"))
    # exponents: as a decimal where it has room, else as the double says it
    near = shown.try_cast("double")
    roomy = [F.when(shown.try_cast(d).cast("double") == near, plain_decimal(shown.try_cast(d))) for d in ("decimal(38,18)", "decimal(38,0)", "decimal(38,37)")]
    wide = F.when(shown.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"), F.coalesce(*roomy, near.cast("string")))
    shown = F.coalesce(wide, shown)
    whole = F.regexp_extract(shown, r"^[+-]?0*(\d*)", 1)
    part = F.regexp_replace(F.regexp_extract(shown, r"\.(\d*)$", 1), r"0+$", "")
    sign = F.when(shown.startswith("-") & ((whole != "") | (part != "")), "-").otherwise("")
    number = F.concat(sign, F.when(whole == "", "0").otherwise(whole), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    return F.when(shown.rlike(_PLAIN), number).otherwise(shown)


def day_of(text: Column) -> Column:
    """yyyy-MM-dd of a text that is a date in one of the known shapes, else null.

    2024-01-31 (also with / or .), 31/01/2024 and 01/31/2024, the same with - or ., years of two digits, 31-Jan-2024,
    Jan 31, 2024, 20240131, 31012024, each with or without a time. Between slashes the day comes first if that gives a
    date, between dashes and dots the month does. Two-digit years up to 68 are of this century.
    """
    s = F.lower(F.trim(text))
    g = lambda p, i: F.regexp_extract(s, p, i)
    year = lambda y: F.when(F.length(y) > 2, y).when(y <= "68", F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))
    made = lambda y, m, d: F.date_format(F.try_to_date(F.concat_ws("-", year(y), m, d), "yyyy-M-d"), "yyyy-MM-dd")
    month = lambda m: ((F.instr(F.lit(MONTHS), F.substring(m, 1, 3)) + 2) / 3).cast("int").cast("string")
    iso = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}"
    parts = rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_TIME}"
    named = rf"^(\d{{1,2}}){_SEP}{_MONTH},?{_SEP}(\d{{4}}|\d{{2}}){_TIME}"
    named_first = rf"^{_MONTH}{_SEP}(\d{{1,2}}),?{_SEP}(\d{{4}}|\d{{2}}){_TIME}"
    compact = r"^\d{8}$"
    day_first = made(g(parts, 4), g(parts, 3), g(parts, 1))
    month_first = made(g(parts, 4), g(parts, 1), g(parts, 3))
    return (
        F.when(s.rlike(iso), made(g(iso, 1), g(iso, 2), g(iso, 3)))
        .when(s.rlike(parts), F.when(g(parts, 2) == "/", F.coalesce(day_first, month_first)).otherwise(F.coalesce(month_first, day_first)))
        .when(s.rlike(named), made(g(named, 3), month(g(named, 2)), g(named, 1)))
        .when(s.rlike(named_first), made(g(named_first, 3), month(g(named_first, 1)), g(named_first, 2)))
        .when(s.rlike(compact), F.date_format(F.coalesce(*[F.try_to_date(s, p) for p in ("yyyyMMdd", "ddMMyyyy", "MMddyyyy")]), "yyyy-MM-dd"))
    )


def is_date(text: Column) -> Column:
    return day_of(text).isNotNull()


def date_of(df: DataFrame, name: str) -> Column:
    """The column as text yyyy-MM-dd; null where it is no date. Numbers are never dates; times of day are dropped."""
    kind = type_of(df, name)
    c = F.col(q(name))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.StringType):
        return day_of(c)
    return F.lit(None).cast("string")


def normalized_date(value: str) -> Column:
    """A date given as configuration."""
    return day_of(F.lit(value))
