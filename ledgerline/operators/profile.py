"""Profiles, statistics, quality checks, search and paging of tables: one aggregate over a table for all its columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import day_of, is_number, text_number, text_of, type_of
from ..functions.predicates import every, some
from ..session import free_name, q, require

SAMPLES = 5
#: Rows that an exact median puts in order at once, and how far on either side of the middle the range is taken.
MEDIAN_ROWS, MARGIN = 1_000_000, 2e-4
MIXED_LOW = 0.8


def _unpivoted(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A row of aggregates named f"{field}_{i}" as one row for each column."""
    structs = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{f}_{i}").alias(f) for f in fields]) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """For each column: type, null_count, null_percentage, distinct_count (nulls aside), and min, max and mean of numbers.

    approximate: distinct counts by sketches, which don't grow with the number of values, and one pass for all columns. Exact
    counts are one aggregation for each column, which reads that column only: in one aggregation for all, every row would be
    multiplied by the number of columns.
    """
    fields = ["data_type", "null_count", "null_percentage", "distinct_count", "min_value", "max_value", "mean_value"]

    def aggs(i: int, f: T.StructField) -> list[Column]:
        c = F.col(q(f.name))
        number = c.cast("double") if is_number(f.dataType) else F.lit(None).cast("double")
        distinct = F.approx_count_distinct(c) if approximate else F.count_distinct(c)
        return [F.count_if(c.isNull()).alias(f"null_count_{i}"), distinct.alias(f"distinct_count_{i}"), F.min(number).alias(f"min_value_{i}"), F.max(number).alias(f"max_value_{i}"), F.avg(number).alias(f"mean_value_{i}")]

    def told(row: DataFrame, own: list[tuple[int, T.StructField]]) -> DataFrame:
        for i, f in own:
            row = row.withColumn(f"data_type_{i}", F.lit(f.dataType.simpleString())).withColumn(f"null_percentage_{i}", F.round(F.when(F.col("rows") > 0, F.col(f"null_count_{i}") / F.greatest("rows", F.lit(1)) * 100).otherwise(F.lit(0.0)), 2))
        structs = [F.struct(F.lit(f.name).alias("column_name"), *[F.col(f"{x}_{i}").alias(x) for x in fields]) for i, f in own]
        return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")

    columns, rows = list(enumerate(df.schema)), F.count("*").alias("rows")
    if approximate or not columns:
        return told(df.agg(rows, *[a for i, f in columns for a in aggs(i, f)]), columns)
    return reduce(DataFrame.union, [told(df.select(q(f.name)).agg(rows, *aggs(i, f)), [(i, f)]) for i, f in columns])


#: Bytes of a value of fixed size.
_BYTES = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}


def storage(df: DataFrame) -> DataFrame:
    """For each column: data_type, non_null_count, null_count and memory_bytes, what its values take.

    Numbers and dates count by their type (decimals 8 bytes up to 18 digits, else 16), texts and binaries by their bytes,
    nested values by their bytes as JSON; nulls take nothing. One aggregate over the table.
    """

    def size(f: T.StructField) -> Column:
        c, kind = F.col(q(f.name)), f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.sum(F.octet_length(c))
        if isinstance(kind, T.DecimalType):
            return F.count(c) * (8 if kind.precision <= 18 else 16)
        if type(kind) in _BYTES:
            return F.count(c) * _BYTES[type(kind)]
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.sum(F.when(c.isNotNull(), F.octet_length(F.to_json(F.struct(c.alias("v")))) - len('{"v":}')))
        return F.sum(F.octet_length(c.cast("string")))

    aggs = []
    for i, f in enumerate(df.schema):
        known = F.count(F.col(q(f.name)))
        aggs += [F.lit(f.dataType.simpleString()).alias(f"data_type_{i}"), known.alias(f"non_null_count_{i}"), F.count_if(F.col(q(f.name)).isNull()).alias(f"null_count_{i}"), F.coalesce(size(f), F.lit(0)).cast("bigint").alias(f"memory_bytes_{i}")]
    return _unpivoted(df.agg(*aggs), df.columns, ["data_type", "non_null_count", "null_count", "memory_bytes"])


def samples(df: DataFrame, n: int = SAMPLES) -> dict[str, list]:
    """Some values of each column that aren't null, from the first rows."""
    rows = df.limit(20 * n).collect()
    return {c: [r[i] for r in rows if r[i] is not None][:n] for i, c in enumerate(df.columns)}


def median(df: DataFrame, name: str, most: int = MEDIAN_ROWS) -> float | None:
    """The exact median (interpolated) of a number column whatever its size.

    Approximate quantiles on either side of the middle narrow the range down until at most `most` rows are in it, or it doesn't
    get narrower; only these are put in order, with the exact number of rows below them.
    """
    c = F.col(q(name)).cast("double")
    known = df.filter(c.isNotNull())
    n = known.count()
    if not n:
        return None
    ranks, below, size, inside = [(n - 1) // 2, n // 2], 0, n, F.lit(True)
    ends: tuple[float, float] | None = None
    while size > most:
        share = [max((ranks[0] - below) / size - MARGIN, 0.0), min((ranks[1] - below) / size + MARGIN, 1.0)]
        lo, hi = known.filter(inside).agg(F.percentile_approx(c, share, 10_000).alias("q")).first()["q"]
        if (lo, hi) == ends:
            break
        row = known.agg(F.count_if(c < lo).alias("below"), F.count_if((c >= lo) & (c <= hi)).alias("size")).first()
        if not row["below"] <= ranks[0] <= ranks[1] < row["below"] + row["size"]:
            break
        ends, inside, below, size = (lo, hi), (c >= lo) & (c <= hi), row["below"], row["size"]
        if lo == hi:
            return lo
    at = [(r - below) / max(size - 1, 1) for r in ranks]
    return sum(known.filter(inside).agg(F.percentile(c, at).alias("q")).first()["q"]) / 2


def statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """For each numeric column: count, mean, sample standard deviation, min, median (interpolated), max and null_count."""
    names = [f.name for f in df.schema if is_number(f.dataType)] if columns is None else list(columns)
    require(df, names, "the table")
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, count bigint, mean double, std double, min double, median double, max double, null_count bigint")
    aggs = []
    large = df.count() > MEDIAN_ROWS
    for i, name in enumerate(names):
        c = F.col(q(name)).cast("double")
        middle = F.lit(median(df, name)).cast("double") if large else F.percentile(c, 0.5)
        aggs += [F.count(c).alias(f"count_{i}"), F.avg(c).alias(f"mean_{i}"), F.stddev_samp(c).alias(f"std_{i}"), F.min(c).alias(f"min_{i}"), middle.alias(f"median_{i}"), F.max(c).alias(f"max_{i}"), F.count_if(c.isNull()).alias(f"null_count_{i}")]
    return _unpivoted(df.agg(*aggs), names, ["count", "mean", "std", "min", "median", "max", "null_count"])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: duplicate_rows, how many rows repeat an earlier one in all columns (null equals null)."""
    times = free_name(df, "times")
    groups = df.groupBy(*[q(c) for c in df.columns]).agg(F.count("*").alias(times))
    return groups.agg(F.coalesce(F.sum(F.col(times) - 1), F.lit(0)).alias("duplicate_rows"))


def quality(df: DataFrame) -> DataFrame:
    """One row: rows, duplicate_rows, null_rows, null_columns and mixed_columns.

    null_columns: names of columns without a value; mixed_columns: text columns of which over MIXED_LOW but not all
    values are numbers. Both are texts, joined by commas in the table's order.
    """
    all_null = every([F.col(q(c)).isNull() for c in df.columns])
    aggs = [F.count("*").alias("rows"), F.count_if(all_null).alias("null_rows")]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(F.col(q(c))).alias(f"_v{i}"))
    for i, c in enumerate(texts):
        aggs.append(F.count(text_number(F.col(q(c)))).alias(f"_n{i}"))
    row = df.agg(*aggs)
    nulls = F.array_join(F.array_compact(F.array(*[F.when((F.col(f"_v{i}") == 0) & (F.col("rows") > 0), F.lit(c)) for i, c in enumerate(df.columns)])), ",")
    at = {c: i for i, c in enumerate(df.columns)}
    share = lambda i, c: F.col(f"_n{i}") / F.greatest(F.col(f"_v{at[c]}"), F.lit(1))
    mixed = F.array_join(F.array_compact(F.array(*[F.when((share(i, c) > MIXED_LOW) & (share(i, c) < 1), F.lit(c)) for i, c in enumerate(texts)])), ",") if texts else F.lit("")
    return row.select("rows", "null_rows", nulls.alias("null_columns"), mixed.alias("mixed_columns")).crossJoin(duplicate_rows(df))  # one row each


# ------------------------------------------------------------ search and paging


def column_filtered(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Rows whose columns have one of the values in a comma list, without case; several columns are ANDed."""
    require(df, list(filters), "the table")
    kept = [F.coalesce(F.lower(text_of(df, c)).isin([v.strip().lower() for v in given.split(",")]), F.lit(False)) for c, given in filters.items()]
    return df.filter(every(kept)) if kept else df


def search(df: DataFrame, term: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which the text of any column contains the term, without case."""
    names = df.columns if columns is None else columns
    return df.filter(some([F.coalesce(F.contains(F.lower(text_of(df, c)), F.lit(term.lower())), F.lit(False)) for c in names]))


def distinct_values(df: DataFrame, column: str, filters: Mapping[str, Sequence[Any]] | None = None, limit: int = 1000, dates: bool | None = None) -> DataFrame:
    """The distinct values of a column among the rows that other columns' filters leave, in order, up to a limit.

    dates: sort as dates (by default, if the column's type is one); text that is no date goes last.
    """
    require(df, [column, *(filters or {})], "the table")
    kept = [F.coalesce(text_of(df, c).isin([str(v) for v in values]), F.lit(False)) for c, values in (filters or {}).items() if c != column]
    values = df.filter(every(kept)) if kept else df
    values = values.select(text_of(df, column).alias("value")).filter("value is not null").distinct()
    by_date = isinstance(type_of(df, column), (T.DateType, T.TimestampType, T.TimestampNTZType)) if dates is None else dates
    order = [F.asc_nulls_last(day_of(F.col("value"))), F.asc("value")] if by_date else [F.asc("value")]
    if not by_date and is_number(type_of(df, column)):
        order = [F.asc(F.col("value").try_cast("double")), F.asc("value")]
    return values.orderBy(*order).limit(limit)


def page(df: DataFrame, order: str | Sequence[str], number: int = 1, size: int = 100, columns: Sequence[str] | None = None, most: int = 1000) -> DataFrame:
    """Page `number` (from 1) of a table in the order of one or more columns; a page has `most` rows at most."""
    by = [order] if isinstance(order, str) else list(order)
    size = max(1, min(size, most))
    out = df.orderBy(*[F.col(q(c)) for c in by]).offset((max(number, 1) - 1) * size).limit(size)
    return out.select(*[q(c) for c in columns]) if columns else out


def finite(df: DataFrame, largest: float | None = None) -> DataFrame:
    """NaN and infinite numbers (and those over `largest` in size) become null."""

    def kept(f: T.StructField) -> Column:
        c = F.col(q(f.name))
        if not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return c
        odd = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(~(odd | (F.abs(c) > largest) if largest else odd), c).alias(f.name)

    return df.select(*[kept(f) for f in df.schema])


def common_columns(tables: Sequence[DataFrame]) -> list[str]:
    """Columns that all tables have, in the first one's order: candidates for a join."""
    return [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])] if tables else []


def references(df: DataFrame, names: Sequence[str]) -> dict[str, Any]:
    """Which of the named columns exist: found, missing and the share found in per cent."""
    found = [n for n in names if n in df.columns]
    return {"found": found, "missing": [n for n in names if n not in df.columns], "success_rate": round(100 * len(found) / len(names), 2) if names else 100.0}


def union_all(tables: Sequence[DataFrame], label: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """The tables below each other by column name; `label` is a column that holds each one's name."""
    each = [t.withColumn(label, F.lit(n)) for t, n in zip(tables, names or [])] if label else list(tables)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
