"""Cleaning of freshly read tables: empty rows and columns, names, blanks, types and dates.

Each step that depends on the data first takes one aggregate over the table, for all columns at once; the cleaning
itself is one projection. Tables are read as text and typed here, the same way every time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import day_of, text_number
from ..session import free_name, q

#: Values looked at to tell a column's type; a fixed number, as in the rule that it implements.
SAMPLE = 20
DATE_SHARE = 0.7
#: Shares of removed rows and columns, in per cent, from which the report warns.
WARN_ROWS, WARN_COLUMNS = 30.0, 20.0


@dataclass
class Report:
    rows: int = 0
    columns: int = 0
    removed_rows: int = 0
    removed_columns: list[str] = field(default_factory=list)
    renamed: dict[str, str] = field(default_factory=dict)
    dates: list[str] = field(default_factory=list)
    whole_numbers: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _has_value(df: DataFrame, name: str) -> Column:
    """Whether the column isn't null and, as text, not blank."""
    c = F.col(q(name))
    return c.isNotNull() & (F.trim(c) != "") if isinstance(df.schema[name].dataType, T.StringType) else c.isNotNull()


def with_row_pos(df: DataFrame, name: str = "_row_pos") -> DataFrame:
    """Add each row's place in its file (files by path), from 0, for a table that comes straight from a file scan.

    Rows are numbered within the blocks that tasks read and shifted by the blocks before; nothing is collected. Take it
    on a table that is read the same way each time, and write the result before using it as an identity.
    """
    file, block, at, first, ahead = (free_name(df, c) for c in ("file", "block", "id", "first", "before"))
    rows = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(at))
    before = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(file, block).agg(F.count("*").alias("n"), F.min(at).alias(first))  # one row for each block
    counts = counts.withColumn(ahead, F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    out = rows.join(counts, [file, block]).withColumn(name, F.col(ahead) + F.col(at) - F.col(first))
    return out.select(*[q(c) for c in df.columns], name)


def leading_zero_columns(df: DataFrame, sample_rows: int = 100) -> list[str]:
    """Text columns with a value like 007 among the first SAMPLE values of the first rows: they must stay text."""
    names = _texts(df)
    rows = df.select(*[q(c) for c in names]).limit(sample_rows).collect() if names else []
    out = []
    for i, c in enumerate(names):
        values = [r[i].strip() for r in rows if r[i] is not None and r[i].strip()][:SAMPLE]
        if any(len(v) > 1 and v[0] == "0" and "." not in v and v.replace("-", "").isdigit() for v in values):
            out.append(c)
    return out


def drop_empty(df: DataFrame, report: Report | None = None) -> DataFrame:
    """Without columns that have no value at all, then without rows that have none."""
    report = report if report is not None else Report()
    if not df.columns:
        return df
    row = df.agg(F.count("*").alias("rows"), *[F.count_if(_has_value(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    report.rows, report.columns = row["rows"], len(df.columns)
    kept = [c for i, c in enumerate(df.columns) if row[f"c{i}"]]
    report.removed_columns = [c for c in df.columns if c not in kept]
    out = df.select(*[q(c) for c in kept])
    if not kept:
        return out.limit(0)
    some = F.lit(False)
    for c in kept:
        some = some | _has_value(df, c)
    return out.filter(some)


def clean_names(names: Sequence[str]) -> list[str]:
    """Trimmed; empty ones become Unnamed_i; repeated ones get _1, _2 and so on."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, n in enumerate(names):
        base = (n or "").strip()
        if not base or base.lower().startswith("unnamed:") or base.lower() == "nan":
            base = f"Unnamed_{i}"
        name = base
        while name in out:
            seen[base] = seen.get(base, 0) + 1
            name = f"{base}_{seen[base]}"
        out.append(name)
    return out


def trim_values(df: DataFrame) -> DataFrame:
    """White space around text values goes."""
    return df.select(*[F.regexp_replace(F.col(q(c)), r"^\s+|\s+$", "").alias(c) if c in _texts(df) else F.col(q(c)) for c in df.columns])


def whole_numbers(df: DataFrame, report: Report | None = None) -> DataFrame:
    """Double columns without a fraction in any value become whole numbers; nulls stay null."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not names:
        return df
    odd = lambda c: F.coalesce(F.max(F.isnan(c) | (F.abs(c) >= 2.0**63) | (c != F.floor(c))), F.lit(True))
    row = df.agg(*[odd(F.col(q(c))).alias(f"c{i}") for i, c in enumerate(names)]).first()
    whole = [c for i, c in enumerate(names) if not row[f"c{i}"]]
    if report is not None:
        report.whole_numbers += whole
    return df.select(*[F.col(q(c)).cast("bigint").alias(c) if c in whole else F.col(q(c)) for c in df.columns])


#: A double gives back any number of so many significant digits.
DOUBLE_DIGITS = 15


def significant(number: Column) -> Column:
    """The significant digits of a number in text: neither zeros before nor after them, nor sign, point and exponent."""
    digits = F.regexp_replace(F.regexp_replace(number, r"[eE].*$", ""), r"[^0-9]", "")
    return F.regexp_replace(digits, r"^0+|0+$", "")


def typed(df: DataFrame, keep_text: Sequence[str] = ()) -> DataFrame:
    """Text columns whose values are all numbers become whole numbers or doubles; those in keep_text stay text.

    A column with a number that has more than 15 significant digits and isn't within 64-bit whole numbers stays text, as a
    double would not give it back.
    """
    names = [c for c in _texts(df) if c not in keep_text]
    if not names:
        return df
    checks = []
    for i, c in enumerate(names):
        value = F.trim(F.col(q(c)))
        blank = value.isNull() | (value == "")
        checks += [F.coalesce(F.bool_and(blank | text_number(value).isNotNull()), F.lit(False)).alias(f"n{i}"), F.coalesce(F.bool_and(blank | value.rlike(r"^[+-]?\d{1,18}$")), F.lit(False)).alias(f"w{i}"), F.coalesce(F.bool_or(~blank), F.lit(False)).alias(f"v{i}"), F.coalesce(F.bool_or(F.length(significant(value)) > DOUBLE_DIGITS), F.lit(False)).alias(f"l{i}")]
    row = df.agg(*checks).first()
    out = []
    for c in df.columns:
        i = names.index(c) if c in names else -1
        if i < 0 or not row[f"v{i}"] or not row[f"n{i}"] or row[f"l{i}"] and not row[f"w{i}"]:
            out.append(F.col(q(c)))
        else:
            value = F.trim(F.col(q(c)))
            out.append((value.try_cast("bigint") if row[f"w{i}"] else text_number(value)).alias(c))
    return df.select(*out)


def date_columns(df: DataFrame) -> list[str]:
    """Text columns in whose first SAMPLE values at least DATE_SHARE are dates."""
    names = _texts(df)
    if not names:
        return []
    firsts = df.select(*[q(c) for c in names]).limit(50 * SAMPLE)
    picked = firsts.agg(*[F.slice(F.collect_list(F.when(F.trim(F.col(q(c))) != "", F.col(q(c)))), 1, SAMPLE).alias(f"c{i}") for i, c in enumerate(names)])
    shares = picked.select(*[F.when(F.size(f"c{i}") > 0, F.size(F.filter(F.transform(f"c{i}", day_of), lambda d: d.isNotNull())) / F.size(f"c{i}")).otherwise(F.lit(0.0)).alias(f"c{i}") for i in range(len(names))]).first()
    return [c for i, c in enumerate(names) if shares[i] >= DATE_SHARE]


def normalize_dates(df: DataFrame, names: Sequence[str] | None = None, report: Report | None = None) -> DataFrame:
    """Date columns (found by date_columns unless named) as text yyyy-MM-dd; values that are no dates stay as they are."""
    names = date_columns(df) if names is None else list(names)
    if report is not None:
        report.dates += names
    out = []
    for f in df.schema:
        c = F.col(q(f.name))
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        else:
            out.append(F.coalesce(day_of(c), c).alias(f.name) if f.name in names else c)
    return df.select(*out)


def clean(df: DataFrame, keep_text: Sequence[str] | None = None) -> tuple[DataFrame, Report]:
    """All steps: leading zeros noted, empty columns and rows dropped, names and values trimmed, types, dates."""
    report = Report()
    zeros = leading_zero_columns(df) if keep_text is None else list(keep_text)
    out = drop_empty(df, report)
    names = clean_names(out.columns)
    report.renamed = {a: b for a, b in zip(out.columns, names) if a != b}
    out = trim_values(out.toDF(*names))
    out = normalize_dates(out, report=report)
    out = typed(out, [report.renamed.get(z, z) for z in zeros] + report.dates)
    out = whole_numbers(out, report)
    report.removed_rows = report.rows - out.count()
    if report.rows and report.removed_rows / report.rows * 100 >= WARN_ROWS:
        report.warnings.append(f"{report.removed_rows / report.rows * 100:.1f}% of the rows were empty")
    if report.columns and len(report.removed_columns) / report.columns * 100 >= WARN_COLUMNS:
        report.warnings.append(f"{len(report.removed_columns) / report.columns * 100:.1f}% of the columns were empty")
    return out, report


def cleanup_counts(df: DataFrame) -> DataFrame:
    """One row: rows, columns, empty rows, columns without any value, and their shares in per cent."""
    blank = F.lit(True)
    for c in df.columns:
        blank = blank & ~_has_value(df, c)
    counts = df.agg(F.count("*").alias("rows"), F.count_if(blank).alias("empty_rows"), *[F.count_if(_has_value(df, c)).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    empty = sum(((F.col(f"_c{i}") == 0).cast("bigint") for i in range(1, len(df.columns))), (F.col("_c0") == 0).cast("bigint"))
    share = lambda a, b: F.round(F.when(b > 0, a / F.when(b > 0, b) * 100).otherwise(F.lit(0.0)), 2)
    n = F.lit(len(df.columns)).cast("bigint")
    return counts.select("rows", n.alias("columns"), "empty_rows", empty.alias("empty_columns"), share(F.col("empty_rows"), F.col("rows")).alias("empty_row_share"), share(empty, n).alias("empty_column_share"))
