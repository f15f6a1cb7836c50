"""Edits of a table by row position. Each gives a new table; the changes are joined, never looped over.

Row positions are whole numbers without gaps from 0 in the column `pos`; deleting rows numbers the rest anew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import text_of
from ..session import free_name, q
from .recon import ranked


@dataclass(frozen=True)
class Patch:
    """Applied in this order: columns added, dropped and renamed; cells; rows deleted; rows added."""

    add_columns: Sequence[str] = ()
    drop_columns: Sequence[str] = ()
    rename_columns: Mapping[str, str] = field(default_factory=dict)
    cells: Sequence[tuple[int, str, Any]] = ()  # row, column, value; the last of equals counts
    delete_rows: Sequence[int] = ()
    add_rows: Sequence[Mapping[str, Any]] = ()


def change_columns(df: DataFrame, add: Sequence[str] = (), drop: Sequence[str] = (), rename: Mapping[str, str] | None = None) -> DataFrame:
    """New columns hold ""; a rename takes place only if the new name is free."""
    for c in add:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    df = df.select(*[q(c) for c in df.columns if c not in drop])
    names = list(df.columns)
    for old, new in (rename or {}).items():
        if old in names and new not in names:
            names[names.index(old)] = new
    return df.toDF(*names)


def update_cells(df: DataFrame, cells: Sequence[tuple[int, str, Any]], pos: str = "_row_pos") -> DataFrame:
    """Set cells. A column takes the value in its own type, or becomes text if the value doesn't fit it."""
    latest = {(row, c): v for row, c, v in cells if c in df.columns and c != pos}
    names = list(dict.fromkeys(c for _, c in latest))
    if not latest:
        return df
    kinds = {c: df.schema[c].dataType for c in names}

    def fits(kind: T.DataType, v: Any) -> bool:
        if v is None or isinstance(kind, T.StringType):
            return True
        if isinstance(kind, T.NumericType):
            return isinstance(v, (int, float)) and not isinstance(v, bool) and (float(v).is_integer() or not isinstance(kind, T.IntegralType))
        return isinstance(kind, T.BooleanType) and isinstance(v, bool)

    as_text = {c for (_, c), v in latest.items() if not fits(kinds[c], v)}
    rows: dict[int, dict[str, Any]] = {}
    for (row, c), v in latest.items():
        rows.setdefault(row, {})[c] = v
    at, new_value = free_name(df, "at"), free_name(df, "new_value")
    fields = [x for i, _ in enumerate(names) for x in (T.StructField(f"set{i}", T.BooleanType()), T.StructField(f"v{i}", T.StringType()))]
    schema = T.StructType([T.StructField(at, T.LongType()), T.StructField(new_value, T.StructType(fields))])
    text = lambda v: None if v is None else str(v)
    changes = df.sparkSession.createDataFrame([(row, tuple(x for c in names for x in (c in own, text(own.get(c))))) for row, own in rows.items()], schema)
    met = df.join(changes, F.col(q(pos)) == F.col(at), "left")
    out = []
    for c in df.columns:
        if c not in names:
            out.append(F.col(q(c)))
            continue
        i = names.index(c)
        old = text_of(df, c) if c in as_text else F.col(q(c))
        new = F.col(new_value)[f"v{i}"] if c in as_text else F.col(new_value)[f"v{i}"].cast(kinds[c])
        out.append(F.when(F.col(new_value)[f"set{i}"], new).otherwise(old).alias(c))
    return met.select(*out)


def delete_rows(df: DataFrame, rows: Sequence[int], pos: str = "_row_pos") -> DataFrame:
    """Without the rows at these positions; the others are numbered anew in their order."""
    named = free_name(df, "gone")
    gone = df.sparkSession.createDataFrame([(int(r),) for r in set(rows)], f"{named} bigint")
    left = df.join(gone, F.col(q(pos)) == F.col(named), "left_anti").withColumn(named, F.lit(0))
    into = free_name(left, "rank")
    return ranked(left, [named], pos, into=into).withColumn(pos, F.col(into).cast("bigint") - 1).select(*[q(c) for c in df.columns])


def append_rows(df: DataFrame, rows: Sequence[Mapping[str, Any]], pos: str = "_row_pos") -> DataFrame:
    """New rows at the end; columns they don't name hold "" (null, where the type is no text)."""
    if not rows:
        return df
    n = df.agg(F.coalesce(F.max(q(pos)) + 1, F.lit(0)).cast("bigint")).first()[0]
    names = [c for c in df.columns if c != pos]
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("_at", T.LongType())])
    data = [(*[None if r.get(c, "") is None else str(r.get(c, "")) for c in names], n + i) for i, r in enumerate(rows)]
    new = df.sparkSession.createDataFrame(data, schema)
    cast = [(F.col(f"_c{i}") if isinstance(df.schema[c].dataType, T.StringType) else F.col(f"_c{i}").try_cast(df.schema[c].dataType)).alias(c) for i, c in enumerate(names)]
    return df.unionByName(new.select(*cast, F.col("_at").cast(df.schema[pos].dataType).alias(pos)))


def patch(df: DataFrame, p: Patch, pos: str = "_row_pos") -> DataFrame:
    df = change_columns(df, p.add_columns, [c for c in p.drop_columns if c != pos], p.rename_columns)
    df = update_cells(df, p.cells, pos)
    if p.delete_rows:
        df = delete_rows(df, p.delete_rows, pos)
    return append_rows(df, p.add_rows, pos)
