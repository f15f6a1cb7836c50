"""Exports: CSV, JSON lines, Parquet and Excel, of one table or of result sets put together."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import finite, union_all
from ..session import shared_folder
from . import workbook

FORMATS = ("csv", "json", "parquet", "excel")


def combined(results: Mapping[str, DataFrame], label: str = "Result_Type") -> DataFrame:
    """All result sets below each other, named in `label`."""
    return union_all(list(results.values()), label, list(results))


def export(df: DataFrame, path: str, kind: str = "csv", one_file: bool = False) -> None:
    """Write a table below `path`. one_file: through one task, for tables small enough to be opened by hand."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    if kind == "excel":
        export_excel({"Data": df}, path)
        return
    writer = (df.coalesce(1) if one_file else df).write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True, escape='"', nullValue="", emptyValue="")
    elif kind == "json":
        finite(df).write.mode("overwrite").json(path, ignoreNullFields=False)
    else:
        writer.parquet(path)


def counts(results: Mapping[str, DataFrame]) -> DataFrame:
    """A summary sheet: the rows of each result set and its share of all in per cent."""
    each = union_all([d.agg(F.count("*").alias("Count")) for d in results.values()], "Category", list(results))
    total = each.agg(F.sum("Count").alias("_total"))
    share = F.round(F.when(F.col("_total") > 0, F.col("Count") / F.greatest("_total", F.lit(1)) * 100).otherwise(F.lit(0.0)), 2)
    return each.crossJoin(total).select("Category", "Count", share.alias("Percentage"))  # one row on the right


def export_excel(sheets: Mapping[str, DataFrame], path: str, summary: bool = True, metadata: Mapping[str, Any] | None = None) -> None:
    """A workbook: a Summary of the tables if there are several, a sheet for each, and a Metadata sheet of given facts.

    Sheets follow the order of their tables' partitions. A table that one sheet doesn't hold goes on in further ones.
    """
    tables = dict(sheets)
    if summary and len(tables) > 1:
        tables = {"Summary": counts(sheets)} | tables
    if metadata is not None:
        tables["Metadata"] = workbook.metadata_sheet(next(iter(sheets.values())).sparkSession, metadata)
    workbook.write_book(tables, path, shared_folder(next(iter(sheets.values())).sparkSession))
