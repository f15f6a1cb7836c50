"""Tables from files: CSV as text columns, Excel sheets, JSON and Parquet; what is checked before a file is read."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import Report, clean, with_row_pos
from . import workbook

MAX_FILE_BYTES = 100 * 1024 * 1024
EXTENSIONS = (".csv", ".xlsx", ".xls", ".json", ".parquet")


def extension(path: str) -> str:
    found = re.search(r"\.[A-Za-z0-9]+$", path.rstrip("/"))
    return found.group().lower() if found else ""


def checked(spark: SparkSession, path: str, most: int | None = MAX_FILE_BYTES) -> int:
    """The bytes below a path, in any store that Spark reads; an error for unknown kinds and for more than `most`."""
    if extension(path) not in EXTENSIONS:
        raise ValueError(f"{path}: not one of {', '.join(EXTENSIONS)}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    if most is not None and size > most:
        raise ValueError(f"{path}: {size} bytes, more than {most}")
    return size


def read_csv(spark: SparkSession, path: str, positions: bool = False, multiline: bool = True, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, as they are written; blank lines are passed over. positions: add _row_pos.

    multiline: quoted values may hold line breaks, which keeps a file in one task; switch it off for large files.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, quote='"', escape='"', sep=delimiter, encoding=encoding, enforceSchema=False)
    df = with_row_pos(df) if positions else df
    named = [c for c in df.columns if c != "_row_pos"]
    some = F.lit(False)
    for c in named:
        some = some | F.col(f"`{c}`").isNotNull()
    return df.filter(some)


def excel_sheets(spark: SparkSession, path: str) -> list[str]:
    return [s["sheet"] for s in workbook.sheets(spark, path)]


def excel_info(spark: SparkSession, path: str) -> list[dict]:
    """Of each sheet its name, columns and number of rows."""
    return [{k: s[k] for k in ("sheet", "columns", "rows")} for s in workbook.sheets(spark, path)]


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet (the first by default) as text columns, and _row_pos. The older .xls format needs a library that pandas knows."""
    if extension(path) == ".xlsx":
        return workbook.read_sheet(spark, path, sheet)
    import pandas as pd

    pdf = pd.read_excel(path, sheet_name=sheet or 0, dtype=str)
    pdf.insert(0, "_row_pos", range(len(pdf)))
    schema = "_row_pos bigint" + "".join(f", `{c}` string" for c in pdf.columns[1:])
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema)


@dataclass
class Ingested:
    data: DataFrame
    report: Report


def ingest(spark: SparkSession, path: str, sheet: str | None = None, most: int | None = MAX_FILE_BYTES, **how) -> Ingested:
    """Check, read and clean a file."""
    checked(spark, path, most)
    kind = extension(path)
    if kind == ".csv":
        raw = read_csv(spark, path, **how)
    elif kind in (".xlsx", ".xls"):
        raw = read_excel(spark, path, sheet)
    elif kind == ".json":
        raw = spark.read.json(path, **how)
    else:
        raw = spark.read.parquet(path)
    return Ingested(*clean(raw))


def squeezed(df: DataFrame, column: str) -> DataFrame:
    """Runs of white space become one space; what is left of up to 3 characters becomes empty."""
    c = F.trim(F.regexp_replace(F.col(f"`{column}`"), r"\s+", " "))
    return df.withColumn(column, F.when(F.length(c) <= 3, "").otherwise(c))
