"""Tables laid out in an order, so that a page is read from the row groups it lies in, however deep it is.

A table is sorted once, by ranges, and written with a place for each row: the number of its range and its number there. An
index holds how many rows each range has. A page asks the index for its ranges, and the scan for the places between.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import free_name, q, require

#: monotonically_increasing_id puts the partition's number above this many bits of the row's number.
BITS = 33
MOST_ROWS = 1000
ROW_GROUP_BYTES = 8 << 20


def write_pages(df: DataFrame, order: str | Column | Sequence[str | Column], path: str) -> None:
    """Lay the table out under `path`, a new folder, in the order of columns (names, or F.desc("name")).

    Rows that are equal in the order follow a hash of the whole row, so a value that many rows share is split among ranges.
    The index is written last: without it there is no table.
    """
    given = [order] if isinstance(order, (str, Column)) else list(order)
    require(df, [o for o in given if isinstance(o, str)], "the table")
    by = [F.col(q(o)) if isinstance(o, str) else o for o in given] + [F.xxhash64(*[F.col(q(c)) for c in df.columns])]
    place = free_name(df, "place")
    laid = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(place, F.monotonically_increasing_id())
    laid.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/rows")
    back = df.sparkSession.read.parquet(f"{path}/rows")
    counts = back.groupBy(F.shiftright(F.col(place), BITS).alias("part")).agg(F.count("*").alias("rows"))
    first = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    counts.select("part", "rows", first.alias("first"), F.lit(place).alias("place")).coalesce(1).write.parquet(f"{path}/index")


class Pages:
    """A table that write_pages laid out."""

    def __init__(self, spark: SparkSession, path: str):
        self.table, self.index = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/index")
        self.place = self.table.columns[-1]

    def count(self) -> int:
        return self.index.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def page(self, number: int = 1, size: int = 100, columns: Sequence[str] | None = None, most: int = MOST_ROWS) -> DataFrame:
        """Page `number` (from 1) in the table's order; a page has `most` rows at most, one beyond the end has none."""
        size = max(1, min(size, most))
        begin = (max(number, 1) - 1) * size
        ranges = self.index.filter((F.col("first") < begin + size) & (F.col("first") + F.col("rows") > begin)).collect()  # at most `size` ranges
        at = F.col(q(self.place))
        spans = [((r["part"] << BITS) + max(begin - r["first"], 0), (r["part"] << BITS) + min(begin + size - r["first"], r["rows"]) - 1) for r in ranges]
        here = self.table.filter(reduce(or_, [(at >= a) & (at <= z) for a, z in spans]) if spans else F.lit(False)).orderBy(at)
        return here.select(*[q(c) for c in columns]) if columns is not None else here.drop(self.place)
