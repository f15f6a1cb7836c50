"""The register of queries: each a function of (spark, sf_dir), with its twin in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Two-table queries compare a table with an altered copy of itself: rows missing, amounts, case and dates changed.


def altered_orders(orders: DataFrame, cents: bool = False) -> DataFrame:
    """cents: amounts change by whole cents, for queries that show them as text."""
    k = F.col("o_orderkey")
    price = F.col("o_totalprice") + (k % 7 - 3) * F.lit(25.0) if cents else F.col("o_totalprice") * (F.lit(1.0) + (k % 7 - 3) * F.lit(0.00005))
    return orders.filter(k % 11 != 0).select(
        "o_orderkey", "o_custkey", F.lower("o_orderstatus").alias("o_orderstatus"), price.alias("o_totalprice"),
        (F.col("o_orderdate") + F.when(k % 5 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))).alias("o_orderdate"), F.when(k % 13 == 0, "9-NEW").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


ALTERED_ORDERS = """(SELECT o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus, o_totalprice * (1.0::DOUBLE + (o_orderkey % 7 - 3) * 0.00005::DOUBLE) AS o_totalprice,
    o_orderdate + CASE WHEN o_orderkey % 5 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS o_orderdate, CASE WHEN o_orderkey % 13 = 0 THEN '9-NEW' ELSE o_orderpriority END AS o_orderpriority
    FROM orders WHERE o_orderkey % 11 <> 0)"""
ALTERED_CENTS = ALTERED_ORDERS.replace("o_totalprice * (1.0::DOUBLE + (o_orderkey % 7 - 3) * 0.00005::DOUBLE) AS", "o_totalprice + (o_orderkey % 7 - 3) * 25.0::DOUBLE AS")
#: |a - b| within p per cent of |b|, in SQL.
WITHIN = "CASE WHEN {b} <> 0 THEN abs({a} - {b}) / abs({b}) * 100 <= {p} ELSE {a} = 0 END"


def within(a: str, b: str, p: float) -> str:
    return WITHIN.format(a=a, b=b, p=p)
