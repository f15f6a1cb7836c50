"""Delta queries: orders against their altered copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delta
from ..operators.delta import Compare, Key
from .base import ALTERED_CENTS, altered_orders, query, table

KEYS = [Key("o_orderkey", "o_orderkey")]
COMPARES = [Compare("o_orderstatus", "o_orderstatus", "case_insensitive"), Compare("o_totalprice", "o_totalprice", "numeric_tolerance", 0.01), Compare("o_orderpriority", "o_orderpriority"), Compare("o_orderdate", "o_orderdate", "date_equals")]
_NUM = "CASE WHEN {x} = floor({x}) THEN ({x})::BIGINT::VARCHAR ELSE regexp_replace(printf('%.6f', {x}), '\\.?0+$', '') END"
_CHANGES = f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, a.o_orderkey AS ak, b.o_orderkey AS bk, list_filter([
    CASE WHEN lower(a.o_orderstatus) <> lower(b.o_orderstatus) THEN 'o_orderstatus: ''' || a.o_orderstatus || ''' -> ''' || b.o_orderstatus || '''' END,
    CASE WHEN abs(a.o_totalprice - b.o_totalprice) / abs(b.o_totalprice) * 100 > 0.01 THEN 'o_totalprice: ''' || {_NUM.format(x='a.o_totalprice')} || ''' -> ''' || {_NUM.format(x='b.o_totalprice')} || '''' END,
    CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 'o_orderpriority: ''' || a.o_orderpriority || ''' -> ''' || b.o_orderpriority || '''' END,
    CASE WHEN CAST(a.o_orderdate AS DATE) <> CAST(b.o_orderdate AS DATE) THEN 'o_orderdate: ''' || strftime(a.o_orderdate, '%Y-%m-%d') || ''' -> ''' || strftime(b.o_orderdate, '%Y-%m-%d') || '''' END], lambda x: x IS NOT NULL) AS changes
    FROM orders a FULL OUTER JOIN (SELECT * FROM {ALTERED_CENTS} UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 50 = 0) b ON a.o_orderkey = b.o_orderkey"""
_TYPE = "CASE WHEN bk IS NULL THEN 'DELETED' WHEN ak IS NULL THEN 'NEWLY_ADDED' WHEN len(changes) = 0 THEN 'UNCHANGED' ELSE 'AMENDED' END"


def _classified(spark, d, **how):
    orders = table(spark, d, "orders")
    added = orders.filter("o_orderkey % 50 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10000000)
    newer = altered_orders(orders, cents=True).unionByName(added)
    return delta.classified(orders, newer, KEYS, COMPARES, **how)


@query(f"SELECT ak AS \"FileA_o_orderkey\", bk AS \"FileB_o_orderkey\", {_TYPE} AS \"Delta_Type\" FROM ({_CHANGES})")
def delta_classify(spark, d):
    return _classified(spark, d).select("FileA_o_orderkey", "FileB_o_orderkey", "Delta_Type")


@query(f"SELECT k AS o_orderkey, array_to_string(changes[1:5], '; ') AS \"Changes\", len(changes)::INT AS \"Total_Changes\" FROM ({_CHANGES}) WHERE {_TYPE} = 'AMENDED'")
def delta_amended_changes(spark, d):
    return delta.categories(_classified(spark, d))["amended"].select(F.col("FileA_o_orderkey").alias("o_orderkey"), "Changes", "Total_Changes")


@query(f"SELECT k AS o_orderkey, {_TYPE} AS \"Delta_Type\", CASE WHEN bk IS NULL THEN 'Record deleted from newer file' WHEN ak IS NULL THEN 'New record added in newer file' ELSE array_to_string(changes[1:5], '; ') END AS \"Changes\" FROM ({_CHANGES}) WHERE {_TYPE} <> 'UNCHANGED'")
def delta_all_changes(spark, d):
    return delta.categories(_classified(spark, d))["all_changes"].select(F.coalesce("FileA_o_orderkey", "FileB_o_orderkey").alias("o_orderkey"), "Delta_Type", "Changes")


_R = "round({x} / total_records * 100, 2)"


@query(f"""SELECT *, {_R.format(x='unchanged')} AS stability_percentage, {_R.format(x='amended')} AS amendment_rate, {_R.format(x='deleted')} AS deletion_rate, {_R.format(x='newly_added')} AS addition_rate, {_R.format(x='(amended + deleted + newly_added)')} AS overall_change_rate
    FROM (SELECT count(*) FILTER (t = 'UNCHANGED') AS unchanged, count(*) FILTER (t = 'AMENDED') AS amended, count(*) FILTER (t = 'DELETED') AS deleted, count(*) FILTER (t = 'NEWLY_ADDED') AS newly_added, count(*) AS total_records FROM (SELECT {_TYPE} AS t FROM ({_CHANGES})))""")
def delta_summary(spark, d):
    return delta.summary(_classified(spark, d))


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def delta_duplicates(spark, d):
    return delta.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 3 <> 0) WHERE n = 1)
    SELECT a.o_orderkey AS "FileA_o_orderkey", b.o_orderkey AS "FileB_o_orderkey", CASE WHEN b.o_custkey IS NULL THEN 'DELETED' WHEN a.o_custkey IS NULL THEN 'NEWLY_ADDED' WHEN round(a.o_totalprice, 2) = round(b.o_totalprice, 2) THEN 'UNCHANGED' ELSE 'AMENDED' END AS "Delta_Type" FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey""")
def delta_first_of_duplicates(spark, d):
    """Keys of text and of numbers meet: the older side's customer is text with leading zeros."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    older = orders.withColumn("o_custkey", F.lpad(F.col("o_custkey").cast("string"), 12, "0"))
    out = delta.classified(older, orders.filter("o_orderkey % 3 <> 0"), [Key("o_custkey", "o_custkey")], [Compare("o_totalprice", "o_totalprice")], "o_orderkey", "o_orderkey")
    return out.select("FileA_o_orderkey", "FileB_o_orderkey", "Delta_Type")


@query("""SELECT a.p_partkey AS p_partkey, CASE WHEN a.p_partkey % 4 = 0 OR a.p_partkey % 6 = 0 THEN 'AMENDED' ELSE 'UNCHANGED' END AS "Delta_Type", (CASE WHEN a.p_partkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN a.p_partkey % 6 = 0 THEN 1 ELSE 0 END) AS n_changes FROM part a""")
def delta_auto_rules(spark, d):
    part = table(spark, d, "part")
    newer = part.withColumn("p_size", F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("p_brand", F.when(F.col("p_partkey") % 6 == 0, F.lit(None)).otherwise(F.col("p_brand")))
    out = delta.classified(part, newer, [Key("p_partkey", "p_partkey")])
    return out.select(F.col("FileA_p_partkey").alias("p_partkey"), "Delta_Type", F.coalesce("Total_Changes", F.lit(0)).alias("n_changes"))
