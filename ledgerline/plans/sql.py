"""Ad-hoc SQL over named tables, run through the read-only surface; the twin is the same question in DuckDB's dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sqlsurface
from ..operators.percentiles import percentiles
from .base import ORACLE_SQL, QUERIES, query, table


def _sql(name: str, tables: list[str], text: str, oracle: str) -> None:
    def run(spark, d):
        return sqlsurface.run(sqlsurface.open_tables([table(spark, d, t) for t in tables]), text)

    run.__name__ = run.__qualname__ = name
    QUERIES[name], ORACLE_SQL[name] = run, oracle


def _same(name: str, tables: list[str], text: str) -> None:
    """A text that both dialects read alike."""
    oracle = text
    for i, t in enumerate(tables, 1):
        oracle = oracle.replace(f"file_{i}", t)
    _sql(name, tables, text, oracle)


_same("sql_join_agg", ["orders", "customer"], "SELECT c_mktsegment, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS mean FROM file_1 JOIN file_2 ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus")
_same("sql_left_join_missing", ["customer", "orders"], "SELECT c_custkey, c_name FROM file_1 LEFT JOIN file_2 ON c_custkey = o_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL")
_same("sql_full_outer", ["supplier", "customer"], "SELECT s_nationkey, c_nationkey, count(*) AS n FROM (SELECT DISTINCT s_nationkey FROM file_1 WHERE s_acctbal > 5000) a FULL OUTER JOIN (SELECT DISTINCT c_nationkey FROM file_2 WHERE c_acctbal > 9000) b ON s_nationkey = c_nationkey GROUP BY s_nationkey, c_nationkey")
_same("sql_semi_anti", ["customer", "orders"], "SELECT c_custkey FROM file_1 WHERE EXISTS (SELECT 1 FROM file_2 WHERE o_custkey = c_custkey AND o_totalprice > 450000) AND NOT EXISTS (SELECT 1 FROM file_2 WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_same("sql_tolerance_join", ["orders", "lineitem"], "SELECT o_orderkey, l_linenumber, l_extendedprice FROM file_1 JOIN file_2 ON o_orderkey = l_orderkey AND abs(o_totalprice - l_extendedprice) <= 1000")
_same("sql_running_total", ["orders"], "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM file_1")
_same("sql_rank_topn", ["orders"], "SELECT o_custkey, o_orderkey, r, dr FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM file_1) t WHERE r <= 3")
_same("sql_lag_change", ["orders"], "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS change, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order FROM file_1")
_same("sql_moving_average", ["orders"], "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM file_1")
_same("sql_percentile", ["lineitem"], "SELECT l_returnflag, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS median, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p90, round(stddev_samp(l_extendedprice), 4) AS std FROM file_1 GROUP BY l_returnflag")
_same("sql_conditional_agg", ["lineitem"], "SELECT l_linestatus, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM file_1 WHERE l_quantity BETWEEN 10 AND 40 GROUP BY l_linestatus")
_same("sql_cube", ["lineitem"], "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM file_1 GROUP BY CUBE (l_returnflag, l_linestatus)")
_same("sql_rollup", ["orders"], "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM file_1 GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_same("sql_grouping_sets", ["orders"], "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g, count(*) AS n FROM file_1 GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_same("sql_except_intersect", ["customer", "supplier"], "SELECT 'both' AS kind, c_nationkey AS nation FROM (SELECT c_nationkey FROM file_1 WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM file_2) t UNION ALL SELECT 'customers only', c_nationkey FROM (SELECT c_nationkey FROM file_1 EXCEPT SELECT s_nationkey FROM file_2 WHERE s_acctbal > 5000) u")
_same("sql_set_operations_all", ["customer", "supplier"], "SELECT c_nationkey AS nation, count(*) AS n FROM (SELECT c_nationkey FROM file_1 EXCEPT ALL SELECT s_nationkey FROM file_2) t GROUP BY c_nationkey")
_same("sql_cte_recon", ["orders", "lineitem"], "WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS lines FROM file_2 GROUP BY l_orderkey), j AS (SELECT o_orderkey, o_totalprice, lines, CASE WHEN lines IS NULL THEN 'no lines' WHEN abs(o_totalprice - lines) <= 0.1 * o_totalprice THEN 'near' ELSE 'apart' END AS state FROM file_1 LEFT JOIN l ON o_orderkey = l_orderkey) SELECT state, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM j GROUP BY state")
_same("sql_scalar_text", ["customer"], "SELECT c_custkey, upper(trim(c_name)) AS a, replace(lower(c_mktsegment), 'b', 'x') AS b, substring(c_name, 10, 5) AS c, CAST(length(c_name) AS BIGINT) AS d, CAST(position('#' IN c_name) AS BIGINT) AS e, concat(c_name, '/', c_mktsegment) AS f, c_name || '!' AS g, CAST(levenshtein(c_mktsegment, 'BUILDING') AS BIGINT) AS h, nullif(c_mktsegment, 'BUILDING') AS i, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'none') AS j FROM file_1")
_same("sql_quoted_names", ["nation"], 'SELECT n_name AS "Nation Name", count(*) AS "how many" FROM file_1 GROUP BY n_name')
_same("sql_scalar_subquery", ["part"], "SELECT p_partkey, p_retailprice FROM file_1 WHERE p_retailprice > (SELECT avg(p_retailprice) FROM file_1) AND p_size IN (SELECT max(p_size) FROM file_1)")
_same("sql_theta_join", ["region", "nation"], "SELECT r_regionkey, n_nationkey FROM file_1 JOIN file_2 ON r_regionkey < n_regionkey")
_same("sql_top_n", ["customer"], "SELECT c_custkey, c_acctbal FROM file_1 ORDER BY c_acctbal DESC, c_custkey LIMIT 15")

_sql("sql_dates", ["orders"], "SELECT o_orderkey, CAST(date_part('year', o_orderdate) AS BIGINT) AS y, CAST(date_part('month', o_orderdate) AS BIGINT) AS m, date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM-dd') AS first_day, days_between(DATE '2001-01-01', CAST(o_orderdate AS DATE)) AS days, date_format(strptime('31/12/2000', '%d/%m/%Y'), 'yyyy-MM-dd') AS parsed FROM file_1",
     "SELECT o_orderkey, date_part('year', o_orderdate) AS y, date_part('month', o_orderdate) AS m, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day, datediff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01')::INT AS days, strftime(strptime('31/12/2000', '%d/%m/%Y'), '%Y-%m-%d') AS parsed FROM orders")
_sql("sql_regex", ["customer"], "SELECT c_custkey, regexp_replace_first(c_name, '0', 'x') AS first_zero, regexp_replace(c_name, '0', 'x') AS all_zeros, regexp_find(c_name, '[1-9][0-9]*$') AS digits, regexp_matches(c_name, '7$') AS seven, c_name LIKE '%5_' AS like_five, element_at(split_text(c_name, '#'), 2) AS part FROM file_1",
     "SELECT c_custkey, regexp_replace(c_name, '0', 'x') AS first_zero, regexp_replace(c_name, '0', 'x', 'g') AS all_zeros, regexp_extract(c_name, '[1-9][0-9]*$') AS digits, regexp_matches(c_name, '7$') AS seven, c_name LIKE '%5_' AS like_five, string_split(c_name, '#')[2] AS part FROM customer")
_sql("sql_casts", ["orders"], "SELECT o_orderkey, try_cast(o_orderpriority AS INT) AS bad, try_cast(substring(o_orderpriority, 1, 1) AS INT) AS good, round(safe_divide(o_totalprice, CAST(o_orderkey % 3 AS DOUBLE)), 4) AS share, abs(-o_totalprice) AS size FROM file_1",
     "SELECT o_orderkey, try_cast(o_orderpriority AS INT) AS bad, try_cast(substring(o_orderpriority, 1, 1) AS INT) AS good, round(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / (o_orderkey % 3) END, 4) AS share, abs(-o_totalprice) AS size FROM orders")
_sql("sql_json", ["events"], "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM file_1 WHERE CAST(get_json_object(props, '$.k') AS BIGINT) > 90",
     "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90")
_sql("sql_arrays", ["embeddings"], "SELECT vec_id, size(embedding) AS n, round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + x * x), 3) AS norm, size(filter(embedding, x -> x > 0)) AS positive FROM file_1",
     "SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 3) AS norm, len(list_filter(embedding, lambda x: x > 0))::INT AS positive FROM embeddings")
_sql("sql_pivot", ["orders"], "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM file_1) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
     "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
_sql("sql_unpivot", ["part"], "SELECT * FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM file_1) UNPIVOT (amount FOR kind IN (size, price))",
     "SELECT p_partkey, 'size' AS kind, p_size::DOUBLE AS amount FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
_sql("sql_mode", ["lineitem"], "SELECT l_returnflag, mode(l_linenumber, true) AS line FROM file_1 GROUP BY l_returnflag",
     "SELECT l_returnflag, arg_min(l_linenumber, (-n, l_linenumber)) AS line FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
_sql("sql_quick_ratio", ["part"], "SELECT p_brand, max(similarity(p_name, p_name)) AS same FROM file_1 GROUP BY p_brand", "SELECT p_brand, 100.0::DOUBLE AS same FROM part GROUP BY p_brand")


@query(ORACLE_SQL["sql_percentile"])
def sql_percentile(spark, d):
    """The same question by the operator: in SQL one task would hold all distinct values of a group, once for each percentile."""
    lines = table(spark, d, "lineitem")
    spread = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.stddev_samp("l_extendedprice"), 4).alias("std"))
    out = percentiles(lines, ["l_returnflag"], "l_extendedprice", {"median": 0.5, "p90": 0.9}).join(spread, F.col("l_returnflag").eqNullSafe(F.col("flag")))
    return out.select("l_returnflag", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"), "std")
