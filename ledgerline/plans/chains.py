"""Chained transformations, aggregate mappings, percentiles of groups, deep pages and matches with groups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.predicates import group_matches
from ..operators import engine, profile
from ..operators import transform as t
from ..operators.engine import Chain, Lookup, Numbering
from ..operators.percentiles import percentiles
from ..operators.transform import Check, ChosenRule, ColumnMap, Expansion, OutputColumn
from ..session import shared_folder
from ..sources.pages import Pages, write_pages
from .base import query, table


@query("""SELECT l_returnflag AS flag, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS amount, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS discount,
    count(DISTINCT l_suppkey) AS suppliers, min(l_quantity) AS least, max(l_quantity) AS most, round(median(l_extendedprice), 6) AS middle FROM lineitem GROUP BY 1, 2""")
def transform_aggregate(spark, d):
    """Row expressions beside aggregates of the rows that share them."""
    folded = lambda target, what, source: ColumnMap(target, "aggregate", source, what)
    out = t.map_columns(table(spark, d, "lineitem"), [
        ColumnMap("flag", "direct", "l_returnflag"), ColumnMap("amount", "conditional", condition="l_quantity > 25", value="many", other="few"),
        folded("n_rows", "count_rows", ""), folded("total", "sum", "l_extendedprice"), folded("discount", "average", "l_discount"), folded("suppliers", "count_distinct", "l_suppkey"),
        folded("least", "min", "l_quantity"), folded("most", "max", "lines.l_quantity"), folded("middle", "median", "l_extendedprice"),
    ])
    return out.withColumn("total", F.round("total", 2)).withColumn("discount", F.round("discount", 6)).withColumn("middle", F.round("middle", 6))


_CHAIN = Chain(
    mappings=[
        ColumnMap("number", "direct", "orders.o_orderkey"), ColumnMap("copy", "direct", "_expansion_index"), ColumnMap("customer", "direct", "customer_name"), ColumnMap("side", "direct", "side"),
        ColumnMap("share", "expression", formula="{total} * 2 if {side} == 'debit' else {total}", variables={"total": "o_totalprice", "side": "side"}), ColumnMap("day", "direct", "o_orderdate"),
    ],
    columns=[OutputColumn("number"), OutputColumn("copy"), OutputColumn("customer", text=True), OutputColumn("side", allowed=["debit", "credit"]), OutputColumn("share", decimals=1), OutputColumn("day", date_format="dd.MM.yyyy"), OutputColumn("note", default="-")],
    expansions=[ChosenRule("o_totalprice > 300000", Expansion("fixed", sets=[{"side": "debit"}, {"side": "debit"}, {"side": "other"}]), 1), ChosenRule("o_totalprice > 1", Expansion("fixed", sets=[{"side": "never"}]), 0, enabled=False), ChosenRule("", Expansion("fixed", sets=[{"side": "credit"}]), 2)],
    lookups=[Lookup("customers", "o_custkey", "c_custkey", "c_name", "customer_name", "unknown", "c_custkey")],
    checks=[Check("required", "customer"), Check("format", "side", "debit|credit", "error")],
)
_CHAIN_SQL = """SELECT o_orderkey AS number, copy::INT AS copy, coalesce(c_name, 'unknown') AS customer, side, o_totalprice, o_orderdate FROM (
    SELECT *, CASE WHEN o_totalprice > 300000 THEN CASE WHEN copy < 2 THEN 'debit' ELSE 'other' END ELSE 'credit' END AS side FROM orders, range(0, 3) r(copy) WHERE copy = 0 OR o_totalprice > 300000)
    LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey"""


def _sources(spark, d):
    return {"orders": table(spark, d, "orders"), "customers": table(spark, d, "customer").filter("c_custkey % 3 <> 0")}


@query(f"SELECT number, copy, customer, side, round((CASE side WHEN 'debit' THEN o_totalprice * 2 ELSE o_totalprice END)::DECIMAL(18, 2), 1)::DOUBLE AS share, strftime(o_orderdate, '%d.%m.%Y') AS day, '-' AS note FROM ({_CHAIN_SQL})")
def transform_engine(spark, d):
    """Expansion by rule, a lookup, mappings and formats in one plan."""
    return engine.run(_sources(spark, d), _CHAIN).rows


@query(f"""SELECT 'errors' AS kind, 'Missing required columns: note' AS message UNION ALL SELECT 'warnings', 'Column ''side'' contains values not in allowed list' FROM ({_CHAIN_SQL}) HAVING count(*) FILTER (side = 'other') > 0
    UNION ALL SELECT 'errors', 'Column ''side'' has ' || count(*) FILTER (side = 'other') || ' values not matching pattern' FROM ({_CHAIN_SQL}) HAVING count(*) FILTER (side = 'other') > 0""")
def transform_engine_findings(spark, d):
    found = engine.run(_sources(spark, d), _CHAIN).findings
    rows = [(k, m) for k in ("errors", "warnings") for m in found[k]]  # a few messages
    return spark.createDataFrame(rows, "kind string, message string")


@query("""SELECT 'P-' || lpad((10 * row_number() OVER (ORDER BY p_partkey))::VARCHAR, greatest(6, length((10 * row_number() OVER (ORDER BY p_partkey))::VARCHAR))::INT, '0') AS number, p_brand AS brand FROM part""")
def transform_engine_numbers(spark, d):
    chain = Chain([ColumnMap("number", "direct", "n"), ColumnMap("brand", "direct", "p_brand")], numberings=[Numbering("p_partkey", "n", 10, 10, "P-", "", 6)])
    return engine.run({"parts": table(spark, d, "part")}, chain).rows


@query("SELECT l_partkey, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY l_partkey")
def percentiles_by_group(spark, d):
    out = percentiles(table(spark, d, "lineitem"), ["l_partkey"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, count_as="n")
    return out.select("l_partkey", "n", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999 FROM lineitem GROUP BY l_returnflag")
def percentiles_of_large_groups(spark, d):
    """Groups that are narrowed by sketches before values are put in order."""
    out = percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "p999": 0.999}, large=1000)
    return out.select("l_returnflag", F.round("p25", 6).alias("p25"), F.round("p999", 6).alias("p999"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey DESC, l_linenumber, l_partkey LIMIT 50 OFFSET 49950")
def page_deep(spark, d):
    """Page 1000, from a table laid out in order."""
    path = f"{shared_folder(spark)}/ledgerline-pages-{uuid.uuid4().hex}"
    write_pages(table(spark, d, "lineitem"), [F.desc("l_orderkey"), "l_linenumber", "l_partkey"], path)
    return Pages(spark, path).page(1000, 50, ["l_orderkey", "l_linenumber", "l_partkey"])


_ENDS = r"([bdfgk])([aeiou]+)([a-z]*)[.!?]"


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_ENDS}', 0, 'i') AS m, regexp_extract_all(text, '{_ENDS}', 1, 'i') AS a, regexp_extract_all(text, '{_ENDS}', 3, 'i') AS z, regexp_split_to_array(text, '{_ENDS}', 'i') AS gaps FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, i::INT AS match_no, m[i] AS match, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS "index", length(m[i])::INT AS length, a[i] AS first, z[i] AS rest
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM t)""")
def regex_groups(spark, d):
    """Every match in every text, with its groups and place."""
    docs = table(spark, d, "documents")
    each = docs.select("doc_id", F.posexplode(group_matches(F.col("text"), _ENDS, None)).alias("at", "m"))
    return each.select("doc_id", (F.col("at") + 1).alias("match_no"), "m.match", "m.index", "m.length", F.col("m.groups")[0].alias("first"), F.col("m.groups")[2].alias("rest"))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS data_type, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, {size.format(c=c)}::BIGINT AS memory_bytes FROM documents"
    for c, k, size in (("doc_id", "bigint", "8 * count({c})"), ("text", "string", "coalesce(sum(strlen({c})), 0)"), ("lang", "string", "coalesce(sum(strlen({c})), 0)"), ("source", "string", "coalesce(sum(strlen({c})), 0)"))
))
def column_types_and_memory(spark, d):
    return profile.storage(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))
