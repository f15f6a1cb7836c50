"""Transformation, expansion, lookups and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transform as t
from ..operators.transform import Case, Check, ColumnMap, Expansion, Output, OutputColumn, Rule
from .base import query, table

_CUSTOMER = Rule("r1", [
    Output("customer_id", "direct", "c_custkey"),
    Output("label", "static", value="{c_name} of {c_mktsegment}"),
    Output("with_bonus", "static", value="round({c_acctbal} * 1.1 + abs(-5), 4)"),
    Output("fixed", "static", value="n/a"),
    Output("missing", "direct", "no_such_column"),
    Output("tier", "dynamic", cases=[Case("c_acctbal", ">=", "5,000", "VIP {c_custkey}"), Case("c_acctbal", ">=", 1000, "Premium"), Case("c_mktsegment", "startsWith", "BUILD", "Builder")], default="Basic"),
])


@query("""SELECT c_custkey AS customer_id, c_name || ' of ' || c_mktsegment AS label, round(c_acctbal * 1.1::DOUBLE + 5.0::DOUBLE, 4) AS with_bonus, 'n/a' AS fixed, '' AS missing,
    CASE WHEN c_acctbal >= 5000 THEN 'VIP ' || c_custkey WHEN c_acctbal >= 1000 THEN 'Premium' WHEN starts_with(c_mktsegment, 'BUILD') THEN 'Builder' ELSE 'Basic' END AS tier FROM customer""")
def transform_direct_static_dynamic(spark, d):
    return t.transform(table(spark, d, "customer"), [_CUSTOMER])["merged"]


@query("""SELECT p_partkey AS part, round(p_retailprice * 0.9::DOUBLE, 2) AS net, round(round(p_retailprice * 0.9::DOUBLE, 2) * p_size, 2) AS stock, CASE WHEN round(round(p_retailprice * 0.9::DOUBLE, 2) * p_size, 2) > 20000 THEN 'large' ELSE 'small' END AS class FROM part""")
def transform_chained(spark, d):
    """Later columns read earlier ones."""
    rule = Rule("r", [Output("part", "direct", "p_partkey"), Output("net", "static", value="round({p_retailprice} * 0.9, 2)"), Output("stock", "static", value="round({net} * {p_size}, 2)"), Output("class", "dynamic", cases=[Case("stock", ">", "20000", "large")], default="small")])
    return t.transform(table(spark, d, "part"), [rule])["merged"]


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier")
def transform_union_sources(spark, d):
    """Two sources below each other, one rule over both."""
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return t.transform([a, b], [Rule("r", [Output(c, "direct", c) for c in ("kind", "id", "name", "balance")])])["merged"]


@query("SELECT 'a' AS rule, o_orderkey FROM orders UNION ALL SELECT 'b' AS rule, o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def transform_two_rules_with_condition(spark, d):
    rules = [Rule("a", [Output("rule", "static", value="a"), Output("o_orderkey", "direct", "o_orderkey")]), Rule("b", [Output("rule", "static", value="b"), Output("o_orderkey", "direct", "o_orderkey")], condition="o_totalprice > 300000 and o_orderstatus == 'F'"), Rule("c", [Output("rule", "static", value="c")], enabled=False)]
    return t.transform(table(spark, d, "orders"), rules, honor_condition=True)["merged"]


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 THEN 'yes' ELSE 'no' END AS chosen, length(c_name)::DOUBLE AS name_length, CASE WHEN c_acctbal > 5000 THEN round(c_acctbal / 2, 4) ELSE round(-c_acctbal, 2) END AS part, round(fmod(c_custkey::DOUBLE, 7.0::DOUBLE), 2) AS rest FROM customer")
def transform_formulas(spark, d):
    """The formula grammar: calls, conditional expressions, membership, arithmetic."""
    maps = [
        ColumnMap("c_custkey", "direct", "customers.c_custkey"),
        ColumnMap("chosen", "conditional", condition="c_mktsegment in ['BUILDING', 'MACHINERY'] and c_acctbal > 0", value="yes", other="no"),
        ColumnMap("name_length", "expression", formula="len({n})", variables={"n": "c_name"}),
        ColumnMap("part", "expression", formula="round(c_acctbal / 2, 4) if c_acctbal > 5000 else round(-c_acctbal, 2)"),
        ColumnMap("rest", "expression", formula="round(c_custkey % 7, 2)"),
    ]
    return t.map_columns(table(spark, d, "customer"), maps)


@query("SELECT n_nationkey, n_name, unnest(range(0, 3))::INT AS _expansion_index FROM nation")
def expand_duplicate(spark, d):
    return t.expand(table(spark, d, "nation"), Expansion("duplicate", count=3)).select("n_nationkey", "n_name", "_expansion_index")


@query("SELECT n_nationkey, unnest(['Q1', 'Q2', 'Q3', 'Q4']) AS quarter FROM nation")
def expand_from_list(spark, d):
    return t.expand(table(spark, d, "nation"), Expansion("from_list", column="quarter", values=["Q1", "Q2", "Q3", "Q4"])).select("n_nationkey", "quarter")


@query("SELECT n_nationkey, CASE e WHEN 0 THEN 'debit' ELSE 'credit' END AS side, CASE e WHEN 0 THEN n_name ELSE 'other' END AS n_name FROM nation, range(0, 2) r(e)")
def expand_fixed(spark, d):
    return t.expand(table(spark, d, "nation"), Expansion("fixed", sets=[{"side": "debit"}, {"side": "credit", "n_name": "other"}])).select("n_nationkey", "side", "n_name")


@query("SELECT c_custkey, unnest(CASE WHEN c_acctbal > 5000 THEN ['a', 'b'] ELSE ['c'] END) AS share FROM customer")
def expand_conditional(spark, d):
    return t.expand(table(spark, d, "customer"), Expansion("conditional", condition="c_acctbal > 5000", sets=[{"share": "a"}, {"share": "b"}], other=[{"share": "c"}])).select("c_custkey", "share")


@query("SELECT s_suppkey, p.l_partkey, (row_number() OVER (PARTITION BY s_suppkey ORDER BY p.l_partkey) - 1)::INT AS _expansion_index FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 49) p ON s_suppkey = l_suppkey")
def expand_from_table(spark, d):
    parts = table(spark, d, "lineitem").filter("l_quantity > 49").select("l_suppkey", "l_partkey").distinct()
    return t.expand_from_table(table(spark, d, "supplier"), parts, [("s_suppkey", "l_suppkey")], ["l_partkey"], "l_partkey").select("s_suppkey", "l_partkey", "_expansion_index")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN e ELSE 0 END AS _expansion_index FROM orders, range(0, 2) r(e) WHERE o_totalprice > 400000 OR e = 0")
def expand_by_rule(spark, d):
    rules = [t.ChosenRule("o_totalprice > 400000", Expansion("duplicate", count=2)), t.ChosenRule("o_totalprice > 300000", Expansion("duplicate", count=1), priority=1)]
    out = t.expand_by_rule(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), rules)
    return out.select("o_orderkey", F.col("_expansion_index").cast("bigint").alias("_expansion_index"))


@query("SELECT c_custkey, coalesce(f.o_orderpriority, 'none') AS first_priority FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) f ON c_custkey = o_custkey")
def lookup_default(spark, d):
    orders = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    return t.lookup(table(spark, d, "customer"), orders, "c_custkey", "o_custkey", "o_orderpriority", "first_priority", "none", "o_orderkey").select("c_custkey", "first_priority")


@query("SELECT o_orderkey, 'ORD-' || lpad((100 + 5 * (row_number() OVER (ORDER BY o_orderkey) - 1))::VARCHAR, greatest(8, length((100 + 5 * (row_number() OVER (ORDER BY o_orderkey) - 1))::VARCHAR))::INT, '0') || '/A' AS number FROM orders")
def sequence_padded(spark, d):
    return t.sequence(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "number", 100, 5, "ORD-", "/A", 8)


@query("SELECT c_custkey, round(c_acctbal::DECIMAL(18, 2), 1)::DOUBLE AS c_acctbal, 'x' AS note, c_mktsegment FROM customer")
def format_output(spark, d):
    return t.formatted(table(spark, d, "customer"), [OutputColumn("c_custkey"), OutputColumn("c_acctbal", decimals=1), OutputColumn("note", default="x"), OutputColumn("c_mktsegment", text=True)])


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS o_orderdate FROM orders")
def format_dates(spark, d):
    return t.formatted(table(spark, d, "orders"), [OutputColumn("o_orderkey"), OutputColumn("o_orderdate", date_format="dd.MM.yyyy")])


@query("""SELECT 'errors' AS kind, 'Column ''lang'' has ' || count(*) FILTER (lang IS NULL) || ' null values' AS message FROM documents HAVING count(*) FILTER (lang IS NULL) > 0
    UNION ALL SELECT 'warnings', 'Column ''source'' has ' || count(*) FILTER (NOT regexp_matches(coalesce(source, 'nan'), '^(?:src[0-4]$)')) || ' values not matching pattern' FROM documents HAVING count(*) FILTER (NOT regexp_matches(coalesce(source, 'nan'), '^(?:src[0-4]$)')) > 0""")
def validate_rules(spark, d):
    found = t.validate(table(spark, d, "documents"), [OutputColumn("doc_id")], [Check("required", "lang"), Check("format", "source", "src[0-4]$", "warning")])
    rows = [(k, m) for k in ("errors", "warnings") for m in found[k]]  # a few messages
    return spark.createDataFrame(rows, "kind string, message string")
