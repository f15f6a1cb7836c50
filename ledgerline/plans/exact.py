"""Exact identifiers and decimals, places of matches, field checks and further filters, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validators as v
from ..functions.predicates import Filter, all_matches, filtered
from ..operators import closest, delta, ingest, recon, transform
from ..operators.delta import Compare, Key
from ..operators.recon import Rule
from .base import query, table, within


@query("""SELECT o_orderkey AS "FileA_o_orderkey", CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS "FileB_o_orderkey", CASE WHEN o_orderkey % 3 = 0 THEN 'DELETED' ELSE 'UNCHANGED' END AS "Delta_Type" FROM orders""")
def delta_long_keys(spark, d):
    """Account numbers of 20 digits as text; the newer side writes them with zeros around."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit("12345678901"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("account"))
    newer = o.filter("o_orderkey % 3 <> 0").withColumn("account", F.concat(F.lit("00"), "account", F.lit(".0")))
    out = delta.classified(o, newer, [Key("account", "account")], [Compare("o_totalprice", "o_totalprice")])
    return out.select("FileA_o_orderkey", "FileB_o_orderkey", "Delta_Type")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 THEN 'AMENDED' ELSE 'UNCHANGED' END AS "Delta_Type", ((o_orderkey % 2 = 1)::INT + (o_orderkey % 3 = 0)::INT) AS n_changes FROM orders""")
def delta_exact_numbers(spark, d):
    """Whole numbers and texts of 17 digits that differ in the last one."""
    k = F.col("o_orderkey")
    older = table(spark, d, "orders").select("o_orderkey", (F.lit(12345678901234560) + k * 10).alias("amount"), F.concat(F.lit("1234567890"), F.lpad(k.cast("string"), 9, "0"), F.lit("1")).alias("said"))
    newer = older.withColumn("amount", F.col("amount") + k % 2).withColumn("said", F.when(k % 3 == 0, F.regexp_replace("said", "1$", "2")).otherwise(F.col("said")))
    out = delta.classified(older, newer, [Key("o_orderkey", "o_orderkey")])
    return out.select(F.col("FileA_o_orderkey").alias("o_orderkey"), "Delta_Type", F.coalesce("Total_Changes", F.lit(0)).alias("n_changes"))


@query("SELECT o_orderkey AS a_pos, o_orderkey AS b_pos FROM orders WHERE o_orderkey % 2 = 0")
def recon_decimal_equals(spark, d):
    """Decimals that differ behind the sixth place are different."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey").cast("decimal(38,8)") + F.lit("0.12345678").cast("decimal(38,8)")).cast("decimal(38,8)").alias("amount"))
    b = o.withColumn("amount", F.when(F.col("o_orderkey") % 2 == 0, F.col("amount")).otherwise(F.col("amount") + F.lit("0.00000021").cast("decimal(38,8)")).cast("decimal(38,8)"))
    return recon.match_pairs(o, b, [Rule("o_orderkey", "o_orderkey"), Rule("amount", "amount")], "o_orderkey", "o_orderkey")


@query("SELECT o_orderkey, '123456789012' || lpad(o_orderkey::VARCHAR, 8, '0') AS account, o_custkey FROM orders")
def types_long_digits(spark, d):
    """Identifiers that a double cannot hold stay text beside columns that become numbers."""
    o = table(spark, d, "orders")
    return ingest.typed(o.select("o_orderkey", F.concat(F.lit("123456789012"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("account"), F.col("o_custkey").cast("string").alias("o_custkey")))


@query("SELECT p_partkey, 'ab:4:6,ab:' || (8 + length(p_partkey::VARCHAR)) || ':' || (10 + length(p_partkey::VARCHAR)) AS places FROM part")
def regex_matches_positions(spark, d):
    """A pattern whose matches depend on what surrounds them."""
    part = table(spark, d, "part")
    found = all_matches(F.concat(F.lit("cab ab "), F.col("p_partkey").cast("string"), F.lit(" ab")), r"\bab\b")
    said = F.transform(found, lambda m: F.concat_ws(":", m["match"], m["start"], m["end"]))
    return part.select("p_partkey", F.array_join(said, ",").alias("places"))


@query("""WITH c AS (SELECT o_orderkey, lpad((o_orderkey * 7919)::VARCHAR, 8, '0') || CASE WHEN o_orderkey % 3 = 0 THEN 'x' WHEN o_orderkey % 3 = 1 THEN 'K' ELSE '' END AS code FROM orders)
    SELECT o_orderkey, regexp_full_match(code, '[0-9A-Z]{9}') AS cusip, regexp_full_match(substr(code, 1, CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 6 END), '[0-9A-Z]{7}') AS sedol,
    regexp_full_match(code, '[0-9A-Z]{9}') AS field_valid, CASE WHEN regexp_full_match(code, '[0-9A-Z]{9}') THEN '' ELSE 'Invalid CUSIP format' END AS field_said FROM c""")
def validate_codes(spark, d):
    k = F.col("o_orderkey")
    code = F.concat(F.lpad((k * 7919).cast("string"), 8, "0"), F.when(k % 3 == 0, "x").when(k % 3 == 1, "K").otherwise(""))
    o = table(spark, d, "orders").select("o_orderkey", code.alias("code"))
    o = o.withColumn("field", v.validate_field("cusip", F.col("code")))
    return o.select("o_orderkey", v.valid_cusip(F.col("code")).alias("cusip"), v.valid_sedol(F.substring("code", F.lit(1), F.when(k % 2 == 0, 7).otherwise(6))).alias("sedol"), F.col("field.is_valid").alias("field_valid"), F.col("field.message").alias("field_said"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1234.5 WHEN 1 THEN 1250.75 WHEN 2 THEN 1234567.0 WHEN 3 THEN 12.5 WHEN 4 THEN 1234.0 END AS amount, o_orderkey % 6 <> 5 AS is_valid,
    CASE WHEN o_orderkey % 6 = 5 THEN 'Invalid amount format' ELSE '' END AS message FROM orders""")
def validate_amounts(spark, d):
    """Both ways to write separators: the last one, or a lone one before one or two digits, is the decimal mark."""
    said = F.element_at(F.array(*map(F.lit, ["EUR 1.234,50", "$1,250.75", "1.234.567", "12,5", "1,234", "none"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", v.extract_amount(said).alias("amount"), v.validate_field("amount", said).alias("field"))
    return o.select("o_orderkey", "amount", "field.is_valid", "field.message")


@query(f"""WITH p AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM part), m AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND {within("a.p_retailprice", "b.p_retailprice", 3.0)} AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1)
    SELECT a AS a_pos, b AS b_pos FROM m""")
def recon_mixed_rules(spark, d):
    part = table(spark, d, "part")
    rules = [Rule("p_brand", "p_brand"), Rule("p_size", "p_size"), Rule("p_retailprice", "p_retailprice", "tolerance", 3.0)]
    return recon.match_pairs(part.filter("p_partkey % 2 = 0"), part.filter("p_partkey % 2 = 1"), rules, "p_partkey", "p_partkey", "many_to_many")


@query("""WITH a AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer), s AS (SELECT c_custkey, s_suppkey, c_nationkey = s_nationkey AS same, CASE WHEN c_acctbal = s_acctbal THEN 100.0 WHEN s_acctbal = 0 THEN 0.0 ELSE greatest(0.0, 100.0 - abs(c_acctbal - s_acctbal) / abs(s_acctbal) * 100) END AS s FROM a, supplier),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY NOT same, s < 99.5, CASE WHEN s >= 99.5 THEN 0 ELSE -s END, s_suppkey) AS n FROM s WHERE s > 30)
    SELECT a.c_custkey, round(coalesce(r.s, 0.0), 2) AS closest_match_score FROM a LEFT JOIN r ON a.c_custkey = r.c_custkey AND n = 1""")
def closest_fallback(spark, d):
    """Suppliers of the customer's nation first; customers without a likely one are compared with all."""
    a, b = table(spark, d, "customer"), table(spark, d, "supplier")
    out = closest.closest_with_fallback(a, b, [("c_acctbal", "s_acctbal")], "c_custkey", "s_suppkey", [("c_nationkey", "s_nationkey")], kinds={"c_acctbal": "numeric"}, native=True, max_comparisons=10**12)
    return out.select("c_custkey", "closest_match_score")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS number, o_orderkey AS rank, o_custkey AS slice, o_orderkey % 3 AS within FROM orders")
def sequence_beside_clashing_names(spark, d):
    """Columns named like the operator's own helpers stay what they are."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("rank"), F.col("o_custkey").alias("slice"), (F.col("o_orderkey") % 3).alias("within"))
    return transform.sequence(o, "rank", "number").withColumn("number", F.col("number").cast("bigint"))


_LONG = "SELECT o_orderkey, o_orderkey * 1000000007 + 12345678901234567 AS long_key, o_totalprice FROM orders"


@query(f"SELECT * FROM ({_LONG}) WHERE long_key > 12345678901234567 + 40 * 1000000007::BIGINT AND long_key < 12345678901234568 + 90 * 1000000007::BIGINT AND long_key <> 12345678901234567 + 50 * 1000000007::BIGINT")
def filter_long_numbers(spark, d):
    """Numbers over 2**53, told apart in their last digit."""
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 1000000007 + 12345678901234567).alias("long_key"), "o_totalprice")
    at = lambda k: 12345678901234567 + k * 1000000007
    return filtered(orders, [Filter("long_key", "greater_than", at(40)), Filter("long_key", "less_than", at(90) + 1), Filter("long_key", "not_equals", at(50))])


@query("SELECT c_custkey, 'none' AS looked_up FROM customer")
def lookup_mixed_types(spark, d):
    """A number is no text: keys of another type find nothing."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), "n_name")
    return transform.lookup(table(spark, d, "customer"), nations, "c_nationkey", "code", "n_name", "looked_up", "none").select("c_custkey", "looked_up")


@query("""SELECT o_orderkey AS "FileA_o_orderkey", CASE WHEN o_orderkey % 5 IN (1, 2) THEN 'AMENDED' ELSE 'UNCHANGED' END AS "Delta_Type" FROM orders""")
def delta_wide_digits(spark, d):
    """Texts of 30 digits that differ in the last one, and decimals that differ behind the twelfth place."""
    o, k = table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey")
    end = lambda at: F.when(k % 5 == at, "8").otherwise("7")
    side = lambda one, two: o.select("o_orderkey", F.concat(F.lit("123456789012345678901"), F.lpad(k.cast("string"), 8, "0"), end(one)).alias("wide"), F.concat(F.lit("0.123456789012345"), end(two)).alias("fine"))
    changes = delta.classified(side(9, 9), side(1, 2), [Key("o_orderkey", "o_orderkey")], [Compare("wide", "wide"), Compare("fine", "fine", "numeric_tolerance")])
    return changes.select("FileA_o_orderkey", "Delta_Type")
