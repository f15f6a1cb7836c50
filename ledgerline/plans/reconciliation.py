"""Reconciliation, closest matches, filters and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Extract, Filter, Pattern, extracted, filtered, pattern_column, shared_characters, value_filtered
from ..operators import closest, recon
from ..operators.recon import Rule
from .base import ALTERED_ORDERS, altered_orders, query, table, within

# ------------------------------------------------------------- matching orders

RULES = [Rule("o_orderkey", "o_orderkey"), Rule("o_orderstatus", "o_orderstatus"), Rule("o_totalprice", "o_totalprice", "tolerance", 0.01)]
_PAIRS = f"""SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN {ALTERED_ORDERS} b ON a.o_orderkey = b.o_orderkey
    AND lower(a.o_orderstatus) = lower(b.o_orderstatus) AND {within("a.o_totalprice", "b.o_totalprice", 0.01)}"""


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders")
    return orders, altered_orders(orders)


def _orders(spark, d) -> recon.Reconciled:
    a, b = _sides(spark, d)
    keep = ["o_orderkey", "o_totalprice"]
    return recon.reconcile(a, b, RULES, "o_orderkey", "o_orderkey", selected_a=keep, selected_b=keep)


@query(f"WITH p AS ({_PAIRS}) SELECT a.o_orderkey AS \"FileA_o_orderkey\", a.o_orderstatus AS \"FileA_o_orderstatus\", a.o_totalprice AS \"FileA_o_totalprice\", b.o_orderkey AS \"FileB_o_orderkey\", b.o_orderstatus AS \"FileB_o_orderstatus\", b.o_totalprice AS \"FileB_o_totalprice\" FROM p JOIN orders a ON a.o_orderkey = a_key JOIN {ALTERED_ORDERS} b ON b.o_orderkey = b_key")
def recon_one_to_many(spark, d):
    return _orders(spark, d).matched


@query(f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT a_key FROM ({_PAIRS}))")
def recon_unmatched_a(spark, d):
    return _orders(spark, d).unmatched_a


@query(f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM {ALTERED_ORDERS} WHERE o_orderkey NOT IN (SELECT b_key FROM ({_PAIRS}))")
def recon_unmatched_b(spark, d):
    return _orders(spark, d).unmatched_b


_PCT = "round(CASE WHEN {w} > 0 THEN {p} / {w} * 100 ELSE 0.0 END, 2)"


@query(f"""WITH n AS (SELECT (SELECT count(*) FROM orders) AS total_a, (SELECT count(*) FROM {ALTERED_ORDERS}) AS total_b, (SELECT count(*) FROM ({_PAIRS})) AS matched)
    SELECT total_a, total_b, matched, total_a - matched AS unmatched_a, total_b - matched AS unmatched_b, {_PCT.format(p="matched", w="greatest(total_a, total_b)")} AS match_percentage,
    {_PCT.format(p="matched", w="total_a")} AS match_rate_a, {_PCT.format(p="matched", w="total_b")} AS match_rate_b, {_PCT.format(p="2 * matched", w="(total_a + total_b)")} AS completeness FROM n""")
def recon_summary(spark, d):
    a, b = _sides(spark, d)
    return recon.summary(a, b, recon.match_pairs(a, b, RULES, "o_orderkey", "o_orderkey"))


# a key that rows share: customers' orders of a year with returned items of the same date

_LINES = "(SELECT l_orderkey * 8 + l_linenumber AS line, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1)"


def _lines(spark, d) -> DataFrame:
    """One line of each number of an order, with an id."""
    line = table(spark, d, "lineitem")
    first = line.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")).alias("r"))
    return first.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_orderkey", "l_linenumber", "r.*")


_A_LINES, _B_LINES = f"(SELECT * FROM {_LINES} WHERE l_returnflag = 'A')", f"(SELECT * FROM {_LINES} WHERE l_returnflag <> 'A')"
_SUPP_PAIRS = f"SELECT a.line AS a_pos, b.line AS b_pos FROM {_A_LINES} a JOIN {_B_LINES} b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey"
_LINE_RULES = [Rule("l_partkey", "l_partkey"), Rule("l_suppkey", "l_suppkey")]


def _line_pairs(spark, d, mode, rules=None, **how):
    lines = _lines(spark, d)
    a, b = lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag <> 'A'")
    return recon.match_pairs(a, b, rules or _LINE_RULES, "line", "line", mode, **how)


@query(_SUPP_PAIRS)
def recon_many_to_many(spark, d):
    return _line_pairs(spark, d, "many_to_many")


@query(f"SELECT a_pos, min(b_pos) AS b_pos FROM ({_SUPP_PAIRS}) GROUP BY a_pos")
def recon_one_to_many_shared_keys(spark, d):
    return _line_pairs(spark, d, "one_to_many")


@query(f"SELECT min(a_pos) AS a_pos, b_pos FROM ({_SUPP_PAIRS}) GROUP BY b_pos")
def recon_many_to_one(spark, d):
    return _line_pairs(spark, d, "many_to_one")


@query(f"""SELECT a.line AS a_pos, b.line AS b_pos FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY line) AS r FROM {_A_LINES}) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY line) AS r FROM {_B_LINES}) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.r = b.r""")
def recon_one_to_one(spark, d):
    return _line_pairs(spark, d, "one_to_one")


@query()
def recon_one_to_one_tolerance(spark, d):
    """Greedy; tests compare it with plain Python."""
    return _line_pairs(spark, d, "one_to_one", [Rule("l_partkey", "l_partkey"), Rule("l_extendedprice", "l_extendedprice", "tolerance", 20.0)])


_STEPS = "(SELECT o_orderkey, o_orderstatus, step, row_number() OVER (PARTITION BY o_orderstatus, step ORDER BY o_orderkey) AS n FROM (SELECT *, floor(o_totalprice / 10000) AS step FROM orders) WHERE o_orderkey % 2 = {side})"


@query(f"SELECT a.o_orderkey AS a_pos, b.o_orderkey AS b_pos FROM {_STEPS.format(side=0)} a JOIN {_STEPS.format(side=1)} b ON a.o_orderstatus = b.o_orderstatus AND a.step = b.step AND a.n = b.n")
def recon_one_to_one_hot_key(spark, d):
    """Three keys of very many rows each, which amounts part into pieces."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.floor(F.col("o_totalprice") / 10000) * 10000 + 5000 + k % 3).alias("amount"))
    return recon.match_pairs(o.filter(k % 2 == 0), o.filter(k % 2 == 1), [Rule("o_orderstatus", "o_orderstatus"), Rule("amount", "amount", "tolerance", 0.5)], "o_orderkey", "o_orderkey", "one_to_one")


@query(f"""SELECT a.c_custkey AS a_pos, b.s_suppkey AS b_pos FROM customer a JOIN supplier b ON {within("a.c_acctbal", "b.s_acctbal", 0.5)}""")
def recon_tolerance_only(spark, d):
    """No key at all: a join on logarithmic buckets instead of all pairs."""
    return recon.match_pairs(table(spark, d, "customer"), table(spark, d, "supplier"), [Rule("c_acctbal", "s_acctbal", "tolerance", 0.5)], "c_custkey", "s_suppkey", "many_to_many")


@query(f"SELECT a.o_orderkey AS a_pos, b.o_orderkey AS b_pos FROM orders a JOIN {ALTERED_ORDERS} b ON a.o_orderkey = b.o_orderkey AND {within('a.o_totalprice', 'b.o_totalprice', 0.005)}")
def recon_positional(spark, d):
    a, b = _sides(spark, d)
    return recon.match_pairs(a, b, [Rule("o_totalprice", "o_totalprice", "tolerance", 0.005)], "o_orderkey", "o_orderkey", positional=True)


@query(f"SELECT a.o_orderkey AS a_pos, b.o_orderkey AS b_pos FROM orders a JOIN {ALTERED_ORDERS} b ON a.o_orderkey = b.o_orderkey AND CAST(a.o_orderdate AS DATE) = CAST(b.o_orderdate AS DATE)")
def recon_date_equals(spark, d):
    a, b = _sides(spark, d)
    k = F.col("o_orderkey")
    # the copy writes its dates in three ways
    text = F.when(k % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k % 3 == 1, F.date_format("o_orderdate", "dd-MMM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    b = b.withColumn("o_orderdate", text)
    return recon.match_pairs(a, b, [Rule("o_orderkey", "o_orderkey"), Rule("o_orderdate", "o_orderdate", "date_equals")], "o_orderkey", "o_orderkey")


_FUZZY = "len(list_filter(string_split({a}, ''), lambda c: c <> '' AND contains({b}, c))) / greatest(length({a}), length({b}))"


@query(f"SELECT p_partkey, round(s, 4) AS share FROM (SELECT p_partkey, {_FUZZY.format(a='lower(p_name)', b='lower(p_type)')} AS s FROM part) WHERE s >= 0.3")
def recon_fuzzy_chars(spark, d):
    part = table(spark, d, "part").withColumn("share", shared_characters(F.lower("p_name"), F.lower("p_type")))
    return part.filter("share >= 0.3").select("p_partkey", F.round("share", 4).alias("share"))


@query(f"SELECT a.p_partkey AS a_pos, b.p_partkey AS b_pos FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND {_FUZZY.format(a='a.p_name', b='b.p_name')} >= 0.7")
def recon_fuzzy_rule(spark, d):
    part = table(spark, d, "part")
    rules = [Rule("p_brand", "p_brand"), Rule("p_size", "p_size"), Rule("p_name", "p_name", "fuzzy", 0.7)]
    return recon.match_pairs(part, part, rules, "p_partkey", "p_partkey", "many_to_many")


# ------------------------------------------------------ filters and extraction


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') AND c_acctbal > 1000 AND c_acctbal < 8000 AND lower(c_name) <> 'customer#000000001' AND regexp_matches(c_name, '[02468]$')")
def recon_filters(spark, d):
    filters = [Filter("c_mktsegment", "in", "Building, machinery"), Filter("c_acctbal", "greater_than", 1000), Filter("c_acctbal", "less_than", "8000"), Filter("c_name", "not_equals", "CUSTOMER#000000001"), Filter("c_name", "contains", "[02468]$")]
    return filtered(table(spark, d, "customer"), filters).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_brand) = 'brand#2' AND p_size = 11")
def recon_filter_equals(spark, d):
    return filtered(table(spark, d, "part"), [Filter("p_brand", "equals", "BRAND#2"), Filter("p_size", "equals", 11)]).select("p_partkey", "p_name", "p_brand")


_TREE = Pattern(operator="AND", conditions=[Pattern(patterns=["token", "secret", "password"]), Pattern(pattern=r"[0-9]{3}")])


@query(r"SELECT doc_id, nullif(regexp_extract(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', 0), '') AS email, regexp_matches(coalesce(text, ''), '(?i)token|secret|password') AND regexp_matches(coalesce(text, ''), '[0-9]{3}') AS sensitive FROM documents")
def recon_extract_regex(spark, d):
    docs = table(spark, d, "documents")
    out = extracted(docs, [Extract("email", "text", [r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"])])
    return out.select("doc_id", "email", pattern_column(F.col("text"), _TREE).alias("sensitive"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN printf('%.2f', o_totalprice) WHEN o_orderkey % 4 = 1 THEN (floor(o_totalprice)::BIGINT)::VARCHAR END AS amount FROM orders")
def recon_extract_amount(spark, d):
    k = F.col("o_orderkey")
    note = F.when(k % 4 == 0, F.concat(F.lit("Amount: $"), F.format_string("%.2f", "o_totalprice"))).when(k % 4 == 1, F.concat(F.lit("total: "), F.floor("o_totalprice"))).when(k % 4 == 2, "paid €0").otherwise("no figure")
    return extracted(table(spark, d, "orders").select(k, note.alias("note")), [Extract("amount", "note")]).select("o_orderkey", "amount")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE trim(o_orderpriority) IN ('1-URGENT', '2-HIGH') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1997-05-01' AND DATE '1997-05-04'")
def delta_filtered(spark, d):
    """A date given in another format than the column's text finds its rows as a date."""
    orders = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return value_filtered(orders, [("o_orderpriority", ["1-URGENT", " 2-HIGH "]), ("day", [f"{day:02d}/05/1997" for day in range(1, 5)]), ("nowhere", ["x"])]).select("o_orderkey", "o_orderpriority")


# --------------------------------------------------------------- closest match

_NEAR = "greatest(0.0, 100.0 - abs(a.c_acctbal - b.s_acctbal) / abs(b.s_acctbal) * 100)"
_NUM = f"CASE WHEN a.c_acctbal = b.s_acctbal THEN 100.0 WHEN b.s_acctbal = 0 THEN 0.0 ELSE {_NEAR} END"
_PICK = "row_number() OVER (PARTITION BY c_custkey ORDER BY s < 99.5, CASE WHEN s >= 99.5 THEN 0 ELSE -s END, s_suppkey)"


@query(f"""WITH s AS (SELECT c_custkey, s_suppkey, {_NUM} AS s FROM customer a, supplier b), r AS (SELECT *, {_PICK} AS n FROM s WHERE s > 30)
    SELECT c.c_custkey, round(coalesce(r.s, 0.0), 2) AS closest_match_score, 's_suppkey: ' || r.s_suppkey || '; s_name: ' || x.s_name || '; s_nationkey: ' || x.s_nationkey AS closest_match_record
    FROM customer c LEFT JOIN r ON c.c_custkey = r.c_custkey AND n = 1 LEFT JOIN supplier x ON x.s_suppkey = r.s_suppkey""")
def closest_numeric(spark, d):
    """All customers against all suppliers: the comparison is every pair by definition."""
    a, b = table(spark, d, "customer"), table(spark, d, "supplier")
    out = closest.closest(a, b, [("c_acctbal", "s_acctbal")], "c_custkey", "s_suppkey", kinds={"c_acctbal": "numeric"}, native=True, max_comparisons=10**12)
    return out.select("c_custkey", "closest_match_score", "closest_match_record")


_GAP = "abs(datediff('day', a.day, b.day))"
_DATE = f"CASE WHEN {_GAP} = 0 THEN 100.0::DOUBLE WHEN {_GAP} = 1 THEN 95.0::DOUBLE WHEN {_GAP} <= 7 THEN 95.0::DOUBLE - ({_GAP} - 1) * 5.0::DOUBLE WHEN {_GAP} <= 30 THEN greatest(0.0::DOUBLE, 65.0::DOUBLE - ({_GAP} - 7) * 2.8::DOUBLE) ELSE 0.0::DOUBLE END"


@query(f"""WITH a AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority <> '1-URGENT'),
    s AS (SELECT a.o_orderkey, b.o_orderkey AS t, {_DATE} AS s FROM a JOIN b ON a.o_custkey = b.o_custkey), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY s < 99.5, CASE WHEN s >= 99.5 THEN 0 ELSE -s END, t) AS n FROM s WHERE s > 30)
    SELECT a.o_orderkey, round(coalesce(r.s, 0.0), 2) AS closest_match_score FROM a LEFT JOIN r ON a.o_orderkey = r.o_orderkey AND n = 1""")
def closest_date_exact_prefilter(spark, d):
    """Customers have to match exactly, which makes it an equi-join."""
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    a, b = orders.filter("o_orderpriority = '1-URGENT'"), orders.filter("o_orderpriority <> '1-URGENT'")
    out = closest.closest(a, b, [("day", "day")], "o_orderkey", "o_orderkey", exact=[("o_custkey", "o_custkey")], kinds={"day": "date"}, native=True)
    return out.select("o_orderkey", "closest_match_score")


@query()
def closest_text(spark, d):
    """Text similarity has no SQL; tests compare it with plain Python."""
    part = table(spark, d, "part")
    a, b = part.filter("p_type = 'SMALL'"), part.filter("p_type <> 'SMALL'").withColumn("p_name", F.concat("p_name", F.lit(" "), F.lower("p_type")))
    out = closest.closest(a, b, [("p_name", "p_name"), ("p_retailprice", "p_retailprice")], "p_partkey", "p_partkey", exact=[("p_brand", "p_brand"), ("p_size", "p_size")])
    return out.select("p_partkey", "closest_match_score", "closest_match_record", "closest_match_details")
