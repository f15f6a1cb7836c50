"""Profiles, quality, search, cleaning, edits, identifiers and catalogues."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import validators as v
from ..functions.canon import day_of, text_of
from ..operators import catalog, edits, ingest, profile
from ..operators.edits import Patch
from ..session import shared_folder
from ..sources import files, sinks
from ..sources.store import Store
from .base import query, table

# ------------------------------------------------------------- profile, quality

_COLS = [("c_custkey", "bigint", True), ("c_name", "string", False), ("c_nationkey", "int", True), ("c_acctbal", "double", True), ("c_mktsegment", "string", False)]
_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS data_type, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS null_percentage, count(DISTINCT {c}) AS distinct_count, "
    + (f"min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}), 6) AS mean_value" if n else "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS mean_value") + " FROM customer"
    for c, k, n in _COLS
)


@query(_PROFILE)
def profile_columns(spark, d):
    return profile.column_profile(table(spark, d, "customer")).withColumn("mean_value", F.round("mean_value", 6))


_STATS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, median({c}) AS median, max({c}) AS max, count(*) - count({c}) AS null_count FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount"))


@query(_STATS)
def stats_median_std(spark, d):
    out = profile.statistics(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("SELECT (SELECT count(*) FROM events) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS duplicate_rows")
def quality_duplicates(spark, d):
    return profile.duplicate_rows(table(spark, d, "events").select("user_id", "event_type"))


@query("SELECT count(*) AS rows, 0::BIGINT AS null_rows, 'nothing' AS null_columns, 'mixed' AS mixed_columns, count(*) - count(DISTINCT (s_nationkey, CASE WHEN s_suppkey % 10 = 0 THEN 'n/a' ELSE s_nationkey::VARCHAR END)) AS duplicate_rows FROM supplier")
def quality_mixed_numeric(spark, d):
    s = table(spark, d, "supplier")
    mixed = F.when(F.col("s_suppkey") % 10 == 0, "n/a").otherwise(F.col("s_nationkey").cast("string"))
    return profile.quality(s.select("s_nationkey", mixed.alias("mixed"), F.lit(None).cast("string").alias("nothing")))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(p_partkey::VARCHAR, 'red')")
def search_all_columns(spark, d):
    return profile.search(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "RED")


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'furniture') AND c_nationkey IN (3, 7)")
def column_filters(spark, d):
    return profile.column_filtered(table(spark, d, "customer"), {"c_mktsegment": "Building, furniture", "c_nationkey": "3,7"}).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("SELECT DISTINCT p_name AS value FROM part WHERE p_brand IN ('Brand#2', 'Brand#4') AND p_size = 11 ORDER BY 1 LIMIT 1000")
def cascading_distinct(spark, d):
    return profile.distinct_values(table(spark, d, "part"), "p_name", {"p_brand": ["Brand#2", "Brand#4"], "p_size": [11], "p_name": ["ignored"]})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_rows(spark, d):
    orders = table(spark, d, "orders").withColumn("down", -F.col("o_totalprice"))
    return profile.page(orders, ["down", "o_orderkey"], 3, 20, ["o_orderkey", "o_totalprice"])


@query("SELECT 'c' AS kind, count(*) AS n FROM customer UNION ALL SELECT 's', count(*) FROM supplier")
def union_with_label(spark, d):
    both = profile.union_all([table(spark, d, "customer").select("c_name"), table(spark, d, "supplier").select("s_name")], "kind", ["c", "s"])
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN value > 5 THEN NULL ELSE value END AS value FROM (SELECT event_id, value FROM events)")
def sanitize_numbers(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("value") > 5, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"))
    return profile.finite(e)


# --------------------------------------------------------------------- cleaning


@query("SELECT 'code' AS column_name")
def leading_zero_detect(spark, d):
    c = table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"), F.col("c_acctbal").cast("string").alias("amount"), F.lit("0").alias("zero"), "c_name")
    return spark.createDataFrame([(x,) for x in ingest.leading_zero_columns(c)], "column_name string")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus <> 'P'")
def drop_empty_rows_and_columns(spark, d):
    o, keep = table(spark, d, "orders"), (F.col("o_orderkey") % 7 != 0) & (F.col("o_orderstatus") != "P")
    return ingest.drop_empty(o.select(F.when(keep, F.col("o_orderkey")).alias("o_orderkey"), F.when(keep, F.col("o_orderstatus")).otherwise("  ").alias("o_orderstatus"), F.lit(None).cast("string").alias("nothing"), F.lit("  ").alias("blank")))


@query("SELECT count(*) AS rows, 3::BIGINT AS columns, count(*) FILTER (o_orderkey % 7 = 0) AS empty_rows, 1::BIGINT AS empty_columns, round(count(*) FILTER (o_orderkey % 7 = 0) / count(*) * 100, 2) AS empty_row_share, 33.33::DOUBLE AS empty_column_share FROM orders")
def cleanup_report(spark, d):
    o, keep = table(spark, d, "orders"), F.col("o_orderkey") % 7 != 0
    return ingest.cleanup_counts(o.select(F.when(keep, F.col("o_orderkey")).alias("k"), F.when(keep, F.col("o_orderstatus")).otherwise(" ").alias("s"), F.lit(None).cast("string").alias("nothing")))


@query("SELECT p_partkey, p_name FROM part")
def trim_values(spark, d):
    return ingest.trim_values(table(spark, d, "part").select("p_partkey", F.concat(F.lit(" \t"), "p_name", F.lit("\n ")).alias("p_name")))


@query("SELECT l_orderkey, l_quantity::BIGINT AS l_quantity, l_discount FROM lineitem")
def ints_preserve(spark, d):
    return ingest.whole_numbers(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def dates_normalise(spark, d):
    k, x = F.col("o_orderkey") % 6, F.col("o_orderdate")
    shown = F.when(k == 0, F.date_format(x, "dd/MM/yyyy")).when(k == 1, F.date_format(x, "MMM d, yyyy")).when(k == 2, F.date_format(x, "yyyy/MM/dd HH:mm")).when(k == 3, F.date_format(x, "d-MMM-yyyy")).when(k == 4, F.date_format(x, "yyyyMMdd")).otherwise("unknown")
    return ingest.normalize_dates(table(spark, d, "orders").select("o_orderkey", shown.alias("day")), ["day"])


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def types_from_text(spark, d):
    o = table(spark, d, "orders")
    return ingest.typed(o.select(text_of(o, "o_orderkey").alias("o_orderkey"), F.format_string("%.2f", "o_totalprice").alias("o_totalprice"), "o_orderstatus"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_texts(spark, d):
    """Two-digit years and the order of day and month."""
    return table(spark, d, "orders").select("o_orderkey", day_of(F.date_format("o_orderdate", "dd/MM/yy")).alias("day"))


# ------------------------------------------------------------------------ edits

_PATCH = Patch(add_columns=["note"], drop_columns=["n_regionkey"], rename_columns={"n_name": "name"}, cells=[(1, "name", "CHANGED"), (3, "note", "seen"), (3, "n_nationkey", 33)], delete_rows=[0, 4], add_rows=[{"name": "NEW"}, {"name": "NEWER", "note": "n"}])


@query("""SELECT * FROM (SELECT CASE WHEN n_nationkey = 3 THEN 33 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_nationkey = 1 THEN 'CHANGED' ELSE n_name END AS name, CASE WHEN n_nationkey = 3 THEN 'seen' ELSE '' END AS note, row_number() OVER (ORDER BY n_nationkey) - 1 AS _row_pos FROM nation WHERE n_nationkey NOT IN (0, 4))
    UNION ALL SELECT NULL, 'NEW', '', count(*) - 2 FROM nation UNION ALL SELECT NULL, 'NEWER', 'n', count(*) - 1 FROM nation""")
def edit_patch(spark, d):
    nation = table(spark, d, "nation").withColumn("_row_pos", F.col("n_nationkey").cast("bigint"))
    return edits.patch(nation, _PATCH)


# ------------------------------------------------------------------ identifiers

#: Countries of the made-up identifiers, in both twins.
_KNOWN = ["US", "GB", "DE", "FR"]


def _isins(orders):
    n = F.col("o_orderkey")
    country = F.element_at(F.array(*map(F.lit, [*_KNOWN, "ZZ"])), (n % 5 + 1).cast("int"))
    return orders.select(n, F.concat(country, F.lpad((n * 7919).cast("string"), 9, "0"), (n % 10).cast("string")).alias("isin"))


_ISIN_SQL = """WITH c AS (SELECT o_orderkey, ['US', 'GB', 'DE', 'FR', 'ZZ'][(o_orderkey % 5 + 1)::INT] || lpad((o_orderkey * 7919)::VARCHAR, 9, '0') || (o_orderkey % 10)::VARCHAR AS isin FROM orders),
    g AS (SELECT *, reverse(array_to_string(list_transform(string_split(substr(isin, 1, 11), ''), lambda c: CASE WHEN regexp_matches(c, '[A-Z]') THEN (ascii(c) - 55)::VARCHAR ELSE c END), '')) AS r FROM c),
    s AS (SELECT *, list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)::INT) AS n FROM g),
    t AS (SELECT *, list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (n[i] * 2) // 10 + (n[i] * 2) % 10 ELSE n[i] END)) AS coded, list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN i % 2 = 1 THEN (n[i] * 2) // 10 + (n[i] * 2) % 10 ELSE n[i] END)) AS standard FROM s)
    SELECT o_orderkey, isin, substr(isin, 1, 2) <> 'ZZ' AND (10 - coded % 10) % 10 = substr(isin, 12, 1)::INT AS valid_as_coded, substr(isin, 1, 2) <> 'ZZ' AND (10 - standard % 10) % 10 = substr(isin, 12, 1)::INT AS valid_by_standard FROM t"""


@query(_ISIN_SQL)
def validate_isin(spark, d):
    out = _isins(table(spark, d, "orders"))
    return out.select("o_orderkey", "isin", v.valid_isin(F.col("isin"), _KNOWN).alias("valid_as_coded"), v.valid_isin(F.col("isin"), _KNOWN, standard=True).alias("valid_by_standard"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'EUR 1.234,50 for TRD' || o_orderkey WHEN 1 THEN 'paid $1,234.56 on 12/31/2023' WHEN 2 THEN '£99,5 to ACC' || o_orderkey WHEN 3 THEN 'ref REF77 at 2024-01-05' ELSE 'nothing here' END AS note FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' END AS currency, CASE o_orderkey % 5 WHEN 2 THEN 99.5 WHEN 1 THEN 1234.56 WHEN 0 THEN 1234.5 WHEN 3 THEN 77.0 END AS amount,
    CASE o_orderkey % 5 WHEN 1 THEN '12/31/2023' WHEN 3 THEN '2024-01-05' END AS day, CASE o_orderkey % 5 WHEN 0 THEN 'TRD' || o_orderkey WHEN 3 THEN 'REF77' END AS trade, CASE o_orderkey % 5 WHEN 2 THEN 'ACC' || o_orderkey END AS account FROM t""")
def extract_currency_amount(spark, d):
    k = F.col("o_orderkey")
    note = F.when(k % 5 == 0, F.concat(F.lit("EUR 1.234,50 for TRD"), k)).when(k % 5 == 1, "paid $1,234.56 on 12/31/2023").when(k % 5 == 2, F.concat(F.lit("£99,5 to ACC"), k)).when(k % 5 == 3, "ref REF77 at 2024-01-05").otherwise("nothing here")
    t = table(spark, d, "orders").select("o_orderkey", note.alias("note"))
    n = F.col("note")
    return t.select("o_orderkey", v.extract_currency(n).alias("currency"), v.extract_amount(n).alias("amount"), v.extract_date(n).alias("day"), v.extract_trade_id(n).alias("trade"), v.extract_account_id(n).alias("account"))


_NAMED = ["email", "percentage", "date", "credit_card"]


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{v.PATTERNS[p]}')) AS n_{p}" for p in _NAMED) + " FROM documents")
def named_patterns(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", *[F.regexp_count(F.coalesce("text", F.lit("")), F.lit(v.PATTERNS[p])).cast("bigint").alias(f"n_{p}") for p in _NAMED])


# ------------------------------------------------------------------- catalogues


def _templates(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.col("p_type").alias("type"), F.col("p_size").cast("bigint").alias("usage"), F.round(F.col("p_retailprice") % 5, 2).alias("rating"), (F.col("p_partkey") % 20).alias("rating_count"), F.split("p_name", " ").alias("tags"), F.array(F.lit("amount"), "p_brand").alias("columns"))


@query("SELECT p_partkey AS id, round(p_size * 0.7 + round(fmod(p_retailprice, 5), 2) * (p_partkey % 20) * 0.3, 4) AS popularity FROM part ORDER BY p_size * 0.7 + round(fmod(p_retailprice, 5), 2) * (p_partkey % 20) * 0.3 DESC, p_partkey LIMIT 25")
def catalog_popular(spark, d):
    return catalog.popular(_templates(spark, d), 25).select("id", F.round("popularity", 4).alias("popularity"))


@query("""SELECT id, round(score, 6) AS score FROM (SELECT p_partkey AS id, 0.4 * (p_type = 'ECONOMY')::INT + 0.2 * (p_brand = 'Brand#2')::INT + 0.2 * len(list_intersect(string_split(lower(p_name), ' '), ['red', 'bolt'])) / 2 + 0.15 * (1 + (p_brand = 'Brand#2')::INT) / 2 + 0.05 * least(p_size / 100, 1.0) AS score FROM part)
    WHERE round(score, 6) > 0.3 ORDER BY round(score, 6) DESC, id LIMIT 50""")
def catalog_suited(spark, d):
    return catalog.suited(_templates(spark, d), "ECONOMY", "Brand#2", ["red", "bolt"], ["Amount", "brand#2"], 50).select("id", "score")


_RUNS = "(SELECT event_id AS run_id, event_type AS type, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, value AS seconds, user_id AS rows, ts AS started FROM events)"


def _runs(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("type"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("value").alias("seconds"), F.col("user_id").alias("rows"), F.col("ts").alias("started"))


@query(f"SELECT count(*) AS total_runs, count(*) FILTER (status = 'success') AS successful_runs, round(count(*) FILTER (status = 'success') / count(*) * 100, 2) AS success_rate, round(avg(seconds), 4) AS average_seconds, round(sum(seconds), 4) AS total_seconds, round(avg(rows), 4) AS average_rows FROM {_RUNS}")
def runs_summary(spark, d):
    return catalog.run_summary(_runs(spark, d))


@query(f"SELECT type, count(*) AS runs, count(*) FILTER (status = 'success') AS successful_runs, round(avg(seconds), 4) AS average_seconds FROM {_RUNS} GROUP BY type")
def runs_by_type(spark, d):
    return catalog.runs_by_type(_runs(spark, d))


@query(f"SELECT run_id, type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY started DESC, run_id) AS n FROM {_RUNS}) WHERE n <= 10")
def runs_newest_per_type(spark, d):
    return catalog.newest_per_type(_runs(spark, d), 10).select("run_id", "type")


@query(f"SELECT run_id, type FROM {_RUNS} ORDER BY started DESC, run_id LIMIT 10")
def runs_latest(spark, d):
    return catalog.latest(_runs(spark, d), 10).select("run_id", "type")


# ---------------------------------------------------------------------- stores


@query("""SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_custkey % 2 = 0 THEN round(c_acctbal * 2, 2) ELSE c_acctbal END AS c_acctbal FROM customer""")
def store_replace(spark, d):
    """A table is saved, read, edited and saved under its own id, twice; what it holds then."""
    store = Store(spark, f"{shared_folder(spark)}/ledgerline-store-{uuid.uuid4().hex}")
    id = store.put("uploaded_files", table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "customers")
    store.put("uploaded_files", store.get("uploaded_files", id).withColumn("c_name", F.upper("c_name")), "customers", id)
    store.update("uploaded_files", id, lambda t: t.withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.round(F.col("c_acctbal") * 2, 2)).otherwise(F.col("c_acctbal"))))
    return store.get("uploaded_files", id)


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END AS c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def excel_roundtrip(spark, d):
    """Two sheets, a summary and metadata are written as a workbook; one of the sheets is read again, all as text."""
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = f"{shared_folder(spark)}/ledgerline-{uuid.uuid4().hex}.xlsx"
    sinks.export_excel({"In credit": customers.filter("c_acctbal > 0"), "In debt": customers.filter("c_acctbal <= 0")}, path, metadata={"made by": "excel_roundtrip"})
    return files.read_excel(spark, path, "In credit").drop("_row_pos")
