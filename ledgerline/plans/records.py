"""Lists and searches of catalogues, stored results, files written and read again, details of matches, mappings by function."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import validators as v
from ..operators import catalog, closest, delta, ingest, recon, sqlsurface
from ..operators import transform as t
from ..operators.delta import Compare, Key
from ..operators.recon import Rule
from ..operators.transform import ColumnMap
from ..session import shared_folder
from ..sources import files, sinks
from ..sources.store import Store
from .base import ALTERED_CENTS, altered_orders, query, table

# ------------------------------------------------------------------- catalogues


def _entries(spark, d):
    """Parts as entries of a catalogue."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "prompt").otherwise("rule").alias("type"), F.when(F.col("p_partkey") % 9 == 0, F.lit("")).when(F.col("p_partkey") % 10 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("category"),
        F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.split("p_name", " ").alias("tags"), F.col("p_size").cast("bigint").alias("usage"), F.round(F.col("p_retailprice") % 5, 2).alias("rating"), (F.col("p_partkey") % 20).alias("rating_count"),
        F.col("p_retailprice").alias("created"), (F.col("p_retailprice") * 2).alias("updated"), (F.col("p_partkey") % 7 / 7).alias("quality"))


_ENTRIES = "(SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'prompt' ELSE 'rule' END AS type, CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS category, p_name AS name, p_type AS description, string_split(p_name, ' ') AS tags, p_size AS usage, round(fmod(p_retailprice, 5), 2) AS rating, p_retailprice AS created, p_partkey % 7 AS quality FROM part)"


@query(f"SELECT id, name FROM {_ENTRIES} WHERE type = 'rule' AND category = 'Brand#2' ORDER BY created DESC, id LIMIT 10 OFFSET 5")
def catalog_listed(spark, d):
    return catalog.listed(_entries(spark, d), "rule", "Brand#2", offset=5, limit=10).select("id", "name")


@query(f"SELECT id, usage FROM {_ENTRIES} WHERE (contains(lower(name), 'e') OR contains(lower(description), 'e')) AND len(list_intersect(tags, ['red', 'bolt', 'steel'])) > 0 AND usage >= 10 ORDER BY usage DESC, created DESC, id LIMIT 40")
def catalog_searched(spark, d):
    return catalog.searched(_entries(spark, d), "E", tags=["red", "bolt", "steel"], least_usage=10, limit=40).select("id", "usage")


@query(f"SELECT DISTINCT category FROM {_ENTRIES} WHERE category <> ''")
def catalog_categories(spark, d):
    return catalog.categories(_entries(spark, d))


@query(f"SELECT id, round(usage * 0.7 + rating * 0.3, 6) AS merit FROM {_ENTRIES} ORDER BY usage * 0.7 + rating * 0.3 DESC, id LIMIT 30")
def catalog_by_merit(spark, d):
    return catalog.by_merit(_entries(spark, d), 30).select("id", F.round("merit", 6).alias("merit"))


@query(f"SELECT id, row_number() OVER (ORDER BY quality DESC, created DESC, id) AS place FROM {_ENTRIES} WHERE type = 'prompt'")
def catalog_prompts(spark, d):
    """Places of the saved prompts, best first."""
    out = f"{shared_folder(spark)}/ledgerline-prompts-{uuid.uuid4().hex}"
    catalog.prompts(_entries(spark, d), by_quality=True).select("id", F.monotonically_increasing_id().alias("place")).write.parquet(out)
    return t.sequence(spark.read.parquet(out), "place", "n").select("id", F.col("n").cast("bigint").alias("place"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F' GROUP BY o_orderpriority")
def template_execute(spark, d):
    """A stored query: wanted names mapped to the table's columns, parameters bound, one of them by its default."""
    stored = {"body": "SELECT {{priority}} AS o_orderpriority, count(*) AS n, round(sum({{total}}), 2) AS total FROM file_1 WHERE {{total}} > {{least}} AND {{status}} = {{wanted}} GROUP BY {{priority}}", "parameters": [{"name": "least"}, {"name": "wanted", "default": "F"}]}
    opened = sqlsurface.open_tables([table(spark, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderstatus")])
    return catalog.execute(stored, opened, {"least": 250000}, ["priority", "total", "status"])


# ---------------------------------------------------- matches and their columns


@query(f"""SELECT a.o_orderkey AS "FileA_o_orderkey", a.o_clerk AS "FileA_o_clerk", b.o_orderkey AS "FileB_o_orderkey", b.o_totalprice AS "FileB_o_totalprice" FROM (SELECT o_orderkey, o_totalprice, 'clerk' || o_custkey AS o_clerk FROM orders) a JOIN {ALTERED_CENTS} b ON a.o_orderkey = b.o_orderkey""")
def recon_selected_columns(spark, d):
    """Selected columns of each side, and those that its rules need."""
    a = table(spark, d, "orders").withColumn("o_clerk", F.concat(F.lit("clerk"), "o_custkey"))
    return recon.reconcile(a, altered_orders(table(spark, d, "orders"), cents=True), [Rule("o_orderkey", "o_orderkey")], "o_orderkey", "o_orderkey", selected_a=["o_clerk"], selected_b=["o_totalprice"]).matched


@query("SELECT o_orderkey AS a_pos, o_orderkey AS b_pos FROM orders WHERE o_orderkey % 4 <> 3")
def recon_numbers_in_text(spark, d):
    """Amounts written in other ways are equal if their numbers are; a text that is none equals no number."""
    k, n = F.col("o_orderkey"), F.floor("o_totalprice")
    orders = table(spark, d, "orders").select("o_orderkey", n.cast("string").alias("said"))
    other = F.when(k % 4 == 0, F.concat(F.lit(" 00"), n)).when(k % 4 == 1, F.concat(F.lit("+"), n, F.lit(".0 "))).when(k % 4 == 2, F.concat(n * 100, F.lit("E-2"))).otherwise(F.concat(n, F.lit(" EUR")))
    b = table(spark, d, "orders").select("o_orderkey", other.alias("written"))
    return recon.match_pairs(orders, b, [Rule("o_orderkey", "o_orderkey"), Rule("said", "written", "tolerance", 0.0)], "o_orderkey", "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'day: ''' || strftime(o_orderdate, '%Y-%m-%d') || ''' → ''' || strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') || '''' ELSE 'All columns match exactly' END AS closest_match_details, CASE WHEN o_orderkey % 3 = 0 THEN 85.0 ELSE 100.0 END::DOUBLE AS closest_match_score FROM orders WHERE o_orderstatus = 'F'""")
def closest_details(spark, d):
    """What differs in the closest row, column by column."""
    orders = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    moved = orders.withColumn("day", F.when(F.col("o_orderkey") % 3 == 0, F.date_add("day", 3)).otherwise(F.col("day")))
    out = closest.closest(orders, moved, [("day", "day")], "o_orderkey", "o_orderkey", [("o_orderkey", "o_orderkey")], {"day": "date"}, native=True)
    return out.select("o_orderkey", "closest_match_details", "closest_match_score")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'o_orderpriority: ' || o_orderpriority || '->(empty)' END AS changed FROM orders""")
def closest_short_report(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    blank = F.when(F.col("o_orderkey") % 2 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    told = closest.changed_columns(o, ["o_orderpriority", "o_orderstatus"], [blank, F.col("o_orderstatus")])
    return o.select("o_orderkey", F.nullif(F.array_join(F.array_compact(F.array(*told)), "; "), F.lit("")).alias("changed"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'A' || lpad(o_orderkey::VARCHAR, 8, '0') END AS cusip, o_orderkey % 3 = 0 AS whole_cusip, o_orderkey % 3 = 1 AS whole_sedol FROM orders""")
def extract_identifiers(spark, d):
    k = F.col("o_orderkey")
    code = F.when(k % 3 == 0, F.concat(F.lit("A"), F.lpad(k.cast("string"), 8, "0"))).when(k % 3 == 1, F.concat(F.lit("B"), F.lpad(k.cast("string"), 6, "0"))).otherwise("short")
    o = table(spark, d, "orders").select("o_orderkey", code.alias("code"))
    note = F.concat(F.lit("bond ("), F.lower("code"), F.lit(") sold"))
    return o.select("o_orderkey", v.extract_cusip(note).alias("cusip"), v.valid_cusip(F.col("code")).alias("whole_cusip"), v.valid_sedol(F.col("code")).alias("whole_sedol"))


@query("SELECT c_custkey, 7 AS seven, upper(c_mktsegment) || '/' || c_nationkey AS code FROM customer")
def map_function_static(spark, d):
    """A registered function of several columns, and a constant."""
    t.register("segment_code", lambda segment, nation: F.concat(F.upper(segment), F.lit("/"), nation))
    return t.map_columns(table(spark, d, "customer"), [ColumnMap("c_custkey", "direct", "c_custkey"), ColumnMap("seven", "static", value=7), ColumnMap("code", "function", "c_mktsegment, c_nationkey", "segment_code")])


# ------------------------------------------------------------------------ files


@query("""SELECT doc_id::VARCHAR AS doc_id, nullif(lang, '') AS lang, CASE WHEN length(coalesce(text, '')) > 0 THEN 'said "' || left(text, 40) || '", twice' || chr(10) || '00' || doc_id ELSE 'none' END AS note FROM documents""")
def csv_roundtrip(spark, d):
    """Quotes, commas, line breaks and zeros in front come back from a CSV file as they were."""
    docs = table(spark, d, "documents")
    note = F.when(F.length(F.coalesce("text", F.lit(""))) > 0, F.concat(F.lit('said "'), F.left("text", F.lit(40)), F.lit('", twice\n00'), "doc_id")).otherwise("none")
    path = f"{shared_folder(spark)}/ledgerline-{uuid.uuid4().hex}.csv"
    sinks.export(docs.select("doc_id", "lang", note.alias("note")), path)
    return files.read_csv(spark, path)


@query("SELECT Result_Type, count(*) AS n, count(c_acctbal) AS balances FROM (SELECT 'credit' AS Result_Type, c_acctbal FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'debt', NULL FROM customer WHERE c_acctbal <= 0) GROUP BY 1")
def json_export(spark, d):
    """Result sets in one file of JSON lines; numbers that JSON has not become null."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    path = f"{shared_folder(spark)}/ledgerline-{uuid.uuid4().hex}.json"
    odd = F.lit(float("nan"))
    sinks.export(sinks.combined({"credit": c.filter("c_acctbal > 0"), "debt": c.filter("c_acctbal <= 0").withColumn("c_acctbal", odd)}), path, "json")
    return files.ingest(spark, path).data.groupBy("Result_Type").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("balances"))


@query(f"""WITH b AS {ALTERED_CENTS}, t AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b, CASE WHEN b.o_orderkey IS NULL THEN 'DELETED' WHEN a.o_totalprice = b.o_totalprice THEN 'UNCHANGED' ELSE 'AMENDED' END AS kind FROM orders a LEFT JOIN b ON a.o_orderkey = b.o_orderkey)
    SELECT kind AS category, count(*) AS n FROM t GROUP BY kind UNION ALL SELECT 'result', count(*) FROM t WHERE kind = 'AMENDED'""")
def store_categories(spark, d):
    """Categories of a delta are stored as one table, read one by one, and one is saved as a table of its own."""
    store = Store(spark, f"{shared_folder(spark)}/ledgerline-store-{uuid.uuid4().hex}")
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    found = delta.categories(delta.classified(orders, altered_orders(table(spark, d, "orders"), cents=True).select("o_orderkey", "o_totalprice"), [Key("o_orderkey", "o_orderkey")], [Compare("o_totalprice", "o_totalprice")]))
    id = store.put_results("comparisons", {c: found[c] for c in ("unchanged", "amended", "deleted")}, "run")
    each = [store.get("comparisons", id, c).select(F.upper(F.lit(c)).alias("category")) for c in ("unchanged", "amended", "deleted")]
    own = store.get("uploaded_files", store.save_result("comparisons", id, "amended")).select(F.lit("result").alias("category"))
    return t.union_of([*each, own]).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows FROM (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 10)")
def sql_row_count(spark, d):
    """How many rows a query gives, without its rows."""
    opened = sqlsurface.open_tables([table(spark, d, "lineitem")])
    return sqlsurface.row_count(sqlsurface.run(opened, "SELECT l_suppkey FROM file_1 GROUP BY l_suppkey HAVING sum(l_quantity) > 10"))


@query("SELECT c_custkey AS id, c_name AS \"name\", c_name AS \"name_1\", c_mktsegment AS \"Unnamed_3\" FROM customer WHERE c_custkey % 5 <> 0")
def names_cleaned(spark, d):
    """Names trimmed, empty and repeated ones told apart; empty rows go."""
    c, keep = table(spark, d, "customer"), F.col("c_custkey") % 5 != 0
    raw = c.select(*[F.when(keep, F.col(x)) for x in ("c_custkey", "c_name", "c_name", "c_mktsegment")]).toDF(" id", "name ", " name", "Unnamed: 3")
    return ingest.clean(raw)[0]
