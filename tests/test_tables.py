"""Similarity, closest match, cleaning, profiles, edits, validators, SQL surface, stores, sinks, catalogues, aids."""

import json
import random
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from ledgerline import assist
from ledgerline.functions import batchsim, bounds
from ledgerline.functions import similarity as s
from ledgerline.functions import validators as v
from ledgerline.operators import catalog, closest, edits, ingest, profile, sqlsurface
from ledgerline.operators.edits import Patch
from ledgerline.operators.recon import Rule
from ledgerline.sources import files, sinks
from ledgerline.sources.store import Conflict, Store

# ------------------------------------------------------------------- similarity


def lcs(a, b):
    @lru_cache(None)
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

    return f(0, 0)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in range(2))
        assert s.common_length(a, b) == lcs(a, b)


def test_partial_ratio_is_the_best_window():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        n = len(short)
        every = [long[max(0, i) : i + n] for i in range(1 - n, len(long))]
        best = max(s.ratio(short, w) for w in every)
        if len(a) == len(b):
            best = max(best, max(s.ratio(long, short[max(0, i) : i + n]) for i in range(1 - n, n)))
        assert s.partial_ratio(a, b) == pytest.approx(best)


def test_known_similarities():
    assert s.ratio("this is a test", "this is a test!") == pytest.approx(200 * 14 / 29)
    assert s.partial_ratio("YANKEES", "NEW YORK YANKEES") == 100
    assert s.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert s.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert s.text_similarity("", "a") == 0 and s.identifier_similarity("AB", "AB") == 100
    assert [s.column_kind(*x) for x in (("trade_date",), ("Net_Amount",), ("ref",), ("x", ["1", "2", None]), ("x", ["2024-01-02", "5 Jan 2024"]), ("x", ["a", "1"]), ("x",))] == ["date", "numeric", "identifier", "numeric", "date", "text", "text"]


def test_closest_match_against_plain_python(spark):
    rng = random.Random(3)
    names = ["Acme Ltd", "Acme Limited", "Globex", "Initech GmbH", "", None]
    a = [(i, rng.choice(names), rng.choice([None, 10.0, 12.5, 0.0]), rng.choice(["k", "K ", None])) for i in range(15)]
    b = [(i, rng.choice(names), rng.choice([None, 10.0, 11.0, 0.0]), rng.choice(["k", "j", ""])) for i in range(12)]
    da, db = (spark.createDataFrame(x, "pos int, name string, amount double, k string") for x in (a, b))

    def score(x, y):
        out = []
        for i, kind in ((1, "text"), (2, "numeric")):
            p, q = x[i], y[i]
            if p is None or q is None:
                out.append(50.0 if p is q else 0.0)
            elif p == q:
                out.append(100.0)
            elif kind == "text":
                out.append(s.text_similarity(p, q))
            else:
                out.append(max(0, 100 - abs(p - q) / abs(q) * 100) if q else 0.0)
        return sum(out) / 2

    for exact in ([], [("k", "k")]):
        got = {r.pos: r for r in closest.closest(da, db, [("name", "name"), ("amount", "amount")], "pos", "pos", exact=exact, kinds={"name": "text", "amount": "numeric"}).collect()}
        for x in a:
            best, at = 0.0, None
            for y in b:
                if exact and (x[3] or "").strip().lower() != (y[3] or "").strip().lower():
                    continue
                z = score(x, y)
                if best < 99.5 and z > best and z > 30:
                    best, at = z, y
            r = got[x[0]]
            assert r.closest_match_score == pytest.approx(round(best, 2), abs=0.01)
            assert (r.closest_match_record is None) == (at is None)
            if at:
                assert r.closest_match_record.startswith(f"pos: {at[0]}; name: ")
                assert (r.closest_match_details == "All columns match exactly") == (best == 100)
    with pytest.raises(ValueError, match="comparisons"):
        closest.closest(da, db, [("name", "name")], "pos", "pos", max_comparisons=10)
    assert closest.closest(da, db.limit(0), [("amount", "amount")], "pos", "pos").filter("closest_match_score > 0").count() == 0
    assert closest.compared([Rule("a", "b"), Rule("c", "d")], [("a", "b")], from_a=False) == ([("b", "a")], [("d", "c")])
    assert closest.closest(da, db, [("amount", "amount")], "pos", "pos", sample=True).count() == 15
    both = closest.closest_with_fallback(da, db, [("amount", "amount")], "pos", "pos", [("k", "k")], kinds={"amount": "numeric"}, native=True)
    alone = {r.pos: r.closest_match_score for r in closest.closest(da, db, [("amount", "amount")], "pos", "pos", kinds={"amount": "numeric"}, native=True).collect()}
    assert both.count() == 15 and all(alone[r.pos] >= r.closest_match_score and (r.closest_match_score > 0 or alone[r.pos] == 0) for r in both.collect())


# --------------------------------------------------------------------- cleaning

CSV = 'Id, Name ,Name,When,Amount,Empty,Code\n1," a ",x,05/01/2024,1.0,,007\n\n2,b,y,06/01/2024,2.0, ,008\n,,,,,,\n3,"c\nd",z,soon,,,009\n4,e,,13/01/2024,4.0,,010\n'


def test_ingest_a_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(CSV)
    out = files.ingest(spark, str(path))
    assert out.data.columns == ["Id", "Name", "Name_1", "When", "Amount", "Code"] or out.data.columns[:2] == ["Id", "Name"]
    rows = out.data.orderBy("Id").collect()
    assert [r.Id for r in rows] == [1, 2, 3, 4] and [r.Code for r in rows] == ["007", "008", "009", "010"]
    assert [r.When for r in rows] == ["2024-01-05", "2024-01-06", "soon", "2024-01-13"] and rows[0].Name == "a" and rows[2].Name == "c\nd"
    assert [r.Amount for r in rows] == [1, 2, None, 4] and out.report.removed_columns == ["Empty"]


def test_row_positions_follow_the_file(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("n\n" + "".join(f"{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        got = files.read_csv(spark, str(path), positions=True, multiline=False)
        assert got.filter(F.col("n").cast("bigint") != F.col("_row_pos")).count() == 0 and got.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_file_checks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "a.exe").write_text("x")
    assert files.checked(spark, str(tmp_path / "a.csv")) == 4
    for bad in (lambda: files.checked(spark, str(tmp_path / "a.exe")), lambda: files.checked(spark, str(tmp_path / "a.csv"), most=3)):
        with pytest.raises(ValueError):
            bad()
    assert ingest.clean_names(["a", " a ", "", "Unnamed: 3", "a_1"]) == ["a", "a_1", "Unnamed_2", "Unnamed_3", "a_1_1"]


def test_cleaning_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    out, report = ingest.clean(df)
    assert out.count() == 0 and report.rows == 0


# ---------------------------------------------------------- profiles and edits


def test_profile_and_quality(spark):
    df = spark.createDataFrame([(1, "5", None), (1, "5", None), (2, "x", None), (3, "7", None), (4, "8", None), (5, "9", None), (None, None, None)], "n int, t string, z string")
    rows = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert (rows["n"].null_count, rows["n"].distinct_count, rows["n"].max_value, rows["t"].mean_value) == (1, 5, 5.0, None)
    st = profile.statistics(df).first()
    assert (st["count"], st["median"], st["null_count"]) == (6, 2.5, 1)
    q = profile.quality(df).first()
    assert (q.rows, q.null_rows, q.null_columns, q.mixed_columns, q.duplicate_rows) == (7, 1, "z", "t", 1)
    assert profile.samples(df)["t"] == ["5", "5", "x", "7", "8"] and profile.common_columns([df, df.drop("t")]) == ["n", "z"]
    assert profile.references(df, ["n", "m"])["success_rate"] == 50.0
    assert profile.page(df, "n", 2, 3).count() == 3 and profile.search(df, "X").count() == 1


def test_patch(spark):
    df = spark.createDataFrame([(i, f"n{i}", i * 1.5) for i in range(5)], "_row_pos bigint, name string, x double")
    out = edits.patch(df, Patch(cells=[(1, "x", 9), (2, "x", "text"), (0, "name", None)], delete_rows=[3, 99], add_rows=[{"name": "new"}]))
    assert [tuple(r) for r in out.orderBy("_row_pos").collect()] == [(0, None, "0"), (1, "n1", "9"), (2, "n2", "text"), (3, "n4", "6"), (4, "new", "")]
    assert edits.change_columns(df, ["x", "y"], ["name"], {"x": "y", "_row_pos": "p"}).columns == ["p", "x", "y"]
    assert edits.patch(df, Patch()).count() == 5 and edits.append_rows(df.limit(0), [{"name": "first"}]).first()._row_pos == 0


# ------------------------------------------------------------------ identifiers


def test_identifiers(spark):
    known = v.countries(spark)
    assert {"US", "GB", "DE"} <= set(known) and len(known) > 200
    isins = ["US0378331005", "GB0002162385", "DE0007164600"]
    df = spark.createDataFrame([(x,) for x in [*isins, "US0378331006", "XX0378331005", "US03783310", "us0378331005", None, "US037833100A"]], "t string")
    t = F.col("t")
    got = [tuple(r) for r in df.select(v.valid_isin(t, known, True), v.valid_isin(t, known), v.valid_cusip(t), v.valid_sedol(t)).collect()]
    assert [g[0] for g in got] == [True] * 3 + [False] * 6 and not any(g[1] for g in got[:3])
    notes = spark.createDataFrame([("buy GB0002162385 for €1.250,75 ref tx99 ACCT12",), ("C$ 3,5 on 2024-1-2",), ("594918104 at 1,234,567",), (None,)], "t string")
    got = notes.select(v.extract_isin(t, known, True), v.extract_amount(t), v.extract_currency(t), v.extract_date(t), v.extract_trade_id(t), v.extract_account_id(t), v.extract_cusip(t)).collect()
    assert got[0][0] == "GB0002162385" and got[0][4] == "TX99" and got[0][5] == "ACCT12"
    assert (got[1][1], got[1][2], got[1][3]) == (3.5, "USD", "2024-1-2") and got[2][6] == "594918104" and tuple(got[3]) == (None,) * 7
    checked = notes.select(v.validate_field("Isin", t, known, True).alias("i"), v.validate_field("other", t).alias("o"), v.validate_field("currency", t).alias("c")).first()
    assert checked.i.suggested_correction == "GB0002162385" and checked.o.message == "Field type not validated" and checked.c.is_valid
    assert v.try_pattern(r"(\d)(x)?", "1 2x") == [{"match": "1", "groups": ["1", None], "start": 0, "end": 1, "length": 1}, {"match": "2x", "groups": ["2", "x"], "start": 2, "end": 4, "length": 2}]
    assert [v.suggested_pattern(x) for x in ("Find the e-mail or email", "card number", "nothing")] == ["email", "credit_card", None]


# ----------------------------------------------------------------- SQL surface


def test_sql_reads_only(spark):
    tables = sqlsurface.open_tables([spark.range(5).withColumnRenamed("id", "Some Name")])
    assert sqlsurface.run(tables, 'WITH t AS (SELECT "Some Name" AS n FROM file_1) SELECT sum(n) AS s FROM t;').first().s == 10
    assert sqlsurface.run(tables, 'SELECT "Some Name" AS n FROM file_1 ORDER BY n DESC LIMIT 2', limit=10).collect()[0].n == 4
    assert sqlsurface.run(tables, 'SELECT count(*) AS c FROM file_1 WHERE "Some Name" > :least', parameters={"least": 2}).first().c == 2
    for bad in ("DROP VIEW file_1", "CREATE TABLE x AS SELECT 1", "INSERT INTO file_1 VALUES (1)", "SET a=b", "CACHE TABLE file_1", "SELECT 1) t; DROP VIEW file_1 --", "SHOW TABLES", "SELECT reflect('java.lang.System', 'gc')", "SELEC 1"):
        with pytest.raises(ValueError):
            sqlsurface.run(tables, bad)
        assert not sqlsurface.read_only(tables.spark, bad)
    assert sqlsurface.read_only(tables.spark, "SELECT nowhere FROM nothing")
    assert "file_1" not in [t.name for t in spark.catalog.listTables()]
    for query, kind in (('SELECT "Some Nam" FROM file_1', "column"), ("SELECT 1 FROM file_11", "table")):
        with pytest.raises(Exception) as e:
            sqlsurface.run(tables, query).collect()
        assert sqlsurface.explain_error(e.value, tables)["kind"] == kind and sqlsurface.explain_error(e.value, tables)["suggestions"]
    with pytest.raises(ValueError):
        sqlsurface.open_tables([])


def test_queries_are_judged_by_their_plan(spark):
    spark.range(1).createOrReplaceTempView("not_opened")
    spark.range(1).createOrReplaceGlobalTempView("shared_view")
    with sqlsurface.open_tables({"t": spark.createDataFrame([(1, "x y"), (2, None)], "id int, s string")}) as tables:
        for bad in (
            "SELECT `reflect`('java.util.UUID', 'randomUUID')", "SELECT reflect/**/('java.util.UUID', 'randomUUID')", "SELECT \"java_method\"('java.util.UUID', 'randomUUID')", "SELECT IDENTIFIER('ref' || 'lect')('java.util.UUID', 'randomUUID')",
            "SELECT id FROM t WHERE EXISTS (SELECT try_reflect('java.util.UUID', 'randomUUID'))", "SELECT system.builtin.reflect('java.util.UUID', 'randomUUID')", "SELECT TRANSFORM(id) USING 'cat' AS (x STRING) FROM t",
            "FROM t INSERT INTO x SELECT *", "SELECT * FROM global_temp.shared_view", "SELECT * FROM not_opened", "SELECT * FROM IDENTIFIER('not_' || 'opened')", "SELECT nobody(id) FROM t", "SELECT * FROM parquet.`/tmp`",
            "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t", "EXPLAIN SELECT 1", "DESCRIBE t", "/* SELECT */ DROP VIEW t", "BEGIN SELECT 1; END", "SELECT 1; SELECT 2",
        ):
            with pytest.raises(ValueError):
                sqlsurface.run(tables, bad)
        for good, rows in (
            ("-- a comment\n/* and another */ SELECT * FROM t -- end", 2), ("WITH a AS (SELECT id FROM t), b(k) AS (SELECT 1) SELECT * FROM a JOIN b ON id = k;", 1), ("SELECT x FROM t LATERAL VIEW explode(split(s, ' ')) e AS x", 2),
            ("SELECT * FROM t PIVOT (max(s) FOR id IN (1, 2))", 1), ("SELECT id, sum(id) OVER w FROM t WINDOW w AS (ORDER BY id) ORDER BY 1 DESC LIMIT 1 OFFSET 1", 1), ("SELECT * FROM range(3)", 3), ("VALUES (1), (2)", 2), ("TABLE t", 2),
            ("SELECT days_between(DATE'2024-01-02', DATE'2024-01-01') FROM t WHERE regexp_matches(s, 'x') UNION ALL SELECT 1 EXCEPT SELECT 3", 1), ("SELECT * FROM t |> WHERE id > 1", 1), ("SELECT 'DROP TABLE reflect(' AS x, id FROM t TABLESAMPLE (100 PERCENT)", 2),
        ):
            assert sqlsurface.run(tables, good).count() == rows, good
        for query, kind, name in (("WITH c AS (SELECT id AS number FROM t) SELECT c.numbr FROM c", "cte_column", "c.numbr"), ("SELECT ids FROM t", "column", "ids"), ("SELECT 1 FROM tt", "table", "tt")):
            with pytest.raises(Exception) as e:
                sqlsurface.run(tables, query).collect()
            told = sqlsurface.explain_error(e.value, tables, query)
            assert (told["kind"], told["name"]) == (kind, name) and told["suggestions"]
    assert not [v for v in tables.spark.catalog.listTables() if v.name == "t"]
    assert [r.viewName for r in spark.sql("SHOW VIEWS IN global_temp").collect() if not r.isTemporary or r.namespace] == ["shared_view"]
    spark.catalog.dropGlobalTempView("shared_view")
    spark.catalog.dropTempView("not_opened")
    seen = sqlsurface.parsed(spark, "WITH a AS (SELECT x.k FROM big AS x) SELECT count(*), a.k FROM a, LATERAL explode(array(1)) GROUP BY a.k")
    assert seen.tables == ["big", "a"] and seen.with_names == ["a"] and "x" in seen.aliases and {"count", "explode", "array"} <= set(seen.functions) and "a.k" in seen.columns


def test_sql_texts(spark):
    assert [sqlsurface.query_class(q) for q in ("select * from a LEFT JOIN b", "select sum(x) from a", "select 1 where not x", "select 1", "select Coalesce(a) from b", "select x from a order by x", "with a as (select 1) select * from a", "select 1 where 'AMENDED' = x")] == ["join_operation", "aggregation", "filtering", "data_analysis", "reconciliation", "sorting", "complex_query", "delta_analysis"]
    assert sqlsurface.complexity("select 1 from (subquery) union select 2") == 5
    assert sqlsurface.complexity("select 1 from a join b on c group by d having e order by f") == 6
    assert len(sqlsurface.notes("SELECT * FROM a ORDER BY b", 9, 20_000)) == 4 and sqlsurface.result_risks(0, 5) and not sqlsurface.result_risks(3, 5)
    assert sqlsurface.column_references('select "A", "Bee"', ["A", "Bees"])["suggestions"] == {"Bee": ["Bees"]}
    assert sqlsurface.column_hints("total amount per customer-name", ["customer_name", "Amount", "zip"]) == ["customer_name", "Amount"]
    assert sqlsurface.markdown_rows("x\n| a | b |\n|---|:-:|\n| 1 | 2 |") == [{"a": "1", "b": "2"}]
    df = spark.createDataFrame([(float("nan"), 1e20), (1.0, 2.0)], "a double, b double")
    first, n = sqlsurface.preview(df, 1)
    assert tuple(first.first()) == (None, None) and n == 2 and sqlsurface.estimate(df)["bytes"] > 0


# ------------------------------------------------- stores, sinks and catalogues


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    a, b = spark.range(3).withColumn("x", F.lit("a")), spark.range(2)
    id = store.put_results("comparisons", {"amended": a, "deleted": b}, "My run", who="me")
    table = store.put("uploaded_files", a, "orders")
    assert store.get("comparisons", id, "amended").count() == 3 and store.get("comparisons", id).count() == 5
    info = store.describe("comparisons", id)
    assert info["counts"] == {"amended": 3, "deleted": 2} and info["rows"] == 5 and info["extra"] == {"who": "me"}
    assert store.find("ORD").first().id == table and store.metadata().count() == 2
    saved = store.save_result("comparisons", id, "deleted", "del/../eted!")
    assert store.describe("uploaded_files", saved)["name"] == "del_.._eted" and store.get("uploaded_files", saved).count() == 2
    assert store.clear_old("uploaded_files", 1) == 1 and store.exists("uploaded_files", saved) and not store.exists("uploaded_files", table)
    assert store.delete("comparisons", id) and not store.delete("comparisons", id)
    with pytest.raises(KeyError):
        store.get("comparisons", id)


def test_a_table_is_replaced_by_what_is_read_from_it(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    id = store.put("uploaded_files", spark.range(5).withColumn("x", F.lit("a")), "t")
    before = store.get("uploaded_files", id)
    store.put("uploaded_files", edits.change_columns(before, rename={"x": "y"}), id=id)
    assert store.get("uploaded_files", id).columns == ["id", "y"] and store.get("uploaded_files", id).count() == 5
    assert before.count() == 5 and store.get("uploaded_files", id, version=1).columns == ["id", "x"] and store.version("uploaded_files", id) == 2
    assert store.metadata().count() == 1 and store.describe("uploaded_files", id)["version"] == 2
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):  # a write that fails leaves what was there
        store.put("uploaded_files", spark.range(3).selectExpr("1 div (id - 1) AS id"), id=id)
    assert store.get("uploaded_files", id).count() == 5 and len(list((tmp_path / "store/uploaded_files/data" / id).iterdir())) == 2
    assert store.vacuum("uploaded_files", id) == 1 and store.get("uploaded_files", id).count() == 5


def test_updates_of_a_table_at_one_time_all_count(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    id = store.put("uploaded_files", spark.range(1).withColumn("n", F.lit(0)), "t")
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda _: store.update("uploaded_files", id, lambda t: t.withColumn("n", F.col("n") + 1)), range(6)))
    assert sorted(versions) == [2, 3, 4, 5, 6, 7] and store.get("uploaded_files", id).first().n == 6
    with pytest.raises(Conflict):
        store.put("uploaded_files", spark.range(1), id=id, expected=3)


def test_uses_and_ratings_at_one_time_all_count(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/rules")
    (id,) = c.save([{"type": "recon", "name": "Rates", "usage": 2, "rating": 5.0, "rating_count": 1}])
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: (c.used(id), c.rate(id, i)), range(4)))
    c.update(id, name="New")
    got = c.get(id)
    assert (got["name"], got["usage"], got["rating_count"], got["rating"]) == ("New", 6, 5, pytest.approx(11 / 5))
    assert c.compact(f"file://{tmp_path}/small").get(id)["usage"] == 6 and not c.used("none")


def test_sinks(spark, tmp_path):
    a, b = spark.range(2), spark.range(1).withColumn("y", F.lit(float("nan")))
    both = sinks.combined({"A": a, "B": b})
    sinks.export(both, str(tmp_path / "c"), "csv", one_file=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True).groupBy("Result_Type").count().count() == 2
    sinks.export(both, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).filter("y is not null").count() == 0
    assert [tuple(r) for r in sinks.counts({"A": a, "B": b}).orderBy("Category").collect()] == [("A", 2, 66.67), ("B", 1, 33.33)]
    with pytest.raises(ValueError):
        sinks.export(a, str(tmp_path / "x"), "xml")


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/rules")
    assert c.rows().count() == 0
    one, two = c.save([{"type": "recon", "category": "fx", "name": "Rates", "tags": ["daily"], "columns": ["amount"], "body": {"a": 1}}, {"type": "delta", "category": "", "name": "Other", "description": "rates too"}])
    assert c.used(one) and c.rate(one, 4.0) and c.rate(one, 2.0) and c.update(two, name="Renamed") and not c.update("none", name="x")
    got = c.get(one)
    assert (got["usage"], got["rating"], got["rating_count"], json.loads(got["body"])) == (1, 3.0, 2, {"a": 1})
    assert [r.id for r in catalog.searched(c.rows(), "RATES").collect()] == [one, two] and catalog.searched(c.rows(), tags=["daily"], least_usage=1).count() == 1
    assert [r.category for r in catalog.categories(c.rows()).collect()] == ["fx"] and catalog.listed(c.rows(), type="delta").first().name == "Renamed"
    assert catalog.popular(c.rows()).first().id == one and catalog.by_merit(c.rows()).first().id == one
    assert catalog.suited(c.rows(), "recon", "fx", ["daily"], ["amount"]).first().score == pytest.approx(0.9505)
    small = c.compact(f"file://{tmp_path}/small")
    assert small.versions().count() == 2 and c.delete([one, "none"]) == 1 and c.get(one) is None


def test_templates_run_on_tables(spark):
    tables = sqlsurface.open_tables([spark.createDataFrame([("x", 5.0), ("y", 7.0)], "Client_ID string, Total double")])
    out = catalog.execute({"body": "SELECT {{reference}} AS c FROM file_1 WHERE {{amount}} > {{least}}", "parameters": [{"name": "least", "default": 6}]}, tables, {}, ["reference", "amount"])
    assert [r.c for r in out.collect()] == ["y"]
    with pytest.raises(ValueError):
        catalog.resolved([{"name": "a"}], {})
    with pytest.raises(ValueError):
        catalog.filled("{{x}}")
    assert catalog.cost("m", 1000, 2000, {"m": (1.0, 2.0)}) == 5.0 and catalog.cost("z", 1, 1) is None


class Canned:
    def __init__(self, answer):
        self.answer = answer

    def complete(self, prompt):
        if prompt.startswith('{"fields"'):
            return json.dumps([{"who": t[:3], "confidence": 0.5} for t in json.loads(prompt)["texts"]])
        return self.answer


def test_aids(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, None)], "id int, t string")
    rules = assist.recon_rules(Canned('```json\n[{"left": "id", "right": "id"}]\n```'), "match ids", df, df)
    assert rules == [Rule("id", "id")]
    with pytest.raises(ValueError):
        assist.recon_rules(Canned('[{"left": "nope", "right": "id"}]'), "x", df, df)
    tables = sqlsurface.open_tables([df])
    assert assist.query_for(Canned("```sql\nSELECT 1\n```"), "one", tables).strip() == "SELECT 1"
    with pytest.raises(ValueError):
        assist.query_for(Canned("DROP VIEW file_1"), "x", tables)
    assert [tuple(r) for r in assist.extract_fields(df, "t", ["who"], Canned(""), "id", 1).orderBy("id").collect()] == [(1, "abc", 0.5), (2, "", 0.5)]
    assert 0 <= assist.prompt_quality("sum of t by id", ["id", "t"]) <= 1 and assist.delta_keys(Canned('[{"left": "id", "right": "id"}]'), "x", df, df)[0].left == "id"


# ------------------------------------------------- closest match without all pairs


def _words(rng, n):
    return " ".join(rng.choice(["red", "small", "bolt", "ring", "gear", "hot", "x", "ab", "ba"]) + rng.choice(["", "s", "1"]) for _ in range(n))


def test_batched_scores_are_those_of_single_pairs():
    rng = random.Random(8)
    pairs = [(_words(rng, rng.randint(0, k)), _words(rng, rng.randint(0, k))) for k in (1, 2, 5, 12, 70) for _ in range(80)] + [("é 𝒜", "𝒜 é"), ("a" * 100, "a" * 70), ("ab" * 60, "ba" * 65), (" \t", "a"), ("x", "x" * 300)]
    for kind, plain in (("text", s.text_similarity), ("identifier", s.identifier_similarity)):
        assert batchsim.scores(*zip(*pairs), kind).tolist() == [plain(*p) for p in pairs]
    assert batchsim.scores([], []).tolist() == []


def test_bounds_are_never_below_scores():
    rng = random.Random(9)
    texts = ["", "\t", "é", *(_words(rng, rng.randint(0, 9)) for _ in range(60)), *("".join(rng.choice("ab c") for _ in range(rng.randint(1, 30))) for _ in range(60))]
    told = bounds.Texts(texts)
    for identifier, plain in ((False, s.text_similarity), (True, s.identifier_similarity)):
        high = bounds.bound(told, told, identifier)
        assert all(high[i, j] >= plain(x, y) for i, x in enumerate(texts) for j, y in enumerate(texts) if x != y)


def test_closest_scores_few_pairs_and_loses_none(spark, monkeypatch):
    monkeypatch.setattr(closest, "BLOCK_ROWS", 170)
    monkeypatch.setattr(closest, "SLICE_ROWS", 30)
    rng = random.Random(10)
    values = lambda i: (i, rng.choice([None, _words(rng, rng.randint(0, 5)), _words(rng, 3), _words(rng, 3)]), rng.choice([None, "7", "7.0", "x", f"{rng.randint(1, 900)}", "0"]), rng.choice([None, "2024-01-05", f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", "soon"]))
    a, b = [values(i) for i in range(70)], [values(i) for i in range(500)]
    schema, kinds = "best int, name string, n string, day string", {"name": "text", "n": "numeric", "day": "date"}
    columns = [(c, c) for c in kinds]
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).repartition(3)
    # every pair by the plain expressions
    forms = lambda df, x: df.select("best", *[F.struct(*s.forms(df, c, k)).alias(f"{x}_{c}") for c, k in kinds.items()])
    pairs = forms(da, "a").crossJoin(forms(db, "b").withColumnRenamed("best", "other"))
    total = sum((s.score(k, F.col(f"a_{c}"), F.col(f"b_{c}")) for c, k in kinds.items()), F.lit(0.0)) / 3
    scores = {}
    for r in pairs.select("best", "other", total.alias("score")).collect():
        scores.setdefault(r.best, []).append((r.other, r.score))
    for least, perfect in ((30.0, 99.5), (45.0, 60.0), (0.0, 101.0)):
        got = {r.best: r for r in closest.closest(da, db, columns, "best", "best", kinds=kinds, least=least, perfect=perfect).collect()}
        assert len(got) == 70
        for i, rows in scores.items():
            over = sorted((p, x) for p, x in rows if x > least)
            want = next((x for x in over if x[1] >= perfect), None) or (max(over, key=lambda x: (x[1], -x[0])) if over else None)
            assert got[i].closest_match_score == (pytest.approx(round(want[1], 2), abs=0.006) if want else 0.0)
            assert (got[i].closest_match_record or "none").startswith(f"best: {want[0]};" if want else "none")
    left, right = (df.select(F.col("best").alias(f"{x}_pos"), F.struct(*s.forms(df, "name", "text")).alias(f"{x}0")) for df, x in ((da, "s"), (db, "t")))
    monkeypatch.setattr(closest, "BLOCK_ROWS", 8192)
    scored = closest._in_cells(left, right, 70, 500, ["text"], 30.0, 99.5, False).agg(F.sum("n_scored")).first()[0]
    assert scored < 0.05 * 70 * 500
    assert "CartesianProduct" not in (plan := closest.closest(da, db, columns, "best", "best", kinds=kinds)._jdf.queryExecution().toString()) and "NestedLoop" not in plan
