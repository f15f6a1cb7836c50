"""Chained transformations, aggregates, percentiles of groups, deep pages, matches with groups, storage."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.predicates import group_matches
from ledgerline.operators import engine, profile
from ledgerline.operators import transform as t
from ledgerline.operators.engine import Chain, Lookup, Numbering
from ledgerline.operators.percentiles import percentiles
from ledgerline.operators.transform import Check, ChosenRule, ColumnMap, Expansion, OutputColumn
from ledgerline.sources.pages import Pages, write_pages


def _by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.mark.parametrize("large", [10, 200, 10**6])
def test_percentiles_against_numpy(spark, large):
    rng = random.Random(7)
    rows = [("hot", rng.gauss(0, 100)) for _ in range(3000)] + [("same", 4.5)] * 900 + [(None, float(rng.randint(0, 3))) for _ in range(500)]
    rows += [(f"g{i}", rng.random()) for i in range(60) for _ in range(i % 7 + 1)] + [("nothing", None), ("nothing", None), ("hot", None), ("ends", float("inf")), ("ends", float("-inf")), ("ends", 1.0)]
    rng.shuffle(rows)
    wanted = {"least": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "most": 1.0}
    got = _by(percentiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", wanted, large, "n"), "k")
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).extend([] if v is None else [v])
    assert set(got) == {(k,) for k in groups}
    for k, values in groups.items():
        r = got[(k,)]
        assert r["n"] == len(values)
        for name, share in wanted.items():
            if not values:
                assert r[name] is None
            elif k != "ends":
                assert r[name] == pytest.approx(np.percentile(values, share * 100), abs=1e-9)
    assert (got[("ends",)]["least"], got[("ends",)]["mid"], got[("ends",)]["most"]) == (float("-inf"), 1.0, float("inf"))


def test_percentiles_that_a_sketch_misses_are_exact(spark, monkeypatch):
    """Sketches of two values an end are far off, so the whole group is put in order."""
    from ledgerline.operators import percentiles as module

    monkeypatch.setattr(module, "ACCURACY", 2)
    values = [float(i * i % 1009) for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    for share in (0.25, 0.5, 0.9):
        assert percentiles(df, [], "v", {"p": share}, 100).first()["p"] == pytest.approx(np.percentile(values, share * 100))


def test_percentiles_of_awkward_tables(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert percentiles(empty, ["k"], "v", {"p": 0.5}).count() == 0
    assert percentiles(empty, [], "v", {"p": 0.5}, count_as="n").collect() == [(0, None)]
    # columns named like the helpers, a key that is the value, two keys of which one is null
    clash = spark.createDataFrame([(1, None, 1), (1, None, 3), (2, 5, 9)], "b int, n int, v int")
    assert {tuple(r) for r in percentiles(clash, ["b", "n"], "v", {"s": 0.5, "r": 1.0}, 1).collect()} == {(1, None, 2.0, 3.0), (2, 5, 9.0, 9.0)}
    assert {tuple(r) for r in percentiles(clash, ["v"], "v", {"i": 0.5}).collect()} == {(1, 1.0), (3, 3.0), (9, 9.0)}
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")
    assert percentiles(odd, [], "v", {"p": 0.5}).first()["p"] == 2.0
    with pytest.raises(ValueError, match="between 0 and 1"):
        percentiles(odd, [], "v", {"p": 1.5})


def test_pages(spark, tmp_path):
    rng = random.Random(3)
    # one value holds a third of the rows, some rows are equal altogether
    rows = [(5 if i % 3 == 0 else rng.randint(0, 40), rng.randint(0, 9), f"t{i % 50}") for i in range(4000)]
    df = spark.createDataFrame(rows, "a int, b int, _place string").repartition(6)
    write_pages(df, ["a", F.desc("b")], str(tmp_path / "pages"))
    table = Pages(spark, str(tmp_path / "pages"))
    assert table.count() == 4000
    each = [table.page(n, 90).collect() for n in range(1, 47)]
    assert [len(p) for p in each] == [90] * 44 + [40, 0] and table.page(1).columns == df.columns
    seen = [tuple(r) for p in each for r in p]
    assert sorted(seen) == sorted(rows) and [r[:2] for r in seen] == sorted((r[:2] for r in rows), key=lambda r: (r[0], -r[1]))
    assert table.page(0, 5, ["b"]).collect() == table.page(1, 5, ["b"]).collect() and table.page(1, 5000, most=1000).count() == 1000
    plan = table.page(30, 90)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(_place_" in plan


def test_pages_of_an_empty_table(spark, tmp_path):
    write_pages(spark.createDataFrame([], "a int"), "a", str(tmp_path / "none"))
    none = Pages(spark, str(tmp_path / "none"))
    assert none.count() == 0 and none.page(1).collect() == [] and none.page(1).columns == ["a"]
    with pytest.raises(ValueError, match="has no column z"):
        write_pages(spark.createDataFrame([], "a int"), "z", str(tmp_path / "bad"))


def test_group_matches_are_those_of_python(spark):
    pattern = r"(?P<word>[a-zé]+)(\d)?(?=[ .])"
    texts = [None, "", "Ab1 cd. é9 🙂 xyz ", "no match9", "a " * 50, "x" * 30_000 + "7."]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", group_matches(F.col("t"), pattern).alias("m"), group_matches(F.col("t"), pattern, None).alias("every")).orderBy("id").collect()
    for text, r in zip(texts, got):
        want = [(m[0], m.start(), len(m[0]), list(m.groups())) for m in re.finditer(pattern, text or "", re.I)]
        assert [tuple(x) for x in r["m"]] == want[:20] and [tuple(x) for x in r["every"]] == want
    with pytest.raises(ValueError, match="Invalid regex pattern"):
        group_matches(F.col("t"), "(")


def test_storage(spark):
    df = spark.createDataFrame([(1, "é", [1, 2], None), (None, None, None, None)], "i int, s string, a array<int>, `odd.name` double")
    got = {r[0]: tuple(r)[1:] for r in profile.storage(df).collect()}
    assert got == {"i": ("int", 1, 1, 4), "s": ("string", 1, 1, 2), "a": ("array<int>", 1, 1, 5), "odd.name": ("double", 0, 2, 0)}
    assert [r["memory_bytes"] for r in profile.storage(df.limit(0)).collect()] == [0] * 4


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(1, "a", 10.0, "5"), (2, "a", 20.0, "x"), (3, "b", None, "7"), (4, None, 40.0, None), (5, None, 1.0, "1,5"), (6, "a", 90.0, " 4 ")]
    return spark.createDataFrame(rows, "id int, shop string, amount double, said string").persist()


def test_aggregate_mappings(sales):
    got = _by(t.map_columns(sales, [
        ColumnMap("total", "aggregate", "sales.amount", "sum"), ColumnMap("shop", "direct", "shop"), ColumnMap("amount", "aggregate", "amount", "median"), ColumnMap("_rows", "aggregate", "", "count_rows"),
        ColumnMap("known", "aggregate", "amount", "count"), ColumnMap("said", "aggregate", "said", "sum"), ColumnMap("last", "aggregate", "said", "max"), ColumnMap("values", "aggregate", "id", "median"),
    ]), "shop")
    assert {k[0]: tuple(r) for k, r in got.items()} == {"a": (120.0, "a", 20.0, 3, 3, 9.0, "x", 2.0), "b": (None, "b", None, 1, 0, 7.0, "7", 3.0), None: (41.0, None, 20.5, 2, 2, None, "1,5", 4.5)}


def test_aggregates_of_a_whole_table(sales):
    maps = [ColumnMap("n", "aggregate", "", "count_rows"), ColumnMap("mid", "aggregate", "amount", "median"), ColumnMap("shops", "aggregate", "shop", "count_distinct")]
    assert t.map_columns(sales, maps).collect() == [(6, 20.0, 2)]
    assert t.map_columns(sales.limit(0), maps).collect() == [(0, None, 0)]
    assert t.map_columns(sales.limit(0), [*maps, ColumnMap("shop", "direct", "shop")]).collect() == []
    for wrong in (ColumnMap("x", "aggregate", "amount", "product"), ColumnMap("x", "aggregate", "no_such", "sum")):
        with pytest.raises(ValueError, match="aggregate"):
            t.map_columns(sales, [wrong])


def test_chain(spark, sales):
    shops = spark.createDataFrame([("a", "Alpha", 2), ("a", "First", 1), ("b", None, 1)], "code string, name string, pos int")
    chain = Chain(
        [ColumnMap("id", "direct", "id"), ColumnMap("copy", "direct", "_expansion_index"), ColumnMap("name", "direct", "shop_name"), ColumnMap("half", "expression", formula="{a} / 2", variables={"a": "amount"})],
        [OutputColumn("id"), OutputColumn("copy"), OutputColumn("name"), OutputColumn("half", decimals=1), OutputColumn("extra", default="e")],
        [ChosenRule("amount > 50", Expansion("duplicate", count=2), 1), ChosenRule("", Expansion("duplicate", count=9), 0, enabled=False), ChosenRule("amount > 15", Expansion("duplicate", count=3), 2)],
        [Lookup("shops", "shop", "code", "name", "shop_name", "none", "pos")],
        checks=[Check("required", "name"), Check("required", "half", severity="warning")],
    )
    out = engine.run({"sales": sales, "shops": shops}, chain)
    assert sorted(map(tuple, out.rows.collect()), key=str) == sorted(
        [(1, 0, "First", 5.0, "e"), *[(2, i, "First", 10.0, "e") for i in range(3)], (3, 0, None, None, "e"), *[(4, i, "none", 20.0, "e") for i in range(3)], (5, 0, "none", 0.5, "e"), *[(6, i, "First", 45.0, "e") for i in range(2)]], key=str)
    assert out.findings == {"errors": ["Missing required columns: extra", "Column 'name' has 1 null values"], "warnings": ["Column 'half' has 1 null values"], "passed": False}
    assert out.preview().count() == 10 and out.preview(3).count() == 3 and out.preview(0).count() == 0


def test_chain_of_numbers_and_aggregates(spark, sales):
    chain = Chain([ColumnMap("n", "direct", "_no"), ColumnMap("id", "direct", "id")], numberings=[Numbering("id", "_no", 5, 5, "N", padding=3)])
    assert sorted(map(tuple, engine.run({"sales": sales}, chain).rows.collect())) == [(f"N{5 * i:03d}", i) for i in range(1, 7)]
    folded = Chain([ColumnMap("shop", "direct", "shop"), ColumnMap("n", "aggregate", "", "count_rows")], expansions=[ChosenRule("shop == 'b'", Expansion("duplicate", count=4))], primary="sales")
    assert {tuple(r) for r in engine.run({"other": sales.limit(0), "sales": sales}, folded).rows.collect()} == {("a", 3), ("b", 4), (None, 2)}
    assert engine.run({"sales": sales.limit(0)}, chain).rows.collect() == []
    for sources, wrong in (({}, chain), ({"sales": sales}, Chain([], primary="x")), ({"sales": sales}, Chain([], lookups=[Lookup("x", "id", "id", "id", "y")]))):
        with pytest.raises(ValueError, match="source"):
            engine.run(sources, wrong)


def test_preview_of_rules(sales):
    rules = [t.Rule(i, [t.Output("id", "direct", "id"), t.Output("rule", "static", value=i)]) for i in ("one", "two")]
    assert [r["rule"] for r in engine.preview(t.transform(sales, rules, merge=False), 2).collect()] == ["one", "one"]
    assert engine.preview(t.transform(sales, rules)).count() == 10
