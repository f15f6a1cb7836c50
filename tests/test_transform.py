"""Transformation, expansion, mappings, validation, expressions."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.expressions import condition, dynamic, formula, template
from ledgerline.operators import transform as t
from ledgerline.operators.transform import Case, Check, ColumnMap, Expansion, Output, OutputColumn, Rule


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "John", "Smith", 15000.5, "Premium", "x-1"), (2, "Mary", None, 750.0, "Basic", "1,200"), (3, "Ann", "O'Neil", None, None, "abc"), (4, "Zoë", "B", 25000.0, "VIP", "-5")]
    return spark.createDataFrame(rows, "id int, first string, last string, balance double, kind string, code string").persist()


def column(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


def test_templates(people):
    assert column(people, template(people, "{first} {last}")) == ["John Smith", "Mary", "Ann O'Neil", "Zoë B"]
    assert column(people, template(people, "{kind} account with balance ${balance}"))[0] == "Premium account with balance $15000.5"
    # the template decides what is arithmetic, never the data
    assert column(people, template(people, "{code} {first}")) == ["x-1 John", "1,200 Mary", "abc Ann", "-5 Zoë"]
    assert column(people, template(people, "{balance} * 2 + 1")) == [30002.0, 1501.0, None, 50001.0]
    assert column(people, template(people, "round({balance} / {id}, 1)")) == [15000.5, 375.0, None, 6250.0]
    assert column(people, template(people, "{balance} / ({id} - 1)"))[0] is None
    assert column(people, template(people, "{unknown} - {first}")) == ["{unknown} - {first}"] * 4
    assert column(people, template(people, 7)) == [7] * 4 and column(people, template(people, "plain - text")) == ["plain - text"] * 4


@pytest.mark.parametrize("text,want", [
    ("id > 1 and balance < 1000", [False, True, False, False]),
    ("not (kind == 'Basic') or id == 2", [True, True, True, True]),
    ("1 < id <= 3", [False, True, True, False]),
    ("kind in ['Basic', 'VIP']", [False, True, False, True]),
    ("'oh' in first", [True, False, False, False]),
    ("last is None", [False, True, False, False]),
    ("len(first) == 4 && id != 2", [True, False, False, False]),
    ("bool(balance)", [True, True, False, True]),
    ("", [True] * 4),
])
def test_conditions(people, text, want):
    assert column(people, condition(people, text)) == want


@pytest.mark.parametrize("text,want", [
    ("id ** 2 - -id", [2.0, 6.0, 12.0, 20.0]),
    ("id % 3", [1.0, 2.0, 0.0, 1.0]),
    ("min(id, 2) + max(id, 3) + abs(-1) + int(2.7) + float('1')", [8.0, 9.0, 9.0, 10.0]),
    ("'big' if balance > 1000 else 'small'", ["big", "small", "small", "big"]),
    ("str(balance)", ["15000.5", "750", None, "25000"]),
    ("'a' + 'b'", ["ab"] * 4),
])
def test_formulas(people, text, want):
    assert column(people, formula(people, text).column) == want


@pytest.mark.parametrize("text", ["__import__('os')", "first.upper()", "open('x')", "[x for x in first]", "lambda: 1", "nothing + 1", "id; id", "eval('1')"])
def test_nothing_else_is_a_formula(people, text):
    with pytest.raises((ValueError, SyntaxError)):
        formula(people, text)


def test_dynamic_operators(people):
    got = lambda *a: column(people, dynamic(people, *a))
    assert got("balance", ">=", "15,000") == [True, False, False, True]
    assert got("code", ">", "100") == [True, True, True, False]  # text where a side is no number
    assert got("code", "<", 0) == [False, False, False, True]
    assert got("kind", "!=", "VIP") == [True, True, True, False] and got("kind", "==", "nan") == [False, False, True, False]
    assert got("first", "contains", "a") == [False, True, False, False] and got("first", "startsWith", "J")[0] and got("first", "endsWith", "ë")[3]
    with pytest.raises(ValueError):
        dynamic(people, "first", "~", "x")


def test_rules(people):
    rule = Rule("r", [Output("Balance", "static", value="{balance} * 2"), Output("twice", "static", value="{Balance} * 2"), Output("tier", "dynamic", cases=[Case("Balance", ">", 40000, "top {first}"), Case("gone", "==", 1, "never"), Case("kind", "==", "Basic", "low")], default="mid")])
    out = t.transform(people, [rule])["merged"]
    assert out.columns == ["Balance", "twice", "tier"]
    assert [tuple(r) for r in out.collect()] == [(30001.0, 60002.0, "mid"), (1500.0, 3000.0, "low"), (None, None, "mid"), (50000.0, 100000.0, "top Zoë")]
    two = t.transform(people, [rule, Rule("s", [Output("id", "direct", "id")])], merge=False)
    assert set(two) == {"r", "s"} and two["s"].count() == 4
    with pytest.raises(ValueError):
        t.transform(people, [Rule("r", [], enabled=False)])
    with pytest.raises(ValueError):
        t.apply_rule(people, Rule("r", [Output("x", "magic")]))


def test_expansions(people):
    n = lambda e: t.expand(people, e).count()
    assert n(Expansion("duplicate", count=3)) == 12 and n(Expansion("duplicate", count=0)) == 0
    out = t.expand(people, Expansion("fixed", sets=[{"kind": "A"}, {"extra": 1}])).orderBy("id", "_expansion_index").collect()
    assert [(r.kind, r.extra) for r in out[:2]] == [("A", None), ("Premium", "1")]
    assert n(Expansion("conditional", condition="id > 2", sets=[{"x": 1}, {"x": 2}], other=[{"x": 0}])) == 6
    with pytest.raises(ValueError):
        n(Expansion("scatter"))
    chosen = t.expand_by_rule(people, [t.ChosenRule("id == 1", Expansion("duplicate", count=3)), t.ChosenRule("id < 3", Expansion("duplicate", count=2), 1)])
    assert chosen.count() == 3 + 2 + 1 + 1


def test_lookup_sequence_and_functions(spark, people):
    table = spark.createDataFrame([(3, "VIP", "late"), (1, "VIP", None), (2, "Basic", "b"), (4, None, "never")], "pos int, k string, v string")
    assert column(t.lookup(people, table, "kind", "k", "v", "got", "dflt", "pos"), "got") == ["dflt", "b", "dflt", None]
    assert column(t.sequence(people, "id", "n", -1, 1, "<", ">", 3, slice_rows=2), "n") == ["<-01>", "<000>", "<001>", "<002>"]
    t.register("initials", lambda a, b: F.concat(F.substring(a, 1, 1), F.coalesce(F.substring(b, 1, 1), F.lit("?"))))
    maps = [ColumnMap("i", "function", source="first, last", value="initials"), ColumnMap("c", "static", value=3), ColumnMap("none", "direct", "x.absent")]
    assert [tuple(r) for r in t.map_columns(people.orderBy("id"), maps).collect()][:2] == [("JS", 3, None), ("M?", 3, None)]
    with pytest.raises(ValueError):
        t.map_columns(people, [ColumnMap("x", "function", value="unknown")])


def test_validation_and_format(people):
    got = t.validate(people, [OutputColumn("id"), OutputColumn("kind", allowed=["VIP", "Basic"]), OutputColumn("nope")], [Check("required", "balance"), Check("format", "first", "[A-Z]", "warning"), Check("required", "last", severity="warning")])
    assert got["errors"] == ["Missing required columns: nope", "Column 'balance' has 1 null values"] and not got["passed"]
    assert got["warnings"] == ["Column 'kind' contains values not in allowed list", "Column 'last' has 1 null values"]
    out = t.formatted(people, [OutputColumn("balance", decimals=0), OutputColumn("new", default="d"), OutputColumn("id", text=True)])
    assert out.columns == ["balance", "new", "id"] and out.schema["id"].dataType.simpleString() == "string"


def test_expand_from_table(spark, people):
    items = spark.createDataFrame([(1, "Basic", "p"), (2, "Basic", "q")], "pos int, k string, item string")
    got = t.expand_from_table(people, items, [("kind", "k")], ["item"], "pos").orderBy("id", "_expansion_index").collect()
    assert [(r.id, r.item, r._expansion_index) for r in got] == [(1, None, 0), (2, "p", 0), (2, "q", 1), (3, None, 0), (4, None, 0)]
