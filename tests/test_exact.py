"""Exact identifiers and decimals, clashing column names, places of matches, amounts and one-to-one in rounds."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import predicates
from ledgerline.functions.predicates import all_matches
from ledgerline.functions.validators import extract_amount, validate_field
from ledgerline.operators import delta, edits, ingest, profile, recon, transform
from ledgerline.operators.delta import Compare, Key
from ledgerline.operators.recon import Rule
from ledgerline.session import free_name
from ledgerline.sources import files

#: Names that operators use for columns of their own.
CLASHING = ["rank", "slice", "within", "before", "_slice", "_within", "_before", "_n", "_all", "_key", "_hit", "_e", "_id", "_row", "_rule", "_at", "_one", "_gone", "_met", "_changes", "_a", "_b"]


def clashing(spark, rows=5):
    df = spark.range(rows).withColumnRenamed("id", "pos")
    return df.select("pos", *[(F.col("pos") * 100 + i).alias(c) for i, c in enumerate(CLASHING)])


def same_columns(out, df, by="pos"):
    want = {r[by]: tuple(r[c] for c in CLASHING) for r in df.collect()}
    got = [(r[by], tuple(r[c] for c in CLASHING)) for r in out.collect()]
    return len(got) >= 1 and all(want[k] == v for k, v in got)


def test_long_keys_and_numbers_are_told_apart(spark):
    a = spark.createDataFrame([("12345678901234567", 12345678901234567, "1"), ("12345678901234568", 12345678901234568, "2"), ("1e3", 3, "3"), ("-0.50", 4, "4"), (None, 5, "5")], "k string, v bigint, t string")
    b = spark.createDataFrame([("0012345678901234567.0", 12345678901234567, "1"), ("+12345678901234568", 12345678901234569, "2"), ("1000", 3, "3"), ("-.5", 4, "4"), (None, 5, "5")], "k string, v bigint, t string")
    got = {r.FileA_t: r.Delta_Type for r in delta.classified(a, b, [Key("k", "k")], [Compare("v", "v")]).collect()}
    assert got == {"1": "UNCHANGED", "2": "AMENDED", "3": "UNCHANGED", "4": "UNCHANGED", "5": "UNCHANGED"}
    x = spark.createDataFrame([(1, 12345678901234567)], "k int, v bigint")
    mixed = delta.classified(x, x.select("k", F.col("v").cast("string").alias("v")), [Key("v", "v")]).collect()
    assert [r.Delta_Type for r in mixed] == ["UNCHANGED"]
    doubles = spark.createDataFrame([(7.0, "a"), (0.1, "b"), (1e20, "c"), (1e-25, "d"), (0.0, "e")], "k double, n string")
    texts = spark.createDataFrame([("007", "a"), ("0.10", "b"), ("100000000000000000000", "c"), ("0.0000000000000000000000001", "d"), ("0", "e")], "k string, n string")
    assert {r.Delta_Type for r in delta.classified(doubles, texts, [Key("k", "k")]).collect()} == {"UNCHANGED"}


def test_decimals_keep_their_digits(spark):
    df = spark.sql("SELECT 1 AS k, CAST('0.12345678' AS DECIMAL(38,8)) AS x, CAST('0.12345699' AS DECIMAL(38,8)) AS y, CAST('0.1234567800' AS DECIMAL(38,10)) AS z")
    pairs = lambda right: recon.match_pairs(df, df, [Rule("x", right)], "k", "k").count()
    assert (pairs("y"), pairs("z"), pairs("x")) == (0, 1, 1)
    floating = df.select("k", F.lit(0.12345678).alias("d"))
    assert recon.match_pairs(df, floating, [Rule("x", "d")], "k", "k").count() == 1


def test_long_identifiers_stay_text(spark):
    df = spark.createDataFrame([("12345678901234567890", "12", "1.5", "0.1234567890123456789"), ("12345678901234567891", "13", "2", "1")], "a string, b string, c string, d string")
    assert dict(ingest.typed(df).dtypes) == {"a": "string", "b": "bigint", "c": "double", "d": "string"}


def test_clashing_names_stay(spark):
    df = clashing(spark)
    assert free_name(["_N", "_n_"], "n") == "_n__"
    assert same_columns(transform.sequence(df, "pos", "number"), df)
    ranked = recon.ranked(df, ["slice"], "pos", into="nth")
    assert same_columns(ranked, df) and {r.nth for r in ranked.collect()} == {1}
    assert same_columns(edits.update_cells(df, [(2, "pos2", 1), (1, "rank", 101 * 100 - 10000)], "pos").filter("pos <> 1"), df)
    left = edits.delete_rows(df, [0], "pos").collect()
    assert [(r.pos, r.slice) for r in sorted(left, key=lambda r: r.pos)] == [(i, (i + 1) * 100 + CLASHING.index("slice")) for i in range(4)]
    table = spark.createDataFrame([(0, "zero")], "key bigint, said string")
    looked = transform.lookup(df, table, "pos", "key", "said", "said", "none")
    assert same_columns(looked, df) and {r.pos: r.said for r in looked.collect()}[0] == "zero"
    for e in (transform.Expansion("duplicate", count=2), transform.Expansion("from_list", column="new", values=["a", "b"]), transform.Expansion("fixed", sets=[{"new": 1}])):
        assert same_columns(transform.expand(df, e), df)
    assert same_columns(transform.expand_by_rule(df, [transform.ChosenRule("pos > 2", transform.Expansion("duplicate", count=3))]), df)
    more = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "key bigint, extra string, at bigint")
    assert same_columns(transform.expand_from_table(df, more, [("pos", "key")], ["extra"], "at"), df)
    out = delta.classified(df, df, [Key("pos", "pos")])
    assert {f"FileA_{c}" for c in CLASHING} <= set(out.columns) and {r.Delta_Type for r in out.collect()} == {"UNCHANGED"}


@pytest.mark.parametrize("pattern", [r"\bab\b", "a*", "x|", "(?<=b)a", "zz", r"$", "b?a"])
def test_places_are_those_of_the_matches(spark, pattern):
    texts = ["cab ab ", "baac", "", "abab", "aab b", "é ab Жab ab", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", all_matches(F.col("t"), pattern).alias("m")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, t, re.I)]
        assert (got[i] and [tuple(m) for m in got[i]]) == (want or (want if want is None else [])), (pattern, t)


def test_amounts_of_both_styles(spark):
    said = {"1.250,75": 1250.75, "1,250.75": 1250.75, "EUR 1.234,50": 1234.5, "$1,234": 1234.0, "12,5 kr": 12.5, "1.234.567": 1234567.0, "3.": 3.0, "7": 7.0, "none": None, "v 1,234,567.8": 1234567.8}
    df = spark.createDataFrame(list(said.items()) + [(None, None)], "t string, want double")
    for r in df.select("t", "want", extract_amount(F.col("t")).alias("got"), validate_field("value", F.col("t")).alias("f"), validate_field("shoe", F.col("t")).alias("g")).collect():
        assert r.got == r.want, r
        assert r.f.is_valid == (r.want is not None) and (r.f.message == "") == r.f.is_valid and r.g.is_valid


@pytest.mark.parametrize("rounds", [0, 2, 50])
def test_one_to_one_in_rounds_is_the_ordered_pass(spark, rounds):
    rng = random.Random(rounds)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(300)})
    used_a, used_b, want = set(), set(), []
    for a, b in pairs:
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.append((a, b))
    df = spark.createDataFrame(pairs, "a_pos bigint, b_pos bigint")
    assert sorted(map(tuple, recon._one_to_one(df, [], rounds).collect())) == want


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], list(map(float, range(999))), [0.0] * 500 + [1.0] * 500, [3.0] * 700 + [9.0] * 10, [float((i * 7919) % 1009) for i in range(4000)]])
def test_median_of_many_rows(spark, values):
    import statistics

    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert profile.median(df, "v", most=50) == statistics.median(values)
    assert profile.median(df.limit(0), "v") is None


def test_statistics_and_profile_of_large_tables(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") % 100).alias("v"), (F.col("id") % 2).cast("string").alias("t"))
    whole = profile.statistics(df, ["v"]).collect()
    monkeypatch.setattr(profile, "MEDIAN_ROWS", 100)
    assert profile.statistics(df, ["v"]).collect() == whole and whole[0].median == 49.5
    exact = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert exact["v"].distinct_count == 100 and exact["t"].distinct_count == 2
    assert "Expand" not in profile.column_profile(df)._jdf.queryExecution().optimizedPlan().toString()
    assert [r.column_name for r in profile.column_profile(df, approximate=True).collect()] == ["v", "t"]


def test_filters_and_lookups_tell_types_and_last_digits_apart(spark):
    df = spark.createDataFrame([(12345678901234567, Decimal("0.10"), "5", True), (12345678901234568, Decimal("0.11"), "x", None), (-3, None, None, False)], "n bigint, d decimal(10,2), s string, b boolean")
    kept = lambda *f: [r.n for r in predicates.filtered(df, [predicates.Filter(*f)]).orderBy("n").collect()]
    assert kept("n", "equals", 12345678901234567) == [12345678901234567] and kept("n", "greater_than", "12345678901234567") == [12345678901234568] and kept("n", "less_than", 12345678901234568) == [-3, 12345678901234567]
    assert kept("n", "equals", -2.5) == [] and kept("n", "greater_than", -3.5) == [-3, 12345678901234567, 12345678901234568] and kept("n", "less_than", -2.5) == [-3] and kept("n", "less_than", 10**30) == kept("n", "greater_than", -(10**30)) == [-3, 12345678901234567, 12345678901234568]
    assert kept("d", "greater_than", "0.1") == [12345678901234568] and kept("d", "equals", 0.1) == [12345678901234567] and kept("s", "greater_than", 4) == [12345678901234567]
    typed = lambda c, *v: predicates.exact_filtered(df, [(c, v)]).count()
    assert (typed("n", "x", "-3"), typed("n", -3, None), typed("s", 5), typed("s", "5"), typed("b", True, 1), typed("b", "True")) == (0, 1, 0, 1, 1, 0)
    table = spark.createDataFrame([("-3", "text"), ("7", "other")], "k string, v string")
    assert {r.got for r in transform.lookup(df, table, "n", "k", "v", "got", "none").collect()} == {"none"} and {r.got for r in transform.lookup(df, table, "n", "k", "v", "got").collect()} == {None}


def test_columns_may_be_named_like_helpers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 3)], "_n int, _times int, x int")
    assert profile.duplicate_rows(df).first()[0] == 1
    rule = transform.Rule("r", [transform.Output("a", "direct", "_out0"), transform.Output("b", "direct", "_out1")])
    source = spark.createDataFrame([("zero", "one")], "_out0 string, _out1 string")
    assert tuple(transform.apply_rule(source, rule).first()) == ("zero", "one")
    a = spark.createDataFrame([(0, "x", 5), (1, "y", 6)], "pos int, k string, _taken int")
    out = recon.reconcile(a, a.filter("pos = 0"), [recon.Rule("k", "k")], "pos", "pos", selected_a=["_taken"])
    assert [r["_taken"] for r in out.unmatched_a.collect()] == [6]
    (tmp_path / "t.csv").write_text("_id,_file,_first\n1,2,3\n4,5,6\n")
    assert [r["_row_pos"] for r in files.read_csv(spark, f"file://{tmp_path}/t.csv", positions=True).orderBy("_row_pos").collect()] == [0, 1]


def test_deltas_see_every_digit(spark):
    wide = "123456789012345678901234567890"
    cases = [("equals", wide, wide[:-1] + "1", False), ("equals", wide, "+0" + wide + ".00", True), ("equals", wide + ".004", wide + ".001", True), ("equals", "x" * 40, "x" * 40 + " ", True)]
    cases += [("numeric_tolerance", "0.1234567890123456", "0.1234567890123999", False), ("numeric_tolerance", "0.10", ".1000000000000000000", True), ("numeric_tolerance", "1e3", "1000", True), ("numeric_tolerance", "5", "x", False)]
    for kind, x, y, same in cases:
        a, b = (spark.createDataFrame([(1, v)], "k int, v string") for v in (x, y))
        assert (delta.classified(a, b, [Key("k", "k")], [Compare("v", "v", kind)]).first()["Delta_Type"] == "UNCHANGED") == same, (kind, x, y)
