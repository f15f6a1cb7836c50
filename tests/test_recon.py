"""Reconciliation against plain Python, on rows with nulls, ties, repeated keys and odd text."""

import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.nearfree import Free
from ledgerline.functions.predicates import Extract, Filter, Pattern, all_matches, exact_filtered, extracted, filtered, pattern_column, value_filtered
from ledgerline.operators import recon
from ledgerline.operators.recon import Rule

SCHEMA = "pos bigint, ref string, amount double, day string, name string"
NAMES = ["Acme", "acme ", "Acme Ltd", None, "", "Zed"]


def rows(seed, n):
    rng = random.Random(seed)
    days = ["2024-01-05", "05/01/2024", "5-Jan-2024", "January 5, 2024", "06/01/2024", "soon", None]
    return [(i, rng.choice(["A", "a", "B", "c", None]), rng.choice([None, 0.0, 100.0, 100.004, 99.0, -100.0, round(rng.uniform(50, 150), 2)]), rng.choice(days), rng.choice(NAMES)) for i in range(n)]


def same(rule, x, y):
    a, b = x[1 + ["ref", "amount", "day", "name"].index(rule.left)], y[1 + ["ref", "amount", "day", "name"].index(rule.right)]
    if rule.kind == "equals":
        return a == b if a is None or b is None else str(a).lower() == str(b).lower()
    if rule.kind == "tolerance":
        if a is None or b is None:
            return a is b
        return abs(a - b) / abs(b) * 100 <= rule.tolerance if b else a == 0
    if rule.kind == "date_equals":
        known = {"2024-01-05": 5, "05/01/2024": 5, "5-Jan-2024": 5, "January 5, 2024": 5, "06/01/2024": 6}
        return known.get(a) == known.get(b)
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    if not a or not b:
        return a == b
    return sum(c in b for c in a) / max(len(a), len(b)) >= rule.tolerance


def by_hand(a, b, rules, mode):
    pairs = [(x[0], y[0]) for x in a for y in b if all(same(r, x, y) for r in rules)]
    if mode == "many_to_many":
        return sorted(pairs)
    used_a, used_b, out = set(), set(), []
    for x, y in sorted(pairs):
        if mode in ("one_to_many", "one_to_one") and x in used_a or mode in ("many_to_one", "one_to_one") and y in used_b:
            continue
        used_a.add(x)
        used_b.add(y)
        out.append((x, y))
    return sorted(out)


RULES = {
    "keys": [Rule("ref", "ref"), Rule("day", "day", "date_equals")],
    "key and amount": [Rule("ref", "ref"), Rule("amount", "amount", "tolerance", 1.0)],
    "amount alone": [Rule("amount", "amount", "tolerance", 0.5)],
    "wide amount": [Rule("amount", "amount", "tolerance", 40.0)],
    "exact amount": [Rule("amount", "amount", "tolerance", 0.0)],
    "fuzzy": [Rule("ref", "ref"), Rule("name", "name", "fuzzy", 0.7)],
}


@pytest.mark.parametrize("mode", recon.MODES)
@pytest.mark.parametrize("rules", RULES.values(), ids=RULES)
def test_modes_match_plain_python(spark, rules, mode):
    a, b = rows(1, 60), rows(2, 50)
    got = recon.match_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), rules, "pos", "pos", mode)
    assert sorted(map(tuple, got.collect())) == by_hand(a, b, rules, mode)


@pytest.mark.parametrize("mode", recon.MODES)
def test_hot_keys_meet_by_amount(spark, mode):
    a, b = rows(1, 60), rows(2, 50)
    got = recon.match_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), RULES["key and amount"], "pos", "pos", mode, hot_keys=True)
    assert sorted(map(tuple, got.collect())) == by_hand(a, b, RULES["key and amount"], mode)


@pytest.mark.parametrize("mode", ["many_to_many", "one_to_one"])
@pytest.mark.parametrize("rules", ["key and amount", "amount alone", "fuzzy"])
def test_dense_keys_are_dealt_out(spark, monkeypatch, mode, rules):
    """Equal rows in lists, cells cut into slices, keys with few pairs in order and others in rounds."""
    for name, value in {"DENSE": 0, "CELL": 8, "CELL_ROWS": 2, "LIST": 3, "SPAN": 16, "FEW_PAIRS": 6}.items():
        monkeypatch.setattr(recon, name, value)
    a, b = rows_of_few_values(1, 70), rows_of_few_values(2, 60)
    got = recon.match_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), RULES[rules], "pos", "pos", mode)
    assert sorted(map(tuple, got.collect())) == by_hand(a, b, RULES[rules], mode)


def rows_of_few_values(seed, n):
    return [(i, r[1], r[2] and float(round(r[2])), r[3], r[4]) for i, r in enumerate(rows(seed, n))]


def test_tasks_of_a_hot_key_stay_small(spark, monkeypatch):
    """No task writes out a large part of a hot key's pairs."""
    monkeypatch.setattr(recon, "DENSE", 1000)
    monkeypatch.setattr(recon, "CELL", 1000)
    monkeypatch.setattr(recon, "CELL_ROWS", 16)
    monkeypatch.setattr(recon, "TASK_PAIRS", 1000)
    df = spark.range(400).selectExpr("id AS pos", "'k' AS ref", "100 + id / 1000D AS amount")
    got = recon.match_pairs(df, df, RULES["key and amount"], "pos", "pos", "many_to_many")
    each = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == 160_000 and max(each) < 16_000


def spread(seed, n, amounts):
    """Rows of which most have one key."""
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.8 else rng.choice(["x", None]), rng.choice(amounts), None, rng.choice(NAMES)) for i in range(n)]


AMOUNTS = {
    "equal": [9.99, 9.99, 120.0, -4.0, 0.0, None],
    "steps": [10.0 * 1.004**i for i in range(12)] + [500.0, 501.0, 503.0, 505.0, -500.0, -503.0, 1e9],
    "edges": [100.0, 101.0, 102.01, 99.0, 98.01, 0.001, 0.00101],
}


@pytest.mark.parametrize("amounts", AMOUNTS.values(), ids=AMOUNTS)
@pytest.mark.parametrize("rules", [RULES["key and amount"], RULES["amount alone"], [*RULES["key and amount"], Rule("name", "name", "fuzzy", 0.7)], [Rule("ref", "ref"), Rule("amount", "amount", "tolerance", 1.0), Rule("amount", "amount", "tolerance", 0.3)]], ids=["key", "alone", "fuzzy too", "twice"])
def test_one_to_one_in_pieces(spark, rules, amounts):
    a, b = spread(5, 90, amounts), spread(6, 80, amounts)
    got = recon.match_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), rules, "pos", "pos", "one_to_one")
    assert sorted(map(tuple, got.collect())) == by_hand(a, b, rules, "one_to_one")


def test_pieces_part_a_hot_key(spark):
    """Rows of one key fall into pieces by gaps between amounts; pieces of near amounts make no pairs."""
    a, b = (spark.range(400).selectExpr("id AS pos", "'k' AS ref", f"IF(id % 2 = 0, 100.0, pow(1.1, id % 40 + 2) * {f}) AS amount") for f in (1.0, 1.004))
    rules = RULES["key and amount"]
    left, right = recon.in_pieces(recon._prepared(a, rules, True, "pos", b), recon._prepared(b, rules, False, "pos", a), rules, 1)
    pieces = left.groupBy("a_piece").agg(F.first("a_whole").alias("whole"), F.count("*").alias("n")).collect()
    assert len(pieces) == 21 and all(p["whole"] for p in pieces) and left.count() == right.count() == 400
    assert recon.match_pairs(a, b, rules, "pos", "pos", "one_to_one").filter("a_pos = b_pos").count() == 400
    alone = recon.in_pieces(recon._prepared(a, rules, True, "pos", b), recon._prepared(b.filter("amount <> 100"), rules, False, "pos", a), rules, 1)[0]
    assert alone.count() == 200  # a piece of one side only goes
    assert recon.match_pairs(a.limit(0), b, rules, "pos", "pos", "one_to_one").collect() == []


def test_one_to_one_by_amount_makes_no_pairs(spark, monkeypatch):
    """Round 4: all pairs of near amounts were written, so a key of n rows a side took n * n rows of disk."""
    written, keep = [], recon.Written.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(recon.Written, "keep", counted)
    n = 400
    a = spark.range(n).selectExpr("id AS pos", "'k' AS ref", "100 + pmod(id * 37, 400) / 20D AS amount")
    b = a.withColumn("amount", F.col("amount") * 0.99)
    rules = [Rule("ref", "ref"), Rule("amount", "amount", "tolerance", 15.0)]
    got = recon.match_pairs(a, b, rules, "pos", "pos", "one_to_one")
    rows = [[(r.pos, "k", r.amount, None, None) for r in df.collect()] for df in (a, b)]
    assert sorted(map(tuple, got.collect())) == by_hand(*rows, rules, "one_to_one")
    assert max(written) <= 2 * n


@pytest.mark.parametrize("amounts", AMOUNTS.values(), ids=AMOUNTS)
@pytest.mark.parametrize("rules", ["key and amount", "amount alone", "wide amount"])
def test_one_to_one_of_hot_keys_meets_block_by_block(spark, monkeypatch, rules, amounts):
    """Keys of many rows fall into pieces, and pieces into blocks of either side that meet in turn."""
    for name, value in {"HOT_ROWS": 20, "BLOCK_ROWS": 9, "COUNTERS": 2}.items():
        monkeypatch.setattr(recon, name, value)
    a, b = spread(7, 70, amounts), spread(8, 60, amounts)
    got = recon.match_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), RULES[rules], "pos", "pos", "one_to_one")
    assert sorted(map(tuple, got.collect())) == by_hand(a, b, RULES[rules], "one_to_one")


@pytest.mark.parametrize("percent", [0.3, 1.0, 20.0, 49.9])
def test_first_free_row_of_a_near_amount(percent):
    """Against a list of all rows: amounts at the very edge of the tolerance, either sign, zero, null (infinite), the least and largest doubles."""
    rng = random.Random(9)
    amounts = [0.0, -0.0, math.inf, 5e-324, 1e-323, 1.7e308, -1.7e308]
    for x in [100.0, -3.7, 900.68, 1e-310, 1e16]:
        for y in (x, x / (1 + percent / 100), x / (1 - percent / 100), x * (1 - percent / 100), x * (1 + percent / 100)):
            amounts += [y, y, math.nextafter(y, math.inf), math.nextafter(y, -math.inf)]
    near = lambda x, y: x == y if not x or math.isinf(x) or not y or math.isinf(y) else abs(x - y) / abs(y) * 100 <= percent
    for _ in range(20):
        b = rng.sample(amounts, len(amounts) - 3)
        left, free = dict(enumerate(b)), Free(b, percent)
        for x in rng.choices(amounts, k=90):
            want = next((i for i, y in left.items() if near(x, y)), None)
            assert free.take(x) == want
            left.pop(want, None)


def test_reconciled_sides_add_up(spark):
    a, b = rows(3, 80), rows(4, 70)
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    out = recon.reconcile(left, right, RULES["key and amount"], "pos", "pos", persist=True, selected_a=["pos"], selected_b=["name"])
    assert out.matched.columns == ["FileA_pos", "FileA_ref", "FileA_amount", "FileB_ref", "FileB_amount", "FileB_name"]
    assert out.matched.count() + out.unmatched_a.count() == 80
    s = recon.summary(left, right, out.pairs).first()
    assert (s.total_a, s.total_b, s.unmatched_a) == (80, 70, out.unmatched_a.count()) and s.unmatched_b == out.unmatched_b.count()


def test_positional_and_nested_loop(spark):
    a, b = rows(5, 40), rows(6, 45)
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    rule = [Rule("name", "name", "fuzzy", 0.7)]
    got = recon.match_pairs(left, right, rule, "pos", "pos", positional=True)
    assert sorted(r.a_pos for r in got.collect()) == [x[0] for x, y in zip(a, b) if same(rule[0], x, y)]
    with pytest.raises(ValueError, match="nested_loop"):
        recon.match_pairs(left, right, rule, "pos", "pos")
    every = recon.match_pairs(left, right, rule, "pos", "pos", "many_to_many", nested_loop=True)
    assert sorted(map(tuple, every.collect())) == by_hand(a, b, rule, "many_to_many")


def test_configuration_is_checked(spark):
    df = spark.createDataFrame(rows(1, 3), SCHEMA)
    for bad in (lambda: Rule("a", "b", "like"), lambda: Rule("a", "b", "tolerance"), lambda: recon.match_pairs(df, df, [Rule("none", "ref")], "pos", "pos"), lambda: recon.match_pairs(df, df, RULES["keys"], "pos", "pos", "best"), lambda: recon.match_pairs(df, df, [], "pos", "pos")):
        with pytest.raises(ValueError):
            bad()


def test_empty_tables(spark):
    df = spark.createDataFrame(rows(1, 5), SCHEMA)
    for rules in RULES.values():
        for mode in recon.MODES:
            assert recon.match_pairs(df, df.limit(0), rules, "pos", "pos", mode).count() == 0
    s = recon.summary(df.limit(0), df.limit(0), recon.match_pairs(df.limit(0), df.limit(0), RULES["keys"], "pos", "pos")).first()
    assert s.match_percentage == 0.0


def test_ranks_across_slices(spark):
    df = spark.createDataFrame([(i * 3, None if i % 4 == 0 else "k") for i in range(100)], "pos bigint, key string")
    got = {r.pos: r["rank"] for r in recon.ranked(df, ["key"], "pos", slice_rows=7).collect()}
    seen = {}
    for i in range(100):
        key = i % 4 == 0
        seen[key] = seen.get(key, 0) + 1
        assert got[i * 3] == seen[key]


def test_equals_only_joins_are_equi_joins(spark):
    df = spark.createDataFrame(rows(1, 5), SCHEMA)
    plan = recon.match_pairs(df, df, RULES["amount alone"], "pos", "pos")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# ------------------------------------------------------ filters and extraction


def test_copies_of_few_values_are_dealt_out(spark, monkeypatch):
    """Round 3: slices were sized by distinct values, so all pairs of a value that many rows share were written by one task."""
    for name, value in {"DENSE": 0, "CELL": 10_000, "CELL_ROWS": 100, "LIST": 50}.items():
        monkeypatch.setattr(recon, name, value)
    a = spark.range(1000).selectExpr("id", "'k' AS k", "100.0D AS x")
    out = recon.match_pairs(a, a, [Rule("k", "k"), Rule("x", "x", "tolerance", 1.0)], "id", "id", "many_to_many")
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 1_000_000 and len(tasks) > 1 and max(tasks) < 500_000
    assert out.distinct().count() == 1_000_000


def test_filters(spark):
    df = spark.createDataFrame([(1, "Ab", 5.0), (2, None, None), (3, "ab", 7.0), (4, "x.y", 5.0)], "id int, t string, n double")
    ids = lambda *f: [r.id for r in filtered(df, [Filter(*x) for x in f]).orderBy("id").collect()]
    assert ids(("t", "equals", "AB")) == [1, 3] and ids(("n", "equals", 5)) == [1, 4]
    assert ids(("t", "not_equals", "ab")) == [2, 4]  # null is kept
    assert ids(("n", "greater_than", "5")) == [3] and ids(("n", "less_than", 6)) == [1, 4]
    assert ids(("t", "contains", "X.")) == [4] and ids(("t", "in", "AB, z")) == [1, 3]
    assert ids(("t", "in", "ab"), ("n", "equals", 7)) == [3]
    with pytest.raises(ValueError):
        ids(("t", "like", "x"))
    assert [r.id for r in exact_filtered(df, [("n", [5.0, 7.0]), ("t", ["ab"])]).collect()] == [3]


def test_value_filter_falls_back_on_dates(spark):
    df = spark.createDataFrame([(1, "2024-01-05", "a "), (2, "2024-01-06", None), (3, None, "b")], "id int, d string, t string")
    ids = lambda f: sorted(r.id for r in value_filtered(df, f).collect())
    assert ids([("d", ["05/01/2024"])]) == [1] and ids([("d", ["2024-01-06", "null"])]) == [2, 3]
    assert ids([("t", ["a", ""])]) == [1, 2] and ids([("zzz", ["a"])]) == [1, 2, 3]


def test_extraction_and_patterns(spark):
    df = spark.createDataFrame([(1, "Amount: $1,234.50 due"), (2, "price: 12"), (3, "nothing"), (4, None), (5, "$0 and 1,000,000.00")], "id int, note string")
    out = {r.id: r for r in extracted(df, [Extract("amount", "note", [r"[a-z]+"]), Extract("word", "note", ["DUE", "not"], when=Pattern(pattern="o"))]).collect()}
    assert [out[i].amount for i in range(1, 6)] == ["1234.50", "12", "nothing", None, "1000000.00"]
    assert [out[i].word for i in range(1, 6)] == [None, None, "not", None, None] or out[1].word == "due"
    tree = Pattern(operator="AND", conditions=[Pattern(patterns=["amount", "price"]), Pattern(pattern=r"\d")])
    assert [r.id for r in df.filter(pattern_column(F.col("note"), tree)).collect()] == [1, 2]
    got = df.filter("id = 5").select(all_matches(F.col("note"), r"\d+").alias("m")).first().m
    assert [(m.match, m.start, m.end) for m in got] == [("0", 1, 2), ("1", 7, 8), ("000", 9, 12), ("000", 13, 16), ("00", 17, 19)]


def test_dates(spark):
    from ledgerline.functions.canon import day_of

    known = {
        "2024-02-29": "2024-02-29", "2023-02-29": None, "03/04/2024": "2024-04-03", "12/31/2023": "2023-12-31", "03-04-2024": "2024-03-04", "31-04-2024": None, "25.12.2023": "2023-12-25",
        "1-Sep-24": "2024-09-01", "Sept 1, 1999": "1999-09-01", "20240131": "2024-01-31", "31012024": "2024-01-31", "2024-01-05T10:11:12": "2024-01-05", "5/1/69": "1969-01-05", "12345": None, "12.5": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in [*known, None]], "t string")
    got = {r.t: r.d for r in df.select("t", day_of(F.col("t")).alias("d")).collect()}
    assert got == known | {None: None}
    assert spark.createDataFrame([(date(2024, 1, 2),)], "d date").select(F.date_format("d", "yyyy-MM-dd")).first()[0] == "2024-01-02"
