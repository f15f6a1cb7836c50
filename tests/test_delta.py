"""Deltas against plain Python and by their laws."""

import random

import pytest

from ledgerline.operators import delta
from ledgerline.operators.delta import Compare, Key

SCHEMA = "pos bigint, id string, amount double, state string, day string"


def rows(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice([None, *map(str, range(40)), "007", "x", "X "]), rng.choice([None, 1.0, 1.004, 1.02, 2.5, 0.0]), rng.choice(["open", " open", "OPEN", "shut", None]), rng.choice(["2024-01-05", "05/01/2024", "never", None])) for i in range(n)]


def key_of(v):
    if v is None:
        return None
    try:
        return float(v)
    except ValueError:
        return v.strip()


def changed(r, x, y):
    a, b = x[SCHEMA_AT[r.left]], y[SCHEMA_AT[r.right]]
    if a is None or b is None:
        return a is not b
    if r.kind == "case_insensitive":
        return a.strip().lower() != b.strip().lower()
    if r.kind == "date_equals":
        d = {"2024-01-05": 1, "05/01/2024": 1}
        return d.get(a) != d.get(b)
    if r.kind == "numeric_tolerance":
        return not (abs(a - b) / abs(b) * 100 <= r.tolerance if b else a == 0) if r.tolerance is not None else a != b
    return round(a, 2) != round(b, 2) if isinstance(a, float) else a.strip() != b.strip()


SCHEMA_AT = {"amount": 2, "state": 3, "day": 4}
COMPARES = [Compare("amount", "amount"), Compare("state", "state", "case_insensitive"), Compare("day", "day", "date_equals")]


@pytest.mark.parametrize("compares", [COMPARES, [Compare("amount", "amount", "numeric_tolerance", 1.0), Compare("state", "state")], [Compare("amount", "amount", "numeric_tolerance")]])
def test_classification_matches_plain_python(spark, compares):
    a, b = rows(1, 60), rows(2, 60)
    first = lambda rows: {key_of(r[1]): r for r in reversed(rows)}
    old, new = first(a), first(b)
    want = {}
    for k in old.keys() | new.keys():
        if k not in new:
            want[k] = ("DELETED", None)
        elif k not in old:
            want[k] = ("NEWLY_ADDED", None)
        else:
            n = sum(changed(r, old[k], new[k]) for r in compares)
            want[k] = ("AMENDED", n) if n else ("UNCHANGED", None)
    got = delta.classified(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), [Key("id", "id")], compares, "pos", "pos").collect()
    assert {key_of(r.FileA_id if r.FileA_pos is not None else r.FileB_id): (r.Delta_Type, r.Total_Changes) for r in got} == want
    assert all((r.FileA_pos is None or r.FileA_pos == old[key_of(r.FileA_id)][0]) for r in got)


def test_delta_with_itself_is_unchanged(spark):
    a = spark.createDataFrame(rows(3, 50), SCHEMA)
    assert {r.Delta_Type for r in delta.classified(a, a, [Key("id", "id")], None, "pos", "pos").collect()} == {"UNCHANGED"}


def test_deleted_and_added_change_places(spark):
    a, b = spark.createDataFrame(rows(4, 40), SCHEMA), spark.createDataFrame(rows(5, 40), SCHEMA)
    one, two = (delta.summary(delta.classified(x, y, [Key("id", "id")], None, "pos", "pos")).first() for x, y in ((a, b), (b, a)))
    assert (one.deleted, one.newly_added, one.unchanged) == (two.newly_added, two.deleted, two.unchanged)


def test_changes_are_spelled_out(spark):
    cols = [f"c{i}" for i in range(7)]
    schema = "id int, " + ", ".join(f"{c} string" for c in cols)
    a = spark.createDataFrame([(1, *["x"] * 7), (2, *["x"] * 7)], schema)
    b = spark.createDataFrame([(1, *["y"] * 6, None), (3, *["x"] * 7)], schema)
    got = {r.Delta_Type: r for r in delta.classified(a, b, [Key("id", "id")]).collect()}
    assert got["AMENDED"].Changes == "; ".join(f"c{i}: 'x' -> 'y'" for i in range(5)) and got["AMENDED"].Total_Changes == 7
    assert got["DELETED"].Changes == delta.DELETED_TEXT and got["NEWLY_ADDED"].Changes == delta.ADDED_TEXT
    sets = delta.categories(delta.classified(a, b, [Key("id", "id")]))
    assert {k: v.count() for k, v in sets.items()} == {"unchanged": 0, "amended": 1, "deleted": 1, "newly_added": 1, "all_changes": 3, "all_combined": 3}


def test_selected_columns_and_empty_tables(spark):
    a = spark.createDataFrame(rows(1, 5), SCHEMA)
    out = delta.classified(a, a.limit(0), [Key("id", "id")], [Compare("amount", "amount")], "pos", "pos", selected_a=["state"], selected_b=["day"])
    assert [c for c in out.columns if c.startswith("File")] == ["FileA_id", "FileA_state", "FileB_id", "FileB_day"]
    assert delta.summary(delta.classified(a.limit(0), a.limit(0), [Key("id", "id")])).first().total_records == 0
    assert {r.Delta_Type for r in out.collect()} == {"DELETED"}


def test_duplicates_and_wrong_configuration(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "pos int, id string")
    assert sorted(((r.id or ""), r.rows) for r in delta.duplicate_keys(a, ["id"]).collect()) == [("", 2), ("a", 2)]
    for keys, compares in (([], None), ([Key("nope", "id")], None), ([Key("id", "id")], [Compare("pos", "pos", "about")])):
        with pytest.raises(ValueError):
            delta.classified(a, a, keys, compares)
