"""Closest numbers and days from values in order, against every pair in plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from ledgerline.operators import closest, nearest


def score(kind, a, b):
    if a is None or b is None:
        return 50.0 if a is b else 0.0
    if kind == "date":
        return float(nearest.value_scores(kind, np.array(float(a.toordinal())), np.array(float(b.toordinal()))))
    return float(nearest.value_scores(kind, np.array(a), np.array(b)))


def by_hand(kind, a, b, keyed, least, perfect):
    out = {}
    for pos, key, x in a:
        met = [(score(kind, x, y), p) for p, k, y in sorted(b) if not keyed or k == key]
        met = [(s, p) for s, p in met if s > least]
        sure = [m for m in met if m[0] >= perfect]
        out[pos] = sure[0][1] if sure else max(met, key=lambda m: (m[0], -m[1]))[1] if met else None
    return out


def values(kind, rng, n):
    if kind == "date":
        return [rng.choice([None, dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(200))]) for _ in range(n)]
    odd = [None, 0.0, math.nan, math.inf, -math.inf, 1e-308, 1e308, 100.0, math.nextafter(100.0, 200), math.nextafter(100.0, 0), 99.5, 100.5, 100 / 0.995]
    return [rng.choice([rng.choice(odd), rng.uniform(-300, 300), round(rng.uniform(95, 105), 1), 10 ** rng.uniform(-3, 6)]) for _ in range(n)]


@pytest.mark.parametrize("kind, least, perfect", [("numeric", 30.0, 99.5), ("numeric", 55.0, 90.0), ("numeric", 0.0, 100.0), ("date", 30.0, 99.5), ("date", 10.0, 80.0)])
@pytest.mark.parametrize("keyed", [False, True])
def test_the_best_of_every_pair(spark, monkeypatch, kind, least, perfect, keyed):
    monkeypatch.setattr(nearest, "BLOCK", 7)
    monkeypatch.setattr(nearest, "SLICE", 20)
    rng = random.Random(f"{kind}{least}{keyed}")
    a, b = ([(i, rng.choice("xyz"), v) for i, v in enumerate(values(kind, rng, n))] for n in (150, 120))
    schema = f"pos bigint, k string, x {'date' if kind == 'date' else 'double'}"
    out = closest.closest(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), [("x", "x")], "pos", "pos", [("k", "k")] if keyed else [], {"x": kind}, least, perfect, native=True, max_comparisons=10)
    got = {r.pos: r.closest_match_record and int(r.closest_match_record.split(";")[0][5:]) for r in out.collect()}
    assert got == by_hand(kind, a, b, keyed, least, perfect)


def test_many_rows_of_one_key(spark):
    """10**10 pairs would take hours; each source has its own target."""
    a = spark.range(100_000).selectExpr("id AS pos", "'k' AS k", "100.0D + id AS x")
    out = closest.closest_with_fallback(a, a.withColumn("x", a.x + 0.25), [("x", "x")], "pos", "pos", [("k", "k")], kinds={"x": "numeric"}, native=True, perfect=100.0)
    assert out.filter("closest_match_record NOT LIKE concat('pos: ', pos, ';%')").count() == 0 and out.count() == 100_000


def test_texts_of_a_key_meet_in_cells(spark, monkeypatch):
    """Joins and cells choose alike, and values that repeat are compared once: the plan has no join of all rows of a key."""
    rng = random.Random(3)
    words = ["red", "blue", "hot", "ring", "bolt", "large", None]
    a, b = ([(i, rng.choice("xy"), " ".join(w for w in rng.sample(words, 3) if w), rng.choice([None, 1.0, 2.0, 2.1])) for i in range(n)] for n in (60, 90))
    schema = "pos bigint, k string, name string, amount double"
    a, b = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    out = []
    for few in (1 << 14, 0):
        monkeypatch.setattr(closest, "FEW_PAIRS", few)
        got = closest.closest(a, b, [("name", "name"), ("amount", "amount")], "pos", "pos", [("k", "k")], {"name": "text", "amount": "numeric"})
        out.append(sorted(map(tuple, got.collect()), key=lambda r: r[0]))
    assert out[0] == out[1] and len(out[0]) == 60
