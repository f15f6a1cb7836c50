"""The trie against one built by a dictionary of all beginnings; numbering, chains, rounds and awkward rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import prefix_trie
from ledgerline.llm.common import Scratch

from . import corpus

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
EMPTY = hashlib.sha256().hexdigest()


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows, rebuild=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        convs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = {w: dict(conv=min(m), n=len(m), kids=0, leaves=0, saved=0, ends=sorted(c for c in m if convs[c] == w)) for w, m in nodes.items()}
    for w in sorted(out, key=len, reverse=True):
        x = out[w]
        x["leaves"] = x["leaves"] or 1
        x["saved"] += (x["n"] - 1) * len(w[-1][1]) if w else 0
        if w:
            up = out[w[:-1]]
            up["kids"] += 1
            up["leaves"] += x["leaves"]
            up["saved"] += x["saved"]
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((x["conv"], len(w), out[w[:-1]]["conv"] if w else None, x["n"], x["kids"], x["leaves"], x["saved"], sha(x["ends"])) for w, x in out.items())


def result(df):
    return sorted(tuple(r) for r in df.collect())


def built(turns, most):
    heads = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    return result(prefix_trie.conversation_trie(turns, F.col("conv") - F.col("conv") % 100, heads, 5, most))


def conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(-3, 60), *range(100, 160), 305, 7_000_000_000]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice("abü𝒜")) for t in range(rng.randint(1, 7))]
    for c in range(400, 440):  # copies, and copies with another end
        rows += [(c, t, "user", f"turn {t}") for t in range(9)] + [(c, 9, "user", "end" if c % 2 else str(c % 5))]
    rows += [(500, t, "user", "long") for t in range(20)] + [(501, t, "user", "long") for t in range(18)]
    rows += [(600, None, "user", "first"), (600, 0, None, None), (600, 0, "user", ""), (600, 0, "b", "a"), (600, 0, "a", "b"), (600, 0, "a", "b"), (None, 1, "user", "nobody"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("most", [1, 30, 4096])
def test_equals_a_dictionary_of_beginnings(spark, most):
    rows = conversations() if most > 1 else conversations()[:400]
    assert built(spark.createDataFrame(rows, SCHEMA).repartition(3), most) == plain(rows)


def test_a_conversation_with_most_rows_is_a_chain(spark):
    rows = [(c, t, "user", f"{t % 7}") for c in (5, 6) for t in range(9000)] + [(c, 0, "user", str(c)) for c in range(7, 50)]
    found = result(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), most=100))
    assert found == plain(rows, rebuild=False)


def test_rows_are_numbered_over_the_borders_of_partitions(spark):
    rows = [(1, 0, 1, 1)] + [(2, n, n % 3, 1) for n in range(500)] + [(3, 0, 7, 1)] * 300 + [(4, None, 2, 1)]
    with Scratch() as scratch:
        kept = scratch.keep(spark.createDataFrame(rows, "conv bigint, nth bigint, turn bigint, chars bigint").repartition(5))
        found = [tuple(r) for r in prefix_trie.numbered(kept, scratch).collect()]
    assert sorted(found) == [(1, 0, 1, 1)] + [(2, n, n % 3, 1) for n in range(500)] + [(3, n, 7, 1) for n in range(300)] + [(4, 0, 2, 1)]


def test_members_are_digested_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(100)]
    assert result(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows, rebuild=False)


def test_quicksort_emits_every_beginning_once():
    rng = random.Random(2)
    turns = [[0, *s] for s in sorted({tuple(rng.randint(0, 2) for _ in range(rng.randint(0, 6))) for _ in range(200)})]
    rng.shuffle(turns)
    nodes = prefix_trie.sorted_nodes(turns, [[1] * len(t) for t in turns], list(range(len(turns))), [1] * len(turns))
    assert len(nodes) == len({tuple(t[:d]) for t in turns for d in range(1, len(t) + 1)})
    assert sorted(n[5] for n in nodes if n[5] is not None) == list(range(len(turns)))
    assert all(n[0] < i for i, n in enumerate(nodes))


def test_awkward_tables(spark):
    turns = spark.createDataFrame(conversations()[:150], SCHEMA)
    extra = corpus.with_extra(turns).withColumns({c: F.lit(1) for c in ("conv", "pos", "nth", "chars", "digest", "seq", "depth", "row")})
    assert built(extra, 30) == built(turns, 30) == plain(conversations()[:150])
    assert built(turns.limit(0), 30) == []
    assert built(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA), 30) == []
    # conversation 3 has no base and all its turns go with it (crc32("3") % 6 is above 0)
    assert built(spark.createDataFrame([(3, 0, "user", "x")], SCHEMA), 30) == plain([(3, 0, "user", "x")])
