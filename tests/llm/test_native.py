"""Mixing, sharding and chat formatting against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import chatfmt, mixing, sharding

from .corpus import DOC_SCHEMA, documents, with_extra

def levels():
    return [("lang", F.col("lang")), ("source", F.col("source"))]



def python_plan(df):
    return [w for w in ("Python", "Arrow", "Pandas") if w in df._jdf.queryExecution().executedPlan().toString()]


# ------------------------------------------------------------------- mixing


def waterfill(budget, children):
    """children: name -> (weight, capacity); integer shares, largest unmet need first, by plain iteration."""
    out, left, rest = {}, dict(children), budget
    while left:
        weights = sum(w for w, _ in left.values())
        full = [n for n, (w, c) in left.items() if c * weights <= w * rest]
        if not full:
            break
        for n in sorted(full, key=lambda n: (left[n][1] / left[n][0], n))[:1]:
            out[n] = left.pop(n)[1]
            rest -= out[n]
    weights = sum(w for w, _ in left.values())
    order = sorted(left, key=lambda n: (left[n][1] / left[n][0], n))
    share = {n: left[n][0] * rest // weights for n in order}
    odd = rest - sum(share.values())
    for i, n in enumerate(order):
        out[n] = share[n] + (i < odd)
    return out


def mixed_by_hand(rows, weights, share, epochs, seed):
    docs = [(d, "?" if x is None else x, "?" if s is None else s, len((t or "").split()), t or "") for d, t, x, s, _ in rows]
    docs = [d for d in docs if d[3]]
    leaf = Counter()
    for _, x, s, n, _ in docs:
        leaf[x, s] += n
    cap = Counter()
    for (x, s), n in leaf.items():
        cap[x] += n * epochs
    total = min(int(sum(leaf.values()) * share), sum(cap.values()))
    top = waterfill(total, {x: (weights.get((x,), 1), c) for x, c in cap.items()})
    out = []
    for x in cap:
        got = waterfill(top[x], {s: (weights.get((x, s), 1), n * epochs) for (y, s), n in leaf.items() if y == x})
        for s, budget in got.items():
            whole, rest = divmod(budget, leaf[x, s])
            own = [d for d in docs if d[1:3] == (x, s)]
            for d, _, _, n, _ in own:
                out += [(d, e, n) for e in range(whole)]
            place = lambda d: hashlib.md5(":".join([str(seed), str(whole), *([] if d[0] is None else [str(d[0])]), hashlib.md5(d[4].encode()).hexdigest()]).encode()).hexdigest()  # noqa: B023, E731
            for d, _, _, n, _ in sorted(own, key=place):
                if rest > 0:
                    out.append((d, whole, min(n, rest)))
                    rest -= n
    assert sum(o[2] for o in out) == total
    return sorted(out, key=lambda o: (o[0] is None, o[0] or 0, o[1], o[2]))


@pytest.mark.parametrize("weights,share", [({("en",): 3, ("fr",): 9, ("en", "src1"): 5}, 0.6), ({}, 1.4), ({("de",): 50}, 0.9)])
def test_mixing_matches_plain_python(spark, weights, share):
    rows = [r for r in documents() if r[0] < 150]
    df = with_extra(spark.createDataFrame(rows, DOC_SCHEMA))
    got = mixing.mix_sources(df, levels(), weights, share, max_epochs=2, seed=3)
    assert sorted((r.doc_id, r.epoch, r.take_tokens) for r in got.collect()) == mixed_by_hand(rows, weights, share, 2, 3)
    assert not python_plan(got)


def test_mixing_repeated_rows_zero_weights_and_empty(spark):
    rows = [(1, "a b c", "en", "s", 1)] * 4 + [(2, "d e", "fr", "s", 1)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    got = mixing.mix_sources(df, levels(), {("fr",): 0}, total_tokens=100, max_epochs=3).collect()
    assert sum(r.take_tokens for r in got) == 36 and {r.doc_id for r in got} == {1}
    assert mixing.mix_sources(df.limit(0), levels(), {}).count() == 0


def test_mixing_of_awkward_rows(spark):
    """Null and empty texts are never taken, null levels are a node, a very long text is taken whole."""
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  ", None, None, 0), (4, "w " * 50_000, None, "a", 0), (None, "one two", None, None, 0), (None, "one two", None, None, 0)]
    df = with_extra(spark.createDataFrame(rows, DOC_SCHEMA))
    got = mixing.mix_sources(df, levels(), {}, 1.0, max_epochs=1, seed=3).collect()
    assert sorted((str(r.doc_id), r.lang, r.source, r.take_tokens) for r in got) == [("4", "?", "a", 50_000), ("None", "?", "?", 2), ("None", "?", "?", 2)]


def test_mixing_does_not_depend_on_ids_or_the_order_of_rows(spark):
    """A third of the rows has no id, and one id has many texts."""
    rng = random.Random(6)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 40))), "en", "s", i) for i in range(600)]
    taken = []
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[1])):
        got = mixing.mix_sources(spark.createDataFrame(order, DOC_SCHEMA).repartition(len(taken) + 1), levels(), {}, 0.5, max_epochs=1, seed=3, carry=["text"]).collect()
        taken.append(sorted((str(r.doc_id), r.carry_text, r.take_tokens) for r in got))
    assert taken[0] == taken[1] == taken[2]
    assert sorted((str(d), n) for d, _, n in mixed_by_hand(rows, {}, 0.5, 1, 3)) == sorted((d, n) for d, _, n in taken[0])


def test_token_prefix(spark):
    df = spark.createDataFrame([("a  b\tc\nd ", n) for n in (1, 3, 4)], "t string, n int")
    assert [r[0] for r in df.select(mixing.token_prefix(F.col("t"), F.col("n"))).collect()] == ["a", "a  b\tc", "a  b\tc\nd"]


# ----------------------------------------------------------------- sharding


def check_shards(rows, got, shards):
    assert sorted(g["doc_id"] is None or g["doc_id"] for g in got) == sorted(r[0] is None or r[0] for r in rows)
    by = defaultdict(list)
    for g in got:
        by[g["shard"]].append(g)
    for own in by.values():
        assert sorted(g["slot"] for g in own) == list(range(len(own)))
    total, most = sum(g["size"] for g in got), max((g["size"] for g in got), default=0)
    assert all(0 <= s < shards and abs(sum(g["size"] for g in own) - total / shards) <= most for s, own in by.items())


def test_shards(spark):
    rows = documents()
    got = sharding.assign_shards(with_extra(spark.createDataFrame(rows, DOC_SCHEMA)), 7)
    assert not python_plan(got)
    got = got.collect()
    check_shards(rows, got, 7)
    text = {r[0]: r[1] or "" for r in rows}
    assert all(g["size"] == len(text[g["doc_id"]].encode()) + 16 and g["text_crc32"] == zlib.crc32(text[g["doc_id"]].encode()) for g in got)


def test_sharding_query_against_plain_python(spark):
    """The whole order by text and id hashes, cut by bytes."""
    import xxhash

    from ledgerline.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    hashed = lambda b, n: xxhash.xxh64(b, seed=42).intdigest() & ((1 << n) - 1)
    order = sorted((zlib.crc32(t) << 31 | hashed(t, 16) << 15 | hashed(str(d).encode(), 15), d, len(t) + 16, zlib.crc32(t)) for d, t in rows)
    total, at, slots, want = sum(o[2] for o in order), 0, Counter(), {}
    for _, d, size, crc in order:
        shard = min(at * 40 // total, 39)
        want[d] = (size, crc, "bytes", shard, slots[shard], None)
        slots[shard] += 1
        at += size
    got = {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in queries.op5_sampled_splitters(spark, sf).collect()}
    assert got == want


def test_equal_texts_stand_together(spark):
    rows = [(i, f"text {i % 7}" + "x" * (i % 7), None, None, None) for i in range(400)]
    got = sharding.assign_shards(spark.createDataFrame(rows, DOC_SCHEMA), 4).collect()
    texts = {r[0]: r[1] for r in rows}
    order = [texts[g.doc_id] for g in sorted(got, key=lambda g: (g.shard, g.slot))]
    assert sum(a != b for a, b in zip(order, order[1:])) == 6


def test_one_hot_text_is_divided(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}", None, None, None) for i in range(3000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, DOC_SCHEMA), 40).collect()
    check_shards(rows, got, 40)
    assert len({g["shard"] for g in got}) == 40


def test_shards_of_repeated_rows_and_of_nothing(spark):
    df = spark.createDataFrame([(None, None, None, None, None)] * 5 + [(1, "x", None, None, None)] * 5, DOC_SCHEMA)
    assert sorted(r.slot for r in sharding.assign_shards(df, 1).collect()) == list(range(10))
    assert sharding.assign_shards(df.limit(0), 3).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame(documents(), DOC_SCHEMA)
    sharding.write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == df.count() and {r[0] for r in back.select("shard").distinct().collect()} == set(range(5))


# ----------------------------------------------------------- chat formatting


def conversations():
    rng = random.Random(3)
    bits = ["<|", "<\\|", "|>", "<|im_end|>", "<|im_start|>assistant", "<|im_sep|>", "<|im_cont|>", "\\", "<", "|", "héllo", "\n", " ok", ""]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", "a<|b\nc", None]), rng.choice([None, *["".join(rng.choices(bits, k=rng.randint(0, 6))) for _ in range(4)]])))
    return rows + [(None, 0, "user", "no id"), (99, 1, "user", "b"), (99, 1, "user", "a"), (99, 1, "user", "a"), (99, None, "assistant", "<"), (98, 0, "assistant", "x<"), (98, 1, "assistant", "|y")]


def test_chat_round_trip(spark):
    rows = conversations()
    df = with_extra(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    out = chatfmt.format_conversations(df)
    assert not python_plan(out)
    got = {r.conv_id: r for r in out.select("*", chatfmt.read_turns(F.col("formatted")).alias("turns"), chatfmt.read_loss(F.col("segments")).alias("loss")).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda v: (v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        want[c].append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
        assert got[c].formatted == "".join(s.piece for s in got[c].segments)
        runs = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert got[c].formatted.count(chatfmt.START) == runs == got[c].formatted.count(chatfmt.END)


def test_no_conversations(spark):
    assert chatfmt.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
