"""Spelling variants against all pairs of words, and the words themselves against plain counting."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import spelling
from ledgerline.llm.common import Scratch

from . import corpus


def plain_words(docs, least=5, times=3, drop=97):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= times}


def edited(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    return out - {w}


def plain_groups(words):
    letters = sorted({c for w in words for c in w})
    out = {}
    for w, n in words.items():
        near = sorted((-words[x], x) for x in edited(w, letters) if x in words)
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        out[w] = [form, w, n, len(near), words[form] if form else None]
    for w in out:
        while out[out[w][1]][0] is not None:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(x) for w, x in out.items()}


def result(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def dictionary(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice(a) for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 3, 8, 8, 40, 500]) for a in ("ab", "abc", "aé") for _ in range(150)}
    long = "ab" * 700
    return words | {long: 9, long[:-1]: 3, long[:600] + long[601:]: 2, "a" * 1500: 5, "a" * 1499: 50, "𝒜b": 1, "𝒜": 4}


@pytest.mark.parametrize("most", [3, 40, 4096])
def test_equals_all_pairs(spark, most):
    words = dictionary(most)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    assert result(spelling.variant_groups(df, most)) == plain_groups(words)


def test_groups_are_divided_and_bounded(spark):
    words = spark.createDataFrame([("".join("abcdefgh"[(i >> 3 * k) & 7] for k in range(6)), 1) for i in range(4000)], "word string, n bigint")
    with Scratch() as scratch:
        groups = spelling._groups(words, scratch, 50).groupBy("key", "lo", "hi").count().collect()
    assert max(r["count"] for r in groups if r.hi - r.lo > 1) <= 50
    assert max(r["count"] for r in groups if r.hi - r.lo == 1) <= 9


def test_the_tree_reports_every_point_of_a_rectangle():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 100):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        box = np.sort(rng.integers(0, n + 1, (2, 2, 50)), axis=1)
        which, value = tree.report(box[0, 0], box[0, 1], box[1, 0], box[1, 1])
        wanted = sorted((q, int(v)) for q in range(50) for p, v in enumerate(values) if box[0, 0, q] <= p < box[0, 1, q] and box[1, 0, q] <= v < box[1, 1, q])
        assert sorted(zip(which.tolist(), value.tolist())) == wanted


def test_words_are_counted_as_defined(spark):
    rows = [(r[0], r[1]) for r in corpus.documents()]
    rows += [(None, "Wörter wörter WÖRTER WörteR ÀÉÿ×÷"), (None, "Wörter " * 300), (7, "abcde " * 4), (7, "abcde abcd"), (8, "abcdefgh" * 4000 + " ok")] + [(i, "someword Otherword") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.word: r.n for r in spelling.count_words(docs).collect()} == plain_words(rows)
    assert {r.word: r.n for r in spelling.count_words(docs, drop=None, least_times=1, least_letters=2).collect()} == plain_words(rows, 2, 1, None)
    extra = corpus.with_extra(docs).withColumns({c: F.lit(1) for c in ("run", "word", "m", "lo", "hi", "form")})
    assert {r.word: r.n for r in spelling.count_words(extra).collect()} == plain_words(rows)
    assert result(spelling.variant_groups(spelling.count_words(docs))) == plain_groups(plain_words(rows))


def test_empty_tables(spark):
    assert spelling.variant_groups(spelling.count_words(spark.createDataFrame([], "doc_id bigint, text string"))).collect() == []
    assert spelling.variant_groups(spelling.count_words(spark.createDataFrame([(1, None), (None, "")], "doc_id bigint, text string"))).collect() == []
    one = spark.createDataFrame([("alone", 3)], "word string, n bigint")
    assert result(spelling.variant_groups(one)) == {"alone": (None, "alone", 3, 0, None)}
