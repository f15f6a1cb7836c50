"""License scans against counting every block of every text, and the awkward rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import licenses

from . import corpus

T = [("a", "one two three four five six seven eight nine ten"), ("b", "two four six eight the of"), ("a", "one two three four five"), ("c", "the the of of and")]
P = [("p", "alpha beta"), ("q", "beta alpha beta"), ("p", "of"), ("r", "of of")]


def plain(text, templates, phrases, percent):
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label, len(p.split())) for label, p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    blocks = []
    for start in range(0, len(words), licenses.STRIDE):
        block = set(words[start : start + 2 * licenses.STRIDE])
        for t, (label, p) in enumerate(templates):
            wanted = set(p.split())
            if 100 * len(wanted & block) >= percent * len(wanted):
                blocks.append((start, t, label, min(start + 2 * licenses.STRIDE, len(words)), len(wanted & block) / len(wanted)))
    score = 1.0 if places else max([b[4] for b in blocks], default=0.0)
    return len(words), places, sorted(blocks), sorted({x[1] for x in places} | {b[2] for b in blocks}), score


def texts():
    rng = random.Random(3)
    vocabulary = sorted({w for _, p in T + P for w in p.split()}) + ["x", "yé", "Zz", "K", "oﬀ", "12"]
    out = [None, "", " \n", "ALPHA beta", "alpha, Beta; alpha-beta", "of of of", "alphabeta", "one" * 3000]
    out += [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in [1, 2, 5, 20, 63, 64, 65, 127, 128, 129, 300, 5000] for _ in range(4)]
    out += [" ".join(rng.choice(["x", "one", "two", "three", "the"]) for _ in range(200)) for _ in range(10)]
    return out + [" x" * 60 + " one two\nthree FOUR five six seven eight." + " y" * 100, "x " * 62 + "alpha beta " + "z " * 70]


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_equals_counting_every_block(spark, percent):
    rows = texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in licenses.find_licenses(docs, T, P, percent).collect()}
    for i, text in enumerate(rows):
        r, (n, places, blocks, labels, score) = found[i], plain(text, T, P, percent)
        assert r.n_words == n
        assert sorted((p.start, p.label, p.words) for p in r.places) == places
        assert sorted((b.start, b.template, b.label, b.end, b.containment) for b in r.blocks) == blocks
        assert r.labels == labels and r.score == score


def test_published_passages_are_found_and_prose_is_not(spark):
    changed = [" ".join(w for i, w in enumerate(t.upper().split()) if i % 9 != 4) for _, t in licenses.TEMPLATES]
    docs = spark.createDataFrame([(i, "word " * 50 + t + " word" * 90) for i, t in enumerate(changed)] + [(100, "the software is provided to any person in the hope that it is useful")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in licenses.find_licenses(docs).collect()}
    assert [licenses.TEMPLATES[i][0] in found[i].labels for i in range(len(changed))] == [True] * len(changed)
    assert found[100].labels == []


def test_a_kelvin_sign_is_no_k(spark):
    docs = spark.createDataFrame([(1, "K key"), (2, "K Key")], "doc_id bigint, text string")
    found = {r.doc_id: len(r.places) for r in licenses.find_licenses(docs, [], [("k", "k"), ("key", "key")]).collect()}
    assert found == {1: 1, 2: 2}


def test_awkward_tables(spark):
    docs = spark.createDataFrame(corpus.documents(), corpus.DOC_SCHEMA)
    plainly = sorted(map(str, licenses.find_licenses(docs, keep=("doc_id", "source")).collect()))
    extra = corpus.with_extra(docs).withColumns({c: F.lit(1) for c in ("row", "words", "met", "places", "blocks")})
    assert sorted(map(str, licenses.find_licenses(extra, keep=("doc_id", "source")).collect())) == plainly
    same = spark.createDataFrame([(None, "mit license"), (None, "mit license"), (1, "apache license"), (1, "other"), (1, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, ",".join(r.labels)) for r in licenses.find_licenses(same).collect()) == [(0, "mit"), (0, "mit"), (1, ""), (1, ""), (1, "apache")]
    assert licenses.find_licenses(docs.limit(0)).collect() == []


def test_templates_longer_than_a_stride_are_refused(spark):
    with pytest.raises(ValueError, match="1 to"):
        licenses.find_licenses(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), [("a", "w " * 65)], [])
