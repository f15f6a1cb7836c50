"""License scans: an exact set-similarity join of text blocks with license templates, as expressions only.

A document's blocks are windows of 2 * STRIDE words, one every STRIDE words, so whatever is at most STRIDE words long lies
whole in the block in which it starts. A template is a set of words; a block meets it if it holds at least `percent` of
them. Words are ordered by the number of documents that hold them, rarest first, ties by the word. Let a template have n
words, of which alpha = ceil(n * percent / 100) are needed. The first word in that order that a block shares with it

* is among the first n - alpha + 1 of the template (prefix filter: only these are in the index),
* leaves at least alpha words, itself included, in the template and in the block (positional filter), and
* exists only if the block holds alpha words of any template (length filter).

Blocks that pass for some template are verified by the whole overlap, so the join is exact. Words that are in no template
can't be shared and are taken out of the blocks first.

A phrase is a template of which all words are needed; a block that holds them is then searched for the words standing
consecutively. The templates are bounded by their list, so they travel as literals: the corpus is read twice (once for the
counts) and nothing but the counts, at most a row for each template word and partition, is shuffled.

Defined results: null text is empty, and empty texts have no words, no labels and score 0; texts are read whole, however
long; repeated rows, equal ids and null ids don't matter, since rows are judged one by one; an empty table gives an empty
result; further columns don't matter, whatever their names. Counts that tie go by the word.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks start every so many words and hold twice as many; no template or phrase may have more.
STRIDE = 64
PERCENT = 80
#: Words after A-Z are lower-cased, and with the same limits before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Passages of published licenses and their labels, words in lower case.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
]


@dataclass(frozen=True)
class Pattern:
    """A template or a phrase: its label, its words in order, and how many different ones a block has to hold."""

    label: str
    words: tuple[str, ...]
    needed: int
    phrase: bool

    @classmethod
    def of(cls, label: str, text: str, percent: int, phrase: bool) -> Pattern:
        words = tuple(text.split())
        if not words or len(words) > STRIDE:
            raise ValueError(f"a template has 1 to {STRIDE} words: {text!r}")
        return cls(label, words, len(set(words)) if phrase else -(-len(set(words)) * percent // 100), phrase)


def _ints(values: Sequence[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _constant(value: list, kind: str) -> Column:
    """A bounded literal of any shape; the optimizer folds it."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


class Ranks:
    """The template words by their place in `order`, from 1, found by a table of hashes without collisions."""

    def __init__(self, order: list[str]) -> None:
        self.order = order
        self.place = {w: i + 1 for i, w in enumerate(order)}
        hashes = {w: zlib.crc32(w.encode()) for w in order}
        self.slots = max(4096, 2 * len(order))
        while len({h % self.slots for h in hashes.values()}) < len(order):
            self.slots += 1
        table = [0] * self.slots
        for w, h in hashes.items():
            table[h % self.slots] = self.place[w]
        self.table, self.words = _ints(table), F.split(F.lit(" ".join(order)), " ")

    def of(self, word: Column) -> Column:
        """0 for any other word. Letters outside A-Z whose lower case is a template's letter don't count as it."""
        low = F.lower(word)
        rank = F.element_at(self.table, (F.crc32(low.cast("binary")) % self.slots + 1).cast("int"))
        same = (F.element_at(self.words, rank) == low) & (F.octet_length(word) == F.octet_length(low))
        return F.when(rank == 0, F.lit(0)).when(same, rank).otherwise(F.lit(0))

    def all_of(self, text: Column) -> Column:
        return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), _BETWEEN), lambda w: w != ""), self.of)


def rarest_first(docs: DataFrame, words: list[str], text: str = "text") -> list[str]:
    """The given words, of a bounded list, by the number of documents that hold them; counted over all documents."""
    ranks = Ranks(sorted(words))
    held = docs.select(F.explode(F.array_distinct(F.filter(ranks.all_of(F.col(text)), lambda r: r > 0))).alias("rank"))
    counts = {r["rank"]: r["n"] for r in held.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(ranks.place[w], 0), w))


def find_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), phrases: Sequence[tuple[str, str]] = tuple(PHRASES), percent: int = PERCENT, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """For each row the columns of `keep`, and

    n_words; places: array of struct(label, start, words), all places of phrases; blocks: array of struct(label, template,
    start, end, containment), all blocks that meet a template (its number; words from 0, end exclusive); labels: sorted,
    of both; score: the largest share of a pattern found, 0 without any.
    """
    patterns = [Pattern.of(label, words, percent, False) for label, words in templates] + [Pattern.of(label, words, percent, True) for label, words in phrases]
    ranks = Ranks(rarest_first(docs, sorted({w for p in patterns for w in p.words}), text))
    sets = [sorted({ranks.place[w] for w in p.words}) for p in patterns]
    index: list[list[dict]] = [[] for _ in ranks.order]
    for t, (p, tokens) in enumerate(zip(patterns, sets)):
        for i, token in enumerate(tokens[: len(tokens) - p.needed + 1]):
            index[token - 1].append({"t": t + 1, "left": len(tokens) - i, "needed": p.needed})
    index_of = _constant(index, "array<array<struct<t:int,left:int,needed:int>>>")
    probes = _ints([i + 1 for i, x in enumerate(index) if x])
    set_of, words_of = (_constant(x, "array<array<int>>") for x in (sets, [[ranks.place[w] for w in p.words] for p in patterns]))
    needed, sizes, is_phrase = _ints([p.needed for p in patterns]), _ints([len(s) for s in sets]), _ints([int(p.phrase) for p in patterns])
    labels = F.split(F.lit("\n".join(p.label for p in patterns)), "\n")

    probed = lambda words: F.arrays_overlap(words, probes)
    tokens_of = lambda words: F.sort_array(F.array_distinct(F.filter(words, lambda r: r > 0)))

    def candidates(block: Column) -> Column:
        """The patterns that pass the three filters at some token of the block."""
        fits = lambda j: lambda e: (F.size(block) >= e["needed"]) & (F.least(e["left"], F.size(block) - j) >= e["needed"])
        return F.array_distinct(F.flatten(F.transform(block, lambda r, j: F.transform(F.filter(F.element_at(index_of, r), fits(j)), lambda e: e["t"]))))

    def verified(block: Column, start: Column) -> Column:
        measured = F.transform(candidates(block), lambda t: F.struct(start.alias("start"), t.alias("t"), F.size(F.array_intersect(F.element_at(set_of, t), block)).alias("held")))
        return F.filter(measured, lambda m: m["held"] >= F.element_at(needed, m["t"]))

    def standing(match: Column) -> Column:
        """Where the words of a phrase stand consecutively, starting in the first half of the block."""
        phrase = F.element_at(words_of, match["t"])
        starts = F.sequence(match["start"], F.least(match["start"] + STRIDE, F.size("words")) - 1)
        found = F.filter(starts, lambda p: (F.get("words", p) == F.get(phrase, 0)) & (F.slice("words", p + 1, F.size(phrase)) == phrase))
        return F.transform(found, lambda p: F.struct(F.element_at(labels, match["t"]).alias("label"), p.cast("long").alias("start"), F.size(phrase).cast("long").alias("words")))

    read = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), ranks.all_of(F.col(text)).alias("words"))
    none = F.lit(None).cast("array<struct<start:int,t:int,held:int>>")
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1, F.lit(STRIDE)), lambda s: probed(F.slice("words", s + 1, 2 * STRIDE)))
    met = F.flatten(F.transform(F.transform(starts, lambda s: F.struct(s.alias("start"), tokens_of(F.slice("words", s + 1, 2 * STRIDE)).alias("tokens"))), lambda b: verified(b["tokens"], b["start"])))
    joined = read.withColumn("met", F.coalesce(F.when((F.size("words") > 0) & probed(F.col("words")), met).otherwise(none), F.array().cast("array<struct<start:int,t:int,held:int>>")))
    of_kind = lambda kind: F.filter("met", lambda m: F.element_at(is_phrase, m["t"]) == kind)
    block = lambda m: F.struct(
        F.element_at(labels, m["t"]).alias("label"), (m["t"] - 1).alias("template"), m["start"].cast("long").alias("start"), F.least(m["start"] + 2 * STRIDE, F.size("words")).cast("long").alias("end"),
        (m["held"] / F.element_at(sizes, m["t"])).alias("containment"))
    found = joined.select("row", F.size("words").cast("long").alias("n_words"), F.array_sort(F.flatten(F.transform(of_kind(1), standing)), lambda x, y: (x["start"] - y["start"]).cast("int")).alias("places"), F.transform(of_kind(0), block).alias("blocks"))
    name = lambda x: x["label"]
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)))
    return found.select(*[F.col("row")[c].alias(c) for c in keep], "n_words", "places", "blocks", F.sort_array(F.array_distinct(F.concat(F.transform("places", name), F.transform("blocks", name)))).alias("labels"), score.alias("score"))
