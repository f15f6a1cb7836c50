"""Language identification with one Bloom filter whose slots hold a bit for each language.

Training counts letter trigrams of a bounded sample of labelled documents. A trigram belongs to every language in which
it is at least `near` times as likely as in the language that likes it most; each language keeps its `grams` commonest.
For every language that has a trigram, its bit is set in the slots that the trigram's hashes name, so one look-up per
hash and one AND return all languages containing it. A document's count for a language is how many of its trigrams
return that bit; the filter's false positives, known from how full the language's bits are, are taken off, and the
largest count decides. The score is the corrected count over the number of trigrams.

Defined results: a text that is null or has no letter is `und` with score 0; so is any text when no row is labelled; texts of
any length are read whole; ids are never looked at, so null and repeated ones don't matter, and copies of a text are read
once in training and count as often as they stand there; a text whose trigrams are all unknown gets the commonest training language with score 0, as ties go to the commoner one.
Extra columns are ignored, repeated rows are scored each, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, pieces

UND = "und"
_LETTERS: list[np.ndarray] = []


def _letter(c: int) -> int:
    ch = chr(c)
    return ord(ch.lower()[0]) if ch.isalpha() else 32


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters (32 for all else) of all texts, one 32 before, between and after; and where each text begins."""
    if not _LETTERS:
        _LETTERS.append(np.array([_letter(c) for c in range(0x10000)], np.uint32))
    texts = [t or "" for t in texts]
    points = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
    low = _LETTERS[0][np.minimum(points, 0xFFFF)]
    if len(high := np.flatnonzero(points > 0xFFFF)):
        kinds, which = np.unique(points[high], return_inverse=True)
        low[high] = np.array([_letter(int(c)) for c in kinds], np.uint32)[which]
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return low, begin


def trigrams(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams around each letter as exact 63-bit codes, and the letters' places."""
    at = np.flatnonzero(letters[1:-1] != 32) + 1
    wide = letters.astype(np.uint64)
    return (wide[at - 1] << np.uint64(42)) | (wide[at] << np.uint64(21)) | wide[at + 1], at


@dataclass
class Model:
    langs: list[str]  # commonest first
    table: np.ndarray  # slots x ceil(languages / 64), uint64
    hashes: int

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], slot_bits: int, hashes: int) -> Model:
        langs = list(grams)
        table = np.zeros((1 << slot_bits, -(-len(langs) // 64) or 1), np.uint64)
        for i, lang in enumerate(langs):
            for slots in cls.slots(grams[lang], slot_bits, hashes):
                table[slots, i // 64] |= np.uint64(1 << (i % 64))
        return cls(langs, table, hashes)

    @staticmethod
    def slots(grams: np.ndarray, slot_bits: int, hashes: int) -> list[np.ndarray]:
        h = mix(grams.astype(np.uint64))
        return [((h >> np.uint64(i * slot_bits)) & np.uint64((1 << slot_bits) - 1)).astype(np.int64) for i in range(hashes)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        letters, begin = letters_of(texts)
        grams, at = trigrams(letters)
        bits = len(self.table).bit_length() - 1
        found = None
        for slots in self.slots(grams, bits, self.hashes):
            found = self.table[slots] if found is None else found & self.table[slots]
        cut = np.searchsorted(at, begin)
        n = np.diff(cut)
        best, top = np.full(len(n), -1), np.zeros(len(n))
        for i in range(len(self.langs)):
            bit = (self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            false = float(bit.mean()) ** self.hashes
            ones = np.concatenate([[0], np.cumsum((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
            count = np.maximum(0, (ones[cut[1:]] - ones[cut[:-1]] - n * false) / (1 - false) if false < 1 else 0 * n)
            better = (count > top) | (best < 0)
            best, top = np.where(better, i, best), np.where(better, count, top)
        score = np.where(n > 0, np.minimum(1, top / np.maximum(n, 1)), 0.0)
        return [self.langs[b] if k and self.langs else UND for b, k in zip(best, n)], score if self.langs else 0 * score


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 2000, grams: int = 8192, near: float = 0.5, least: int = 2, slot_bits: int = 18, hashes: int = 2) -> Model:
    """Learn from about docs_per_lang different texts of each language, all if there are fewer; told apart by a hash of the text."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash", 0.02).alias("texts")).collect()
    sizes = {r["lang"]: r["n"] for r in counted}
    if not sizes:
        return Model([], np.zeros((1 << slot_bits, 1), np.uint64), hashes)
    pick = F.lit(0.0)
    for r in counted:  # as many as languages; few texts are all taken, though their number is an estimate
        pick = F.when(F.col("lang") == r["lang"], F.lit(1.0 if r["texts"] <= 1.2 * docs_per_lang else docs_per_lang / r["texts"])).otherwise(pick)
    chance = F.pmod(F.xxhash64("hash", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(chance < pick).groupBy("lang", "hash").agg(F.first("text").alias("text"), F.count("*").alias("copies")).select("lang", "text", "copies")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts, copies = batch.column("text").to_pylist(), batch.column("copies").to_numpy()
            for lang in np.unique(langs):
                letters, begin = letters_of([t for t, x in zip(texts, langs) if x == lang])
                grams, at = trigrams(letters)
                g, which = np.unique(grams, return_inverse=True)
                n = np.zeros(len(g), np.int64)
                np.add.at(n, which, copies[langs == lang][np.searchsorted(begin, at, "right") - 1])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    share = share.withColumn("most", F.max("p").over(Window.partitionBy("gram"))).filter((F.col("p") >= near * F.col("most")) & (F.col("n") >= least))
    ranked = share.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= grams)
    kept = ranked.select("lang", "gram").toPandas()  # at most languages x grams rows
    by_size = sorted(sizes, key=lambda k: (-sizes[k], k))
    return Model.build({k: kept.gram[kept.lang == k].to_numpy(np.int64) for k in by_size}, slot_bits, hashes)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), text_out: str | None = None) -> DataFrame:
    """The columns `keep`, lang_pred and score of every row, and the text as text_out if that is a name. The model goes
    out as one broadcast of a fixed size."""
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, *([text_out] if text_out else []), "lang_pred", "score"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            langs, scores = shared.value.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + bool(text_out)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    kept = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep) + (f"`{text_out}` string, " if text_out else "")
    return rows.mapInArrow(predict, f"{kept}lang_pred string, score double")
