"""Fingerprints of documents from their improbable features.

A feature is a window of bytes. Its rank is how often windows of its entropy occur in the corpus: the rarer, the better. In
every run of neighbouring windows the rarest one (the first of equals) gets a point, and windows with enough points are
selected. Selected features set bits in Bloom filters of 2048 bits, 160 features to a filter, one filter chained to the
next. Two fingerprints compare by the bits that their filters share, less what chance gives: each filter of the shorter
one takes its best partner, and the likeness is the mean of these.

The rule works at two scales, each with ranks of its own. All texts of 64 bytes and more are read at the coarse one:
windows of 64 bytes, runs of 64, 16 points. Texts under 512 code points, and those with fewer than 8 windows selected there,
have too few for a fine comparison; they are read at the fine scale besides: windows of 8 bytes, runs of 4, 1 point. Filters
compare with those of the same scale only, and by the scales that both texts have, so texts on both sides of a limit compare
by the scale that doesn't change there.

Entropies of all windows come from counts of equal bytes at each distance in them, so no window is counted by itself.

Defined results: a text shorter than a fine window has its whole contents as its only one; null counts as empty, and two
empty texts are alike; very long texts are read whole, a piece at a time; equal texts have equal fingerprints; repeated
rows get a row each, rows with equal ids follow each other by text; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_SPLITS, PIECE_BYTES, bucket_of, index_in, item_of, pieces, prefix_hash, span_hash, utf8


@dataclass(frozen=True)
class Scale:
    """How windows are taken and selected. run: a power of two. least: entropy (bits a byte) of windows that count."""

    window: int
    run: int
    points: int
    least: float


#: In the order of their numbers, which stand in the word behind each filter's bits.
SCALES = COARSE, FINE = Scale(64, 64, 16, 1.0), Scale(8, 4, 1, 0.0)
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
#: Texts of fewer code points, or with fewer selected coarse windows, are read at the fine scale besides.
SHORT, FEW = 512, 8
#: Standard deviations that the bits shared by chance may be above their mean.
CHANCE_SD = 3.5
BINS = 1024
HALO, CHUNK = 192, 1 << 16
UNRANKED = np.int64(1 << 20)
_UNIT = 1 << 16
_TERM = np.array([0] + [round(c * math.log2(c) * _UNIT) for c in range(1, COARSE.window + 1)], np.int64)
_GAIN = _TERM[1:] - _TERM[:-1]
_PLACE = np.int64(1 << 40)


def entropy_bins(data: np.ndarray, window: int = COARSE.window) -> np.ndarray:
    """For each window start: its entropy, 0 to BINS - 1 for 0 to log2(window) bits; of all windows, whatever the text."""
    n = len(data)
    if n < window:
        return np.zeros(0, np.int64)
    past, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # how many of the window - 1 bytes before, after are the same
    for a in range(0, n, CHUNK):
        part = data[max(0, a - window + 1) : a + CHUNK]
        skip = a - max(0, a - window + 1)
        p = np.zeros(len(part), np.uint8)
        for d in range(1, min(window, len(part))):
            p[d:] += (part[d:] == part[:-d]).view(np.uint8)
        past[a : a + CHUNK] = p[skip:]
    for a in range(0, n, CHUNK):
        part = data[a : a + CHUNK + window - 1]
        p = np.zeros(len(part), np.uint8)
        for d in range(1, min(window, len(part))):
            p[:-d] += (part[d:] == part[:-d]).view(np.uint8)
        ahead[a : a + CHUNK] = p[:CHUNK]
    change = _GAIN[past]
    change[window:] -= _GAIN[ahead[:-window]]
    terms = np.cumsum(change)[window - 1 :]  # sum of c log2 c over the window's bytes
    return (BINS - 1) - np.minimum(BINS - 1, terms * (BINS - 1) // int(_TERM[window]))


def _inside(ends: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the n starts begin a stretch of `size` bytes that stays in one text."""
    long = np.diff(ends) >= size
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.minimum(ends[:-1][long], n), 1)
    np.add.at(mark, np.minimum(ends[1:][long] - size + 1, n), -1)
    return np.cumsum(mark[:-1]) > 0


def counts_of(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each entropy occurs among the windows of texts: scales x BINS."""
    total = np.zeros((len(SCALES), BINS), np.int64)
    for row, scale in zip(total, SCALES):
        bins = entropy_bins(data, scale.window)
        row += np.bincount(bins[_inside(ends, scale.window, len(bins))], minlength=BINS)
    return total


def histogram(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """counts_of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SCALES), BINS), np.int64)
        for batch in pieces(batches):
            total += counts_of(*utf8(batch.column("text")))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["bin", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(SCALES) * BINS, np.int64)
    for r in rows:
        out[r["bin"]] = r["n"]
    return out.reshape(len(SCALES), BINS)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """At each scale the rank of each entropy, 0 for the rarest; entropies that never occurred are the rarest, by their number."""
    ranks = np.empty((len(SCALES), BINS), np.int64)
    for row, own, scale in zip(ranks, counts, SCALES):
        row[np.lexsort((np.arange(BINS), own))] = np.arange(BINS)
        row[: math.ceil(scale.least / math.log2(scale.window) * (BINS - 1))] = UNRANKED
    return ranks


def features(data: np.ndarray, ends: np.ndarray, ranks: np.ndarray, scale: Scale = COARSE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the selected windows in the array, ascending, and their hashes. ranks: those of the scale."""
    places, hashes = [], []
    sizes, window = np.diff(ends), scale.window
    span = window + scale.run - 1
    for a in range(0, len(data), PIECE_BYTES):
        lo, hi = max(0, a - HALO), min(len(data), a + PIECE_BYTES + HALO)
        part, cut = data[lo:hi], np.clip(ends, lo, hi) - lo
        bins = entropy_bins(part, window)
        n = len(bins)
        if not n:
            continue
        rank = np.where(_inside(cut, window, n), ranks[bins], UNRANKED)
        key = rank * _PLACE + np.arange(n)
        least, step = key.copy(), 1  # the best of a run of windows from each start on
        while step < scale.run:
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            step *= 2
        won = least[_inside(cut, span, len(least))] if len(least) else least
        small = np.flatnonzero((sizes >= window) & (sizes < span) & (ends[:-1] >= lo) & (ends[1:] <= hi))
        if len(small):  # too few windows for a run: all of them together are one
            edges = np.stack([cut[small], cut[small + 1] - window + 1], 1).ravel()
            won = np.concatenate([won, np.minimum.reduceat(np.append(key, UNRANKED * _PLACE), edges)[::2]])
        points = np.bincount((won[won < UNRANKED * _PLACE] % _PLACE), minlength=n)
        at = np.flatnonzero(points)
        doc = np.searchsorted(ends, at + lo, "right") - 1
        need = np.clip(sizes[doc] - span + 1, 1, scale.points)
        at = at[(points[at] >= need) & (at + lo >= a) & (at + lo < a + PIECE_BYTES)]
        hashes.append(span_hash(prefix_hash(part.astype(np.uint64)), at, at + window))
        places.append(at + lo)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def _fine(data: np.ndarray, ends: np.ndarray, docs: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fine features of the given texts: the text of each and its hash. A tiny text is its own feature."""
    sizes = np.diff(ends)[docs]
    group, nth = index_in(sizes)
    part, cut = data[ends[docs][group] + nth], np.concatenate([[0], np.cumsum(sizes)])
    at, hashes = features(part, cut, ranks, FINE)
    tiny = np.flatnonzero(sizes < FINE.window)
    whole = [span_hash(prefix_hash(part[cut[i] : cut[i + 1]].astype(np.uint64)), np.array([0]), np.array([sizes[i]])) for i in tiny]
    own = docs[np.searchsorted(cut, at, "right") - 1] if len(at) else at
    return np.concatenate([own, docs[tiny]]), np.concatenate([hashes, *whole])


def filters_of(data: np.ndarray, ends: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """Each text's chain of filters: uint64, filters x 33, of which the last is the number of the filter's scale."""
    at, hashes = features(data, ends, ranks[0], COARSE)
    doc = np.searchsorted(ends, at, "right") - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    sizes = np.diff(ends)
    few = np.flatnonzero((points[ends[1:]] - points[ends[:-1]] < SHORT) | (np.bincount(doc, minlength=len(sizes)) < FEW))
    fine_doc, fine = _fine(data, ends, few, ranks[1])
    group = np.concatenate([doc * 2, fine_doc * 2 + 1])
    hashes = np.concatenate([hashes, fine])
    order = np.lexsort((np.arange(len(group)), hashes, group))  # repeated features count once, where they stand first
    first = np.ones(len(order), bool)
    first[1:] = (group[order][1:] != group[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    keep = np.sort(order[first])
    keep = keep[np.argsort(group[keep], kind="stable")]
    group, hashes = group[keep], hashes[keep]
    count = np.bincount(group, minlength=2 * len(sizes))
    nth = index_in(count)[1]
    chain = (count + PER_FILTER - 1) // PER_FILTER
    row = (np.cumsum(chain) - chain)[group] + nth // PER_FILTER
    bits = np.zeros((int(chain.sum()), FILTER_BITS), np.uint8)
    for i in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * i)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    kind = np.repeat(np.arange(len(chain)) % 2, chain).astype(np.uint64)
    packed = np.concatenate([np.packbits(bits, axis=1).view(np.uint64), kind[:, None]], axis=1)
    of_text = chain.reshape(-1, 2).sum(1)
    base = np.cumsum(of_text) - of_text
    return [packed[b : b + c] for b, c in zip(base, of_text)]


def to_string(chain: np.ndarray) -> str:
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), np.uint64).reshape(-1, FILTER_BITS // 64 + 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean over the shorter chain's filters of the best partner's normalised overlap, scale by scale."""
    if np.array_equal(a, b):
        return 1.0
    weights, best = [], []
    for kind in range(len(SCALES)):
        x, y = a[a[:, -1] == kind, :-1], b[b[:, -1] == kind, :-1]
        if not len(x) or not len(y):
            continue
        if len(x) > len(y):
            x, y = y, x
        nx, ny = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
        for i in range(len(x)):  # a filter against a chain: memory stays in proportion to the chain
            common = np.bitwise_count(x[i] & y).sum(1, dtype=np.int64)
            most = np.minimum(nx[i], ny)
            chance = nx[i] * ny / FILTER_BITS
            floor = chance + np.maximum(0.3 * (most - chance), CHANCE_SD * np.sqrt(chance * (1 - np.maximum(nx[i], ny) / FILTER_BITS)))
            best.append(np.where(common > floor, (common - floor) / np.maximum(most - floor, 1e-9), 0).max())
            weights.append(nx[i])
    return float(min(1.0, np.average(best, weights=weights))) if best else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """The id and `fingerprint` of every row. ranks: from ranks_of(histogram(corpus)); if None, `docs` is that corpus."""
    ranks = ranks_of(histogram(docs, text_col)) if ranks is None else ranks
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=PIECE_BYTES):
            out = [to_string(c) for c in filters_of(*utf8(batch.column("text")), ranks)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


# -------------------------------------------------- a document and the next one


def with_next(docs: DataFrame, per_bucket: int = 64) -> DataFrame:
    """id, text, bucket, tail: ids ascending (null first), in buckets of neighbouring ids, a partition holding whole
    buckets in order; behind each bucket stands the first row of the next one, with tail = 1. The last bucket is
    followed by the very first row. Every row but the buckets' first ones moves once.
    """
    lowest = -(1 << 63)
    rows = docs.select("id", "text", F.coalesce(F.col("id").cast("bigint"), F.lit(lowest)).alias("key"))
    n = rows.count()
    want = min(max(1, n // per_bucket), MAX_SPLITS)
    splits: list[int] = []
    if want > 1:
        marks = rows.agg(F.percentile_approx("key", [i / want for i in range(1, want)], min(10 * want + 10_000, 1_000_000)).alias("q")).first()["q"]
        splits = sorted(set(marks))
    bucketed = rows.withColumn("bucket", bucket_of(F.col("key"), splits).cast("int"))
    first = {r["bucket"]: r["key"] for r in bucketed.groupBy("bucket").agg(F.min("key").alias("key")).collect()}  # as many as splits
    used = sorted(first)
    before = {b: used[i - 1] for i, b in enumerate(used)}  # of the first, the last
    has = [first.get(b, 0) for b in range(len(splits) + 1)]
    to = [before.get(b, -1) for b in range(len(splits) + 1)]
    lead = F.col("key") == item_of(has, F.col("bucket"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("tail"))
    ahead = F.struct(item_of(to, F.col("bucket")).cast("int").alias("bucket"), F.lit(1).alias("tail"))
    spread = bucketed.withColumn("at", F.explode(F.when(lead, F.array(own, ahead)).otherwise(F.array(own))))
    return spread.select("id", "text", "key", "at.bucket", "at.tail").repartition("bucket").sortWithinPartitions("bucket", "tail", "key", "text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: n_chars, its fingerprint, that of its edited text (the last quarter of its code points gives
    way to as many from the next document's beginning), the edited text's SHA-256, and how like it is to the edited text
    and to the next document. The next one is that of the next higher id; equal ids go by text; after the last, the first.
    """
    from hashlib import sha256

    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranks = ranks_of(histogram(docs))
    fields = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []  # the row that still waits for the next one
        for batch in pieces(batches, most=PIECE_BYTES):
            texts = batch.column("text").to_pylist()
            new = list(zip(batch.column("bucket").to_pylist(), batch.column("tail").to_pylist(), batch.column("id").to_pylist(), texts, filters_of(*utf8(batch.column("text")), ranks)))
            rows, last = last + new, new[-1:]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
            if not pairs:
                continue
            edited = []
            for a, b in pairs:
                quarter = len(a[3]) // 4
                edited.append(a[3][: len(a[3]) - quarter] + b[3][:quarter])
            changed = filters_of(*utf8(pa.array(edited, pa.large_string())), ranks)
            out = [
                pa.array([a[2] for a, _ in pairs], batch.schema.field("id").type),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([to_string(a[4]) for a, _ in pairs], pa.string()),
                pa.array([to_string(c) for c in changed], pa.string()),
                pa.array([likeness(a[4], c) for (a, _), c in zip(pairs, changed)], pa.float64()),
                pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(out, fields)

    kind = docs.schema["id"].dataType.simpleString()
    out = with_next(docs).mapInArrow(run, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
