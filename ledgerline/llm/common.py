"""Helpers that several training-data operators share.

Spark side: tables kept in the shared checkpoint folder and bucketing by a bounded list of splitters.
Task side: Arrow string columns as flat UTF-8 arrays, cut into pieces of bounded size, and hashes of words taken from
those arrays without making Python strings.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A task handles texts in pieces of about so many bytes; only a single longer text makes a larger piece.
PIECE_BYTES = 1 << 20
#: At most so many splitters are ever made, whatever the size of the input.
MAX_SPLITS = 1 << 16

WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: a temporary one, but only on a single machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        sc.setCheckpointDir(named)
    return named


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Writes inside the block remove their shuffle files when they end; what they wrote takes their place."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def settled(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage is cut and it is computed once.

    The files live in shared storage, so lost executors don't take them away. They go when `scratch` is cleared, or when
    the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerline-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(where)
    if scratch is not None:
        scratch.paths.append((files, where))
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Settled tables that nothing reads any more once the block ends."""

    def __init__(self) -> None:
        self.paths: list[tuple] = []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        return settled(df, self)

    def also(self, spark: SparkSession, path: str) -> None:
        """A path of the shared folder that goes with the rest."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.paths.append((where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where))

    def __exit__(self, *_) -> None:
        for files, where in self.paths:
            files.delete(where, True)
        self.paths.clear()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _longs(values: Sequence[int]) -> Column:
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def bucket_of(key: Column, splits: Sequence[int]) -> Column:
    """How many of the sorted splits are <= key, found in two steps of about sqrt(len(splits)) comparisons each."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits) - 1) + 1
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]
    within = lambda of: F.size(F.filter(of, lambda s: s <= key))
    coarse = within(_longs([g[0] for g in groups]))
    fine = within(F.element_at(F.array(*[_longs(g) for g in groups]), coarse))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine)


def item_of(values: Sequence[int], at: Column) -> Column:
    """values[at], of a bounded list, again in two steps."""
    step = math.isqrt(max(len(values), 1) - 1) + 1 if len(values) > 1 else 1
    groups = [values[i : i + step] for i in range(0, len(values), step)]
    row = F.element_at(F.array(*[_longs(g) for g in groups]), (F.floor(at / step) + 1).cast("int"))
    return F.element_at(row, (at % step + 1).cast("int"))


# ---------------------------------------------------------------- inside tasks


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and the len + 1 offsets of the texts in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 * PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `most` bytes of text or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes: xor-shifts and odd multipliers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the hash base and of its inverse, kept for the longest piece so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PIECE_BYTES + 4096)
            cls.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE_INV)]), dtype=np.uint64)
        return cls.up, cls.down


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums P of values[i] * base**i, modulo 2**64; len + 1 of them."""
    up, _ = Powers.to(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) that depend on the contents only."""
    _, down = Powers.to(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z in lower case) of all texts, and how many words each text has.

    Words are runs of bytes other than space and 0x09-0x0D; two words are the same if their hashes are.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends) - 1, np.int64)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    last = ~space
    last[:-1] &= space[1:]
    inner = ends[(ends > 0) & (ends < n)]
    first[inner] |= ~space[inner]
    last[inner - 1] |= ~space[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    count = np.diff(np.searchsorted(start, ends))
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # a piece of whole words
        to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE_BYTES, "right")))
        a = start[at]
        prefix = prefix_hash(_LOWER[data[a : end[to - 1]]])
        hashes[at:to] = span_hash(prefix, start[at:to] - a, end[at:to] - a)
        at = to
    return hashes, count


def index_in(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For `count` items of each group in a row: the group of each item, and its place in the group."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches that come sorted by `key`, cut between groups: tables of at least `rows` rows (the last one of fewer) and
    where their groups start and end. Only a single group can make a table much larger.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        own = batch.column(key).to_numpy()
        change = np.flatnonzero(own[1:] != own[:-1])
        whole = int(change[-1]) + 1 if len(change) else 0
        if not whole and (len(held) == 1 or held[-2].column(key)[-1].as_py() == own[0]):
            continue  # one group so far at the end
        ready = pa.Table.from_batches(held[:-1] + [batch.slice(0, whole)])
        held, count = [batch.slice(whole)], batch.num_rows - whole
        yield ready.combine_chunks(), _group_ends(ready.column(key).to_numpy())
    if held:
        last = pa.Table.from_batches(held)
        yield last.combine_chunks(), _group_ends(last.column(key).to_numpy())


def _group_ends(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n items with links a - b: the least item that each one reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        apart = label[a] != label[b]
        if not apart.any():
            break
        a, b, low = a[apart], b[apart], low[apart]
        for side in (label[a], label[b]):  # hooks the root of each side, too
            np.minimum.at(label, side, low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
