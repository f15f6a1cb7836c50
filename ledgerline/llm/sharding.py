"""Sharding by sampled splitters, with DataFrame functions only.

1. Each record gets a key: 32 bits of its text's checksum, 16 of another hash of the text, 15 of its id's hash. So equal texts
   stand together, apart from others, while a large group of them can still be divided.
2. A sample in which a record's chance is proportional to its size is drawn; its quantiles are the splitters of many
   small ranges. The sample's expected length is a parameter, whatever the input.
3. Exact sizes of the ranges are counted; overfull ranges are subdivided until none is left that can be (all its keys equal)
   or there are MAX_SPLITS of them.
4. Records are ordered inside their range only. With the exact totals of the ranges before it, each record knows the
   bytes and rows ahead of it in the whole order, and so its shard and its slot there.

Law `bytes`: shard s takes the records that begin in the s-th of `shards` equal parts of all bytes, so sizes differ by
less than the largest record. The sample only decides how the work is split, never the result.

Groups: texts that are equal lie next to each other in this order. A group that reaches over the end of a shard's part goes on
in the next shard, as sizes have to be near equal; all others are in one shard.

Defined results: null text counts as empty; texts of any length are one record; a null id hashes as the empty string; ties of
the key go by id, then size; repeated rows each get a slot; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_SPLITS, bucket_of, item_of, settled

LOW_BITS, ID_BITS = 31, 15
#: Bytes that each record adds to its text's.
RECORD_BYTES = 16


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text)
    bits = lambda c, n: F.xxhash64(c).bitwiseAND(F.lit((1 << n) - 1))
    low = bits(text, LOW_BITS - ID_BITS) * F.lit(1 << ID_BITS) + bits(F.coalesce(F.col(id_col).cast("string"), F.lit("")), ID_BITS)
    return docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), crc.alias("crc"), (crc * F.lit(1 << LOW_BITS) + low).alias("key"))


def splitters(records: DataFrame, ranges: int, total: int, seed: int, sample: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of about `sample` keys."""
    draws = F.floor(F.col("size") * F.lit(sample / total) + F.rand(seed)).cast("long")
    drawn = records.select("key", draws.alias("n")).filter("n > 0").groupBy("key").agg(F.sum("n").alias("n")).collect()
    drawn.sort(key=lambda r: r["key"])
    step, ahead, out = sum(r["n"] for r in drawn) / ranges, 0, []
    for r in drawn:
        if ahead and ahead + r["n"] >= step * (len(out) + 1):
            out.append(r["key"])
        ahead += r["n"]
    return sorted(set(out))


def range_totals(records: DataFrame, splits: list[int]) -> list:
    """Of each range that has records: its number, bytes, rows, least and greatest key. As many rows as ranges at most."""
    return records.groupBy(bucket_of(F.col("key"), splits).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()


def subdivided(splits: list[int], totals: list, most: float) -> list[int]:
    """More splitters inside the ranges over `most` bytes, evenly over the keys these have."""
    more = set(splits)
    for r in totals:
        if r["bytes"] > most and r["hi"] > r["lo"]:
            parts = min(math.ceil(2 * r["bytes"] / most), r["hi"] - r["lo"], MAX_SPLITS)
            more.update(r["lo"] + (r["hi"] - r["lo"]) * i // parts + 1 for i in range(parts))
    return sorted(more) if len(more) <= MAX_SPLITS else splits


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, ranges_per_shard: int = 16, rows_per_range: int = 100_000, sample_per_range: int = 16) -> DataFrame:
    """doc id, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard) of every record."""
    records = settled(keyed(docs, id_col, text_col))
    whole = records.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    total = max(whole["bytes"], 1)
    ranges = min(max(shards * ranges_per_shard, math.ceil(whole["rows"] / rows_per_range)), MAX_SPLITS // 4)
    splits = splitters(records, ranges, total, seed, ranges * sample_per_range)
    totals = range_totals(records, splits)
    while True:
        finer = subdivided(splits, totals, 4 * total / ranges)
        if finer == splits:
            break
        splits = finer
        totals = range_totals(records, splits)
    of = {r["range"]: r for r in totals}
    bytes_before, rows_before = [0], [0]
    for i in range(len(splits) + 1):
        r = of.get(i)
        bytes_before.append(bytes_before[-1] + (r["bytes"] if r else 0))
        rows_before.append(rows_before[-1] + (r["rows"] if r else 0))
    inside = Window.partitionBy("range").orderBy("key", "id", "size")
    ahead = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = records.withColumn("range", bucket_of(F.col("key"), splits)).select(
        "id", "size", "crc", (ahead + item_of(bytes_before, F.col("range"))).alias("at"), (F.row_number().over(inside) - 1 + item_of(rows_before, F.col("range"))).alias("nth"))
    placed = settled(placed.withColumn("shard", F.least(F.expr(f"cast(at * {shards} div {total} as int)"), F.lit(shards - 1))))
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("nth").alias("first")).collect()}
    firsts = item_of([first.get(s, 0) for s in range(shards)], F.col("shard"))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("nth") - firsts).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", **how) -> None:
    """Write the documents below `path` in one folder for each shard, in slot order; ids have to be unique."""
    where = assign_shards(docs, shards, id_col, text_col, **how).select(id_col, "shard", "slot")
    docs.join(where, id_col).repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
