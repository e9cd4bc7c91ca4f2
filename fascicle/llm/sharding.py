"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A shard depends on the key and the count of shards alone: no ring, no table. With
one more shard, only rows that land in the new one move.

A null key counts as the key 0 before mixing. Null and empty texts have size 1.
Rows with equal keys share a shard and take neighbouring slots, told apart by size
and checksum; rows that agree in all of these are interchangeable. Empty input
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fascicle.llm.common import cut, partitions, text_of


def mix(keys: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that neighbouring ids do not share their first jumps."""
    z = keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: jump ahead while the next jump stays below ``shards``."""
    key, at = keys.copy(), np.zeros(len(keys), np.int64)
    live, ahead = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1)
        ahead[live] = np.minimum((at[live] + 1) * step, 2.0**62).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def assign(df: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """``df`` with ``shard`` and ``grown_shard``, the shard when there is one more; clashing columns are replaced."""
    df = df.drop("shard", "grown_shard")
    schema = df.withColumn("shard", F.lit(0)).withColumn("grown_shard", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = mix(b.column(key).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
            new = [pa.array(jump(keys, n).astype(np.int32)) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "shard", "grown_shard"])

    return df.mapInArrow(run, schema)


def slots(df: DataFrame, key: str, order: tuple[str, ...], shards: int, buckets: int | None = None) -> DataFrame:
    """``df`` with ``slot``, gapless from 0 within each shard. Each shard is ordered in ``buckets`` parts side by side, more of them for larger inputs; only their counts meet."""
    buckets = buckets or max(64, -(-4 * partitions(df, 1 << 20) // shards))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    counts = df.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # shards * buckets rows at most: a few for each task.
    base = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("shard", "__bucket").orderBy(key, *order)
    out = df.withColumn("__nth", F.row_number().over(within)).join(F.broadcast(base), ["shard", "__bucket"])
    return out.withColumn("slot", F.col("__base") + F.col("__nth") - 1).drop("__bucket", "__nth", "__base")


def shard_rows(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The placement of every row under the law ``key``, without the texts: size, checksum, shard, slot and grown shard."""
    light = df.select(
        key,
        (F.octet_length(text_of(text)) + 1).cast("long").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return slots(cut(assign(light, shards, key)), key, ("size", "text_crc32"), shards).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Write whole rows into one folder a shard; several tasks write each."""
    out = assign(df, shards, key)
    out.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(8))).repartition("shard", "__part").drop("__part", "grown_shard").write.partitionBy("shard").parquet(path)
