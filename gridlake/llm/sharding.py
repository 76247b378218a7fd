"""Sharding by jump consistent hashing.

A stable key is mapped to one of n shards by arithmetic alone (no ring table). Going from n to n+1 shards moves only
the keys that the new shard takes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, by the published jump recurrence, all keys of a batch at once."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.int64).view(np.uint64).copy()
    last, following = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        last[live] = following[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ratio = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1)
        following[live] = ((last[live] + 1) * ratio).astype(np.int64)
        live = live[following[live] < shards]
    return last


def shard_of(key: Column, shards: int) -> Column:
    """Integer shard of a key column of any type; null keys are hashed like any other value."""

    @F.pandas_udf("int")
    def run(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(), shards).astype(np.int32))

    return run(F.xxhash64(key))


def assign(documents: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", buckets: int = 256) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the key and the number of shards decide, so equal keys share a shard. ``size`` is the UTF-8
    length of the text plus 16 (null text: 16, crc32 of nothing: 0). ``slot`` counts 0, 1, ... in each shard: each
    shard is cut into ``buckets`` by the key's hash, one small table has the buckets' starts (shards * buckets rows at most, so it
    can be broadcast), and only bucket members are numbered together. Repeated rows get slots of their own.
    """
    shard = shard_of(F.col(key), shards)
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(buckets)).cast("int")
    counts = documents.select(shard.alias("shard"), bucket.alias("bucket")).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    body = F.coalesce(F.col(text), F.lit(""))
    slim = documents.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard.alias("shard"),
        shard_of(F.col(key), shards + 1).alias("grown_shard"),
        bucket.alias("bucket"),
    )
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    numbered = slim.withColumn("nth", nth).join(F.broadcast(starts), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard")
