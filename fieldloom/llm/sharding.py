"""Sharding by jump consistent hashing.

Lamping and Veach's jump hash (2014) finds a key's shard without a table of the ring: it follows
the key through the shard counts at which it would move. Going from n to n + 1 shards moves
1 / (n + 1) of the keys, and all of them into the new shard.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, 0 to shards - 1."""
    if shards < 1:
        raise ValueError("there must be one shard at least")
    state = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead = ((shard[live] + 1) * (2.0**31 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live, ahead = live[ahead < shards], ahead[ahead < shards]
        shard[live] = ahead
    return shard


def shard_of(keys: Sequence[str], shards: int) -> Column:
    """The shard of a row, from the columns ``keys``; nulls are a key of their own."""

    @F.pandas_udf("int")
    def assign(key: pd.Series) -> pd.Series:
        return pd.Series(jump(key.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return assign(F.xxhash64(*keys))


def numbered(df: DataFrame, shard: str, slot: str) -> DataFrame:
    """Adds ``slot``: the rows of each shard numbered from 0 without gaps.

    The rows are written first, with the partition each stands in. A slot is then the count of the shard's
    rows in earlier partitions plus the row's rank in its own, so that no task ever holds a whole shard.
    """
    rows = written(df.withColumn("__at", F.monotonically_increasing_id()), "slots").withColumn("__part", F.shiftright("__at", 33))
    counts = rows.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(shard, "__part").orderBy("__at"))
    return rows.join(offsets, [shard, "__part"]).withColumn(slot, F.col("__before") + rank - 1).drop("__before", "__at", "__part")


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: only the key and the shard count decide, so that copies of a row with one key share a
    shard, whatever its size. size: UTF-8 bytes plus one; a null text has none. A null key is one more key; an
    empty table gives no rows; other columns are ignored.
    """
    of = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(of) + 1).cast("long").alias("size"),
        F.crc32(of).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of([key], shards).alias("shard"),
        shard_of([key], shards + 1).alias("grown_shard"),
    )
    return numbered(rows, "shard", "slot").select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
