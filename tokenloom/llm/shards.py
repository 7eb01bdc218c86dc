"""Sharding by jump consistent hashing: a key finds its shard by arithmetic, with no ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tokenloom.operators.prefix import number_rows

#: Fixed values of the published algorithm: its generator's multiplier.
MULTIPLIER = np.uint64(2862933555777941757)
ROWS_PER_BUCKET = 4096


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys. Each key jumps forward through shard counts and keeps its last stop; going
    from n to n + 1 shards moves a key only if its next stop is n."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    state = keys.astype(np.uint64, copy=True)
    found = np.zeros(len(keys), dtype=np.int32)
    stop = np.zeros(len(keys), dtype=np.float64)
    moving = np.arange(len(keys))
    while len(moving):
        found[moving] = stop.astype(np.int32)
        with np.errstate(over="ignore"):
            state = state * MULTIPLIER + np.uint64(1)
        stop = np.floor((found[moving] + 1.0) * (2147483648.0 / ((state >> np.uint64(33)).astype(np.float64) + 1.0)))
        on = stop < shards
        moving, state, stop = moving[on], state[on], stop[on]
    return found


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key column, 0 to shards - 1; a null key counts as 0."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return place(F.coalesce(key, F.lit(0).cast("bigint")))


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", grow: int = 1, tie: Column | None = None) -> DataFrame:
    """Add `shard`, `grown_shard` (with `grow` more shards) and `slot`, dense from 0 in each shard.

    Only the key and the shard count decide a shard: equal keys, also null ones, share one. Slots follow
    (bucket, key, tie), where buckets are hashed from key and `tie` (any expression that tells rows of one
    key apart), so that no shard is numbered in one task. Rows equal in key and tie take consecutive slots in
    any order. An empty table gives an empty table. Columns named like the added ones are replaced.
    """
    rows = df.drop("shard", "grown_shard", "slot")
    buckets = max(1, -(-rows.count() // (shards * ROWS_PER_BUCKET)))
    hashed = F.xxhash64(F.col(key))
    tie = F.lit(0) if tie is None else tie
    placed = rows.withColumns(
        {
            "shard": shard_of(hashed, shards),
            "grown_shard": shard_of(hashed, shards + grow),
            "_tie": tie,
            "_bucket": F.pmod(F.xxhash64(F.lit("slot"), F.col(key), tie), F.lit(buckets)),
        }
    )
    numbered = number_rows(placed, ["shard"], ["_bucket"], [key, "_tie"], "slot")
    return numbered.withColumn("slot", F.col("slot") - 1).drop("_bucket", "_tie")


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write whole rows below `path`, one folder per shard; a hot shard is split over tasks by AQE."""
    placed = df.withColumn("shard", shard_of(F.xxhash64(F.col(key)), shards))
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def shard_digest(documents: DataFrame, shards: int = 24) -> DataFrame:
    """The query's columns for every row of `documents` (a null text has no bytes)."""
    text = F.coalesce("text", F.lit(""))
    narrow = documents.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign_shards(narrow, shards, tie=F.struct("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
