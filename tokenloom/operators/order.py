"""Seeded epoch shuffles, shards and fixed-size batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tokenloom.constants import SEED
from tokenloom.operators.prefix import number_rows


def shuffle_key(seed: int, epoch: Column, row_id: Column) -> Column:
    """Sort key of a full, reproducible shuffle: new for every epoch, independent of layout."""
    return F.md5(F.concat_ws(":", (F.lit(seed) + epoch).cast("string"), row_id.cast("string")))


def order_epochs(df: DataFrame, seed: int = SEED, epochs: int = 1, row_id: str = "id") -> DataFrame:
    """Repeat the rows once per epoch and add `epoch` and `order_key`.

    `row_id` must be unique; the key hashes it, so every key range is even.
    """
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))) if epochs > 1 else F.lit(0)
    repeated = df.select("*", epoch.alias("epoch"))
    return repeated.withColumn("order_key", shuffle_key(seed, F.col("epoch"), F.col(row_id)))


def key_digits(df: DataFrame, groups: int = 1) -> int:
    """Hex digits of the shuffle key that name a bucket: at least 16 buckets per shuffle task.

    The choice is physical only; offsets do not depend on it.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(6, max(2, math.ceil(math.log(max(16 * tasks / max(groups, 1), 1), 16))))


def key_bucket(order_key: str, digits: int) -> Column:
    return F.conv(F.substring(order_key, 1, digits), 16, 10).cast("int")


def number_shuffled(df: DataFrame, epochs: int = 1) -> DataFrame:
    """Add the 1-based `ordinal` of every row in its epoch's shuffled order."""
    digits = key_digits(df, epochs)
    keyed = df.withColumn("key_bucket", key_bucket("order_key", digits))
    numbered = number_rows(keyed, ["epoch"], ["key_bucket"], ["order_key"])
    return numbered.drop("key_bucket")


def assign_shards(
    df: DataFrame, world_size: int, epochs: int = 1, exact: bool = False
) -> DataFrame:
    """Add `shard`: a disjoint and complete split of every epoch over `world_size` consumers.

    By default the shard comes from bits of the shuffle key that no bucket uses: no shuffle, and
    even up to chance. `exact=True` deals the shuffled rows round-robin instead (sizes differ by
    at most one), which numbers them first.
    """
    if world_size == 1 and not exact:
        return df.withColumn("shard", F.lit(0))
    if exact:
        numbered = number_shuffled(df, epochs)
        return numbered.withColumn("shard", F.pmod(F.col("ordinal") - 1, F.lit(world_size)).cast("int"))
    word = F.conv(F.substring("order_key", 17, 8), 16, 10).cast("bigint")
    return df.withColumn("shard", (word % F.lit(world_size)).cast("int"))


def number_batches(
    df: DataFrame,
    batch_size: int,
    order: str = "item_id",
    keep_short: bool = True,
    rows_per_bucket: int = 65536,
) -> DataFrame:
    """Group consecutive rows into `batch_id`s of `batch_size`; a short last batch is optional.

    `order` is a unique whole-number column; its value ranges form the buckets of the numbering, and
    ranges of these a second level, so that sparse ids do no harm. Rows without a key come first.
    """
    ranges = F.coalesce(F.expr(f"`{order}` div {rows_per_bucket}"), F.lit(-(1 << 62)))
    keyed = df.withColumn("order_bucket", ranges)
    numbered = number_rows(keyed, [], ["order_bucket"], [order], coarser=[1 << 24]).drop("order_bucket")
    batched = numbered.withColumn("batch_id", F.expr(f"(ordinal - 1) div {batch_size}"))
    if keep_short:
        return batched
    total = df.agg((F.count("*") / batch_size).cast("bigint")).scalar()
    return batched.where(F.col("batch_id") < total)
