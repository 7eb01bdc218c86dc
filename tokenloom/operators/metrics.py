"""Progress, loss and throughput reports over batch, score and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tokenloom.constants import IGNORE_LABEL
from tokenloom.operators.prefix import running_totals


def progress(
    batches: DataFrame,
    tokens_per_batch: int,
    log_every: int = 1,
    accumulation: int = 1,
    world_size: int = 1,
    batches_per_bucket: int = 65536,
) -> DataFrame:
    """Running totals of each consumer at its logging steps, scaled to all consumers.

    `batches` has `epoch, shard, batch_id, num_instruction`; totals run on over epochs. A step takes
    `accumulation` batches and logs when (step + 1) is a multiple of log_every * accumulation.
    """
    sizes = batches.groupBy("shard", "epoch").agg((F.max("batch_id") + 1).alias("_size"))
    earlier = Window.partitionBy("shard").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    # One row per epoch and shard.
    begins = sizes.select("shard", "epoch", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_begin"))
    placed = batches.join(begins, ["shard", "epoch"]).select(
        "epoch", "shard", "batch_id", (F.col("_begin") + F.col("batch_id")).alias("micro"), "num_instruction"
    )
    keyed = placed.withColumn("_bucket", F.expr(f"micro div {batches_per_bucket}"))
    summed = running_totals(keyed, ["shard"], ["_bucket"], ["micro"], {"instructions": F.col("num_instruction")})
    return (
        summed.withColumn("step", F.expr(f"micro div {accumulation}"))
        .where(F.expr(f"(step + 1) % {log_every * accumulation} = 0"))
        .select(
            "epoch",
            "shard",
            "batch_id",
            "step",
            (F.col("instructions") * world_size).alias("num_instruction"),
            ((F.col("micro") + 1) * tokens_per_batch * world_size / F.lit(1e9)).alias("total_tokens"),
        )
    )


def masked_nll(scores: DataFrame) -> DataFrame:
    """Mean cross-entropy over the positions whose label is not the ignore label."""
    seen = scores.where(F.col("label") != IGNORE_LABEL).withColumn("_top", F.array_max("logits"))
    shifted = F.zip_with("logits", F.array_repeat(F.col("_top"), F.size("logits")), lambda x, top: x - top)
    nll = (
        F.ln(F.aggregate(shifted, F.lit(0.0), lambda a, x: a + F.exp(x)))
        + F.col("_top")
        - F.get("logits", F.col("label").cast("int"))
    )
    return seen.select(nll.alias("nll")).agg(
        F.count(F.lit(1)).alias("positions"), F.avg("nll").alias("mean_nll")
    )


def throughput(runs: DataFrame) -> DataFrame:
    """Tokens per second: per mean rank (sum of all ranks' seconds) and per wall clock (longest rank)."""
    ranks = runs.groupBy("rank").agg(F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))
    return ranks.agg(
        F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / F.sum("seconds")).alias("per_rank_second"),
        (F.sum("tokens") / F.max("seconds")).alias("per_wall_second"),
    )


def batch_tokens(padded: DataFrame) -> DataFrame:
    """Tokens a padded batch holds: rows times padded length."""
    return padded.groupBy("batch_id").agg((F.count(F.lit(1)) * F.max(F.size("input_ids"))).alias("tokens"))


def tokens_per_call(runs: DataFrame) -> DataFrame:
    """Tokens per model call: mean of batch means, then of ranks; and weighted by calls."""
    batches = runs.groupBy("rank", "batch_id").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"))
    each = F.when(F.col("calls") > 0, F.col("tokens") / F.col("calls")).otherwise(F.lit(0.0))
    ranks = batches.groupBy("rank").agg(
        F.avg(each).alias("mean"), F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls")
    )
    return ranks.agg(
        F.avg("mean").alias("rank_mean"), (F.sum("tokens") / F.sum("calls")).alias("weighted_mean")
    )


def mean_work_length(runs: DataFrame) -> DataFrame:
    """Generated length processed per model call."""
    return runs.agg((F.sum("tokens") / F.sum("calls")).alias("mean_length"))
