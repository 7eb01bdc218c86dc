"""Block-wise generation as staged iteration: score, pick, update and stop, until every sequence has ended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenloom.constants import EOS_IDS, MASK_ID
from tokenloom.functions.ids import is_eos
from tokenloom.operators.select import apply_updates, confidence, pick_threshold
from tokenloom.sources.workspace import discard, new_folder

STATE = (
    "seq_id bigint, ids array<bigint>, prompt int, block int, step int, bridge boolean, calls bigint, tokens bigint, done boolean"
)
SCORES = "seq_id bigint, pos int, logits array<double>, filled boolean"


def score_windows(state: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], block_length: int, mask_id: int = MASK_ID) -> DataFrame:
    """`seq_id, pos, logits, filled` for the window of every open sequence: its last block, or its last two on a bridge.

    `fn` gets `seq_id, ids, start` (whole ids and the window's first place) and returns `seq_id, pos, logits` for the places
    of the window. It runs on Arrow batches where the rows are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                out = fn(batch)
                ids = dict(zip(batch["seq_id"], batch["ids"], strict=True))
                filled = [ids[s][p] != mask_id for s, p in zip(out["seq_id"], out["pos"], strict=True)]
                yield pd.DataFrame({"seq_id": out["seq_id"], "pos": out["pos"], "logits": out["logits"], "filled": filled})

    width = F.when(F.col("bridge"), F.lit(2 * block_length)).otherwise(F.lit(block_length))
    return state.select("seq_id", "ids", (F.size("ids") - width).alias("start")).mapInPandas(run, SCORES)


def advanced(state: DataFrame, picks: DataFrame, block_length: int, max_blocks: int, mask_id: int, eos_ids: tuple) -> DataFrame:
    """The states after one update. A block ends when no mask is left in the generation, or after `block_length` steps;
    then the sequence ends with an end id or its last block, else a block of masks is added, whose first scores
    cover the block before as well (a bridge)."""
    moved = apply_updates(state.select("seq_id", "ids"), picks)
    counts = picks.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    joined = state.drop("ids").join(moved, "seq_id").join(counts, "seq_id", "left")
    # The first scores of a sequence fill in its first block and count as no call.
    first = F.col("step") < 0
    stepped = joined.select(
        "seq_id", "ids", "prompt",
        F.when(F.col("bridge"), F.col("block") + 1).otherwise(F.col("block")).alias("block"),
        F.when(F.col("bridge") | first, F.lit(0)).otherwise(F.col("step") + 1).alias("step"),
        (F.col("calls") + F.when(first, 0).otherwise(1)).alias("calls"),
        (F.col("tokens") + F.coalesce("n", F.lit(0))).alias("tokens"),
    )
    made = F.slice("ids", F.col("prompt") + 1, F.size("ids"))
    ended = ~F.exists(made, lambda x: x == mask_id) | (F.col("step") >= block_length)
    over = ended & (F.exists(made, lambda x: is_eos(x, eos_ids)) | (F.col("block") >= max_blocks - 1))
    grows = ended & ~over
    masks = F.array_repeat(F.lit(mask_id).cast("bigint"), block_length)
    return stepped.select(
        "seq_id", F.when(grows, F.concat("ids", masks)).otherwise(F.col("ids")).alias("ids"), "prompt", "block", "step",
        grows.alias("bridge"), "calls", "tokens", over.alias("done"),
    )


def decode_blocks(
    prompts: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    block_length: int = 128,
    gen_length: int = 1024,
    tau: float = 0.6,
    edit: bool = False,
    mask_id: int = MASK_ID,
    eos_ids: tuple = EOS_IDS,
    pick: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """`seq_id, output_ids, calls, tokens` of every prompt (`seq_id, input_ids`), sequences ending each on its own.

    Every turn scores the open sequences with `fn`, turns scores into confidences, picks positions (`pick`, by default
    `pick_threshold` with `tau` and `edit`) and writes them in; it ends when no sequence is open. States are a stage
    table per turn, and what has ended is put aside once, so a lost executor costs one turn and later turns read open
    sequences only. There are at most (block_length + 1) turns per block. Ids must be unique; a prompt may be empty.
    """
    spark: SparkSession = prompts.sparkSession
    blocks = gen_length // block_length
    if blocks < 1:
        raise ValueError("gen_length must hold a block")
    choose = pick or (lambda scored: pick_threshold(scored, tau, edit))
    folder, masks = new_folder(spark, "decode"), F.array_repeat(F.lit(mask_id).cast("bigint"), block_length)
    asked = F.coalesce(F.col("input_ids").cast("array<bigint>"), F.array().cast("array<bigint>"))
    start = prompts.select(
        F.col("seq_id").cast("bigint").alias("seq_id"), F.concat(asked, masks).alias("ids"), F.size(asked).alias("prompt"), F.lit(0).alias("block"),
        F.lit(-1).alias("step"), F.lit(False).alias("bridge"), F.lit(0).cast("bigint").alias("calls"), F.lit(0).cast("bigint").alias("tokens"), F.lit(False).alias("done"),
    )
    start.write.partitionBy("done").parquet(f"{folder}/turn=0")
    turn = 0
    while True:
        state = spark.read.schema(STATE).parquet(f"{folder}/turn={turn}").where("not done")
        if state.isEmpty():
            break
        scored = confidence(score_windows(state, fn, block_length, mask_id))
        # Picks are read twice; scores come from the user's model, which runs once.
        picks_at = new_folder(spark, "picks")
        choose(scored).select("seq_id", "pos", F.col("token").cast("bigint").alias("token")).write.parquet(picks_at)
        picks = spark.read.parquet(picks_at)
        advanced(state, picks, block_length, blocks, mask_id, eos_ids).write.partitionBy("done").parquet(f"{folder}/turn={turn + 1}")
        discard(picks)
        turn += 1
    ended = spark.read.schema(STATE).option("basePath", folder).parquet(*[f"{folder}/turn={n}" for n in range(turn + 1)]).where("done")
    return ended.select("seq_id", F.slice("ids", F.col("prompt") + 1, F.size("ids")).alias("output_ids"), "calls", "tokens")


def run_log(decoded: DataFrame, batch_size: int = 1, world_size: int = 1, seconds: float = 0.0) -> DataFrame:
    """`rank, batch_id, step, tokens, calls, seconds` of decoded sequences, as `tokens_per_call` takes them."""
    batch = F.expr(f"seq_id div {batch_size}")
    return decoded.select(F.pmod(batch, F.lit(world_size)).cast("int").alias("rank"), batch.alias("batch_id"), F.col("seq_id").alias("step"), "tokens", "calls", F.lit(seconds).alias("seconds"))
