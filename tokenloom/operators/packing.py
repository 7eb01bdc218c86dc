"""Concatenate examples into one token stream per epoch and shard and cut it into blocks.

Data flow for one pass over the wide token arrays:

1. A narrow aggregate totals rows and tokens of every cell (a prefix of the shuffle key); windows over this small table
   give each cell its place in the stream, and join neighbouring cells into runs of about equal tokens.
2. One exchange and one sort bring the examples of a run together. The cells that a run needs to complete its last
   batch are sent to it as well as to their own run.
3. One Arrow pass over the sorted rows cuts them into blocks (`cutter`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tokenloom.constants import BATCH_SIZE, IGNORE_LABEL, MAX_LENGTH
from tokenloom.operators.cutter import INPUT, SCHEMA, cutter
from tokenloom.operators.order import key_bucket, key_digits
from tokenloom.operators.prefix import running_totals

STREAM = ["epoch", "shard"]
#: Cells of all streams together, so that their table can be broadcast (about 100 MB in memory).
MOST_CELLS = 1 << 20


def record_defaults(df: DataFrame) -> DataFrame:
    """Missing ids become an empty array, a missing prompt length becomes 0."""
    return df.withColumns(
        {
            "input_ids": F.coalesce("input_ids", F.array().cast("array<bigint>")),
            "prompt_length": F.coalesce("prompt_length", F.lit(0)),
        }
    )


def with_token_count(df: DataFrame) -> DataFrame:
    """Add `n_tokens` early, so that passes which need only lengths carry no arrays."""
    if "n_tokens" in df.columns:
        return df
    return df.withColumn("n_tokens", F.greatest(F.size("input_ids"), F.lit(0)).cast("bigint"))


def pack_offsets(df: DataFrame, streams: int = 1) -> DataFrame:
    """Add `ordinal`, `start` and `end` of every example in its stream, and its bucket's bounds.

    `df` has `epoch, shard, order_key` (see `order_epochs`, `assign_shards`); `streams`, the
    number of (epoch, shard) pairs, only sizes the buckets. Whether their table is broadcast is Spark's choice.
    """
    digits = key_digits(df, streams)
    keyed = with_token_count(df).withColumn("key_bucket", key_bucket("order_key", digits))
    if "ordinal" in keyed.columns:
        keyed = keyed.drop("ordinal")
    summed = running_totals(
        keyed,
        STREAM,
        ["key_bucket"],
        ["order_key"],
        {"ordinal": F.lit(1).cast("bigint"), "end": F.col("n_tokens")},
        keep_bounds=True,
    )
    return summed.select(
        *keyed.columns,
        "ordinal",
        (F.col("end") - F.col("n_tokens")).alias("start"),
        "end",
        F.col("end_before").alias("bucket_start"),
        F.col("end_through").alias("bucket_end"),
    )


def pieces_of(
    offsets: DataFrame, keys: list[str], span: int, with_ids: bool = True, keep: Column | None = None
) -> DataFrame:
    """Cut examples at multiples of `span` tokens: one row per example and batch it touches.

    An example that ends a batch also sends a piece, possibly of no tokens, to the next batch, so
    that each batch knows the ordinal that completed the one before it (`done_before`). `keep`
    picks rows by `batch_id` before anything is cut. Slices stand outside of array lambdas, where
    they compile; inside they would box every token.
    """
    touched = offsets.where("n_tokens > 0").select(
        *keys,
        "ordinal",
        "start",
        "end",
        *(["input_ids", "prompt_length"] if with_ids else []),
        *(["bucket_start", "bucket_end"] if keep is not None else []),
        F.explode(F.sequence(F.expr(f"start div {span}"), F.expr(f"end div {span}"))).alias("batch_id"),
    )
    if keep is not None:
        touched = touched.where(keep)
    low = F.greatest(F.col("start"), F.col("batch_id") * span)
    n = F.least(F.col("end"), (F.col("batch_id") + 1) * span) - low
    columns = [
        *keys,
        "batch_id",
        low.alias("low"),
        n.alias("n"),
        F.when(n > 0, F.col("ordinal")).alias("done"),
        F.when(F.col("start") < F.col("batch_id") * span, F.col("ordinal")).alias("done_before"),
    ]
    if with_ids:
        skipped, size = (low - F.col("start")).cast("int"), n.cast("int")
        hidden = F.greatest(F.least(F.col("prompt_length") - skipped, size), F.lit(0))
        columns += [
            F.slice("input_ids", skipped + 1, size).alias("ids"),
            F.concat(
                F.array_repeat(F.lit(IGNORE_LABEL).cast("bigint"), hidden),
                F.slice("input_ids", skipped + hidden + 1, size - hidden),
            ).alias("labels"),
        ]
    return touched.select(*columns)


def gather(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Put the pieces of each batch together: at most one batch of tokens per group."""
    part = F.when(F.col("n") > 0, F.struct("low", "ids", "labels"))
    return pieces.groupBy(*keys, "batch_id").agg(
        F.sum("n").alias("n_tokens"),
        F.max("done").alias("done"),
        F.coalesce(F.max("done_before"), F.lit(0)).alias("done_before"),
        F.sort_array(F.collect_list(part)).alias("parts"),
    )


def blocks_of(batches: DataFrame, keys: list[str], max_length: int, batch_size: int) -> DataFrame:
    """Cut gathered batches into blocks of `max_length` ids with labels."""
    flat = batches.select(
        *keys,
        "batch_id",
        (F.col("done") - F.col("done_before")).alias("num_instruction"),
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("input_ids"),
        F.flatten(F.transform("parts", lambda p: p["labels"])).alias("labels"),
    )
    if batch_size == 1:
        return flat.select(
            *keys, "batch_id", F.col("batch_id").alias("chunk_id"), "num_instruction", "input_ids", "labels"
        )
    slots = F.sequence(F.lit(0), F.ceil(F.size("input_ids") / max_length).cast("int") - 1)
    return flat.select("*", F.explode(slots).alias("slot")).select(
        *keys,
        "batch_id",
        (F.col("batch_id") * batch_size + F.col("slot")).alias("chunk_id"),
        "num_instruction",
        F.slice("input_ids", F.col("slot") * max_length + 1, F.lit(max_length)).alias("input_ids"),
        F.slice("labels", F.col("slot") * max_length + 1, F.lit(max_length)).alias("labels"),
    )


def pack(
    df: DataFrame,
    max_length: int = MAX_LENGTH,
    batch_size: int = BATCH_SIZE,
    drop_tail: bool = True,
    streams: int = 1,
) -> DataFrame:
    """Blocks of every stream: `epoch, shard, batch_id, chunk_id, num_instruction, input_ids, labels`.

    Examples may straddle blocks. The incomplete last batch of a stream is dropped unless
    `drop_tail=False`. With `batch_size=1` every complete block is kept.
    """
    rows = with_token_count(record_defaults(df))
    digits = cell_digits(rows, streams)
    keyed = rows.withColumn("cell", key_bucket("order_key", digits))
    cells = run_cells(keyed, max_length * batch_size, streams)
    # The number of cells is bounded by their digits; with more streams than that the join is Spark's choice.
    cells = F.broadcast(cells) if streams * 16**digits <= MOST_CELLS else cells
    placed = keyed.join(cells, [*STREAM, "cell"]).withColumn("bucket", F.explode("runs"))
    sent = placed.select(
        *[F.col(c).cast("int") for c in STREAM], "bucket", "cell", "cell_start", "cell_rows",
        (F.col("bucket") == F.col("own_run")).alias("own"), "n_tokens", "input_ids", F.col("prompt_length").cast("bigint").alias("prompt_length"),
        F.xxhash64(*STREAM, "bucket").alias("slot"), "order_key",
    )
    ordered = sent.repartition("slot").sortWithinPartitions("slot", *STREAM, "bucket", "order_key")
    return ordered.select(*INPUT).mapInArrow(cutter(max_length, batch_size, drop_tail), SCHEMA)


def cell_digits(df: DataFrame, streams: int) -> int:
    """Hex digits of the shuffle key that name a cell: about 256 cells per shuffle task, MOST_CELLS in all."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = math.ceil(math.log(max(256 * tasks / max(streams, 1), 16), 16))
    return max(1, min(wanted, int(math.log(max(MOST_CELLS / max(streams, 1), 16), 16) + 1e-9)))


def run_cells(keyed: DataFrame, span: int, streams: int) -> DataFrame:
    """One row per cell with tokens: where it starts (`cell_start` tokens and `cell_rows` examples before it), the run it
    belongs to (`own_run`), and the `runs` that need its examples.

    Runs are stretches of equal length in the stream, of eight batches at least and about 16 for each task. A batch
    belongs to the run of the token before it. A cell is needed by its own run if such a token lies in it or before
    it in the run, and by the run of the batch that is open where the cell starts.
    """
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy(*STREAM).orderBy("cell")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*STREAM, "cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"))
    nothing = F.lit(0).cast("bigint")
    placed = sums.select(
        *STREAM, "cell", "tokens",
        F.coalesce(F.sum("tokens").over(before), nothing).alias("cell_start"),
        F.coalesce(F.sum("rows").over(before), nothing).alias("cell_rows"),
        F.sum("tokens").over(Window.partitionBy(*STREAM)).alias("total"),
    ).where("tokens > 0")
    runs = max(1, 16 * tasks // max(streams, 1))
    own = placed.withColumn("own_run", F.expr(f"cell_start div greatest({8 * span}, total div {runs} + 1)"))
    marked = own.withColumn("mark", F.expr(f"cell_start = 0 or (cell_start + tokens) div {span} > cell_start div {span}"))
    opened = marked.withColumn("open_run", F.last(F.when(F.col("mark"), F.col("own_run")), ignorenulls=True).over(before))
    here = F.col("mark") | F.coalesce(F.col("open_run") == F.col("own_run"), F.lit(False))
    needed = F.array(F.when(here, F.col("own_run")), F.when(F.col("open_run") != F.col("own_run"), F.col("open_run")))
    return opened.select(*STREAM, "cell", "cell_start", "cell_rows", "own_run", F.filter(needed, lambda x: x.isNotNull()).alias("runs"))


def batch_counts(
    df: DataFrame, max_length: int = MAX_LENGTH, batch_size: int = BATCH_SIZE, streams: int = 1
) -> DataFrame:
    """Examples consumed per complete batch since the batch before it; carries no arrays."""
    span = max_length * batch_size
    pieces = pieces_of(pack_offsets(record_defaults(df), streams), STREAM, span, with_ids=False)
    batches = pieces.groupBy(*STREAM, "batch_id").agg(
        F.sum("n").alias("n_tokens"), F.max("done").alias("done"), F.max("done_before").alias("done_before")
    )
    return batches.where(F.col("n_tokens") == span).select(
        *STREAM, "batch_id", (F.col("done") - F.coalesce("done_before", F.lit(0))).alias("num_instruction")
    )


def packing_stats(
    df: DataFrame, max_length: int = MAX_LENGTH, batch_size: int = BATCH_SIZE, streams: int = 1
) -> DataFrame:
    """Per stream: examples, tokens, complete blocks and batches, straddling examples, tail, supervision."""
    offsets = pack_offsets(record_defaults(df), streams).select(
        *STREAM, "n_tokens", "start", "end", "prompt_length"
    )
    crosses = (F.col("n_tokens") > 0) & (F.expr(f"start div {max_length} < (end - 1) div {max_length}"))
    supervised = F.greatest(F.col("n_tokens") - F.greatest("prompt_length", F.lit(0)), F.lit(0))
    return (
        offsets.groupBy(*STREAM)
        .agg(
            F.count("*").alias("examples"),
            F.sum("n_tokens").alias("tokens"),
            F.sum(crosses.cast("bigint")).alias("straddling"),
            F.sum(supervised).alias("supervised_tokens"),
        )
        .select(
            *STREAM,
            "examples",
            "tokens",
            F.expr(f"tokens div {max_length}").alias("blocks"),
            F.expr(f"tokens div {max_length * batch_size}").alias("batches"),
            F.expr(f"tokens % {max_length}").alias("tail_tokens"),
            "straddling",
            "supervised_tokens",
            F.round(F.col("supervised_tokens") / F.greatest("tokens", F.lit(1)), 6).alias("supervised_share"),
        )
    )
