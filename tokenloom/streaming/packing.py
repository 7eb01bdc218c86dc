"""Packing of an endless record stream, micro-batch by micro-batch.

Each micro-batch is packed with the distributed batch operators, so one shard may fill any number of
tasks. Between micro-batches only the unfinished batch of every shard (fewer tokens than one batch)
and its counters are carried, as two small tables per micro-batch in the sink folder. A micro-batch
reads only the tables of the one before it and overwrites its own, so repeating it after a failure or
restart gives the same result. Every `merge_every` micro-batches the finished ones are merged into one folder,
so that folders and files grow with the data, not with the number of triggers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenloom.constants import BATCH_SIZE, MAX_LENGTH
from tokenloom.operators.noising import noise
from tokenloom.operators.packing import blocks_of, gather, pieces_of, record_defaults, with_token_count
from tokenloom.operators.prefix import running_totals
from tokenloom.sources.workspace import discard, stage
from tokenloom.streaming.stop import Gate, Marker, end_rows, run_until, write_end

SHARD = ["shard"]
ARRIVALS_PER_BUCKET = 4096
BATCHES = (
    "shard int, batch_id bigint, n_tokens bigint, done bigint, done_before bigint, "
    "parts array<struct<low: bigint, ids: array<bigint>, labels: array<bigint>>>"
)
NOISED = (
    "shard int, batch_id bigint, chunk_id bigint, num_instruction bigint, input_ids array<bigint>, "
    "labels array<bigint>, epoch int, t double"
)
COUNTERS = "shard int, examples bigint, tokens bigint"


def _folder(sink: str, table: str, number: int) -> str:
    return f"{sink}/{table}/micro={number}"


def _carried_pieces(spark: SparkSession, sink: str, number: int) -> DataFrame:
    """The pieces of every shard's unfinished batch."""
    unfinished = (
        spark.read.schema(f"{BATCHES}, complete boolean")
        .parquet(_folder(sink, "batches", number))
        .where("not complete")
    )
    return unfinished.select(
        "shard", "batch_id", "done", "done_before", F.explode_outer("parts").alias("part")
    ).select(
        "shard",
        "batch_id",
        F.col("part.low").alias("low"),
        F.coalesce(F.when(F.col("part").isNotNull(), F.size("part.ids")), F.lit(0)).cast("bigint").alias("n"),
        "done",
        "done_before",
        F.col("part.ids").alias("ids"),
        F.col("part.labels").alias("labels"),
    )


def _pack_batch(rows: DataFrame, number: int, sink: str, max_length: int, batch_size: int, seed: int | None) -> None:
    # The input is parsed once; bucket totals and counters then read two narrow columns of the copy.
    staged = stage(with_token_count(record_defaults(rows)), "micro")
    try:
        _pack_staged(staged, number, sink, max_length, batch_size, seed)
    finally:
        discard(staged)


def _pack_staged(staged: DataFrame, number: int, sink: str, max_length: int, batch_size: int, seed: int | None) -> None:
    spark, span = staged.sparkSession, max_length * batch_size
    keyed = staged.withColumn("arrival_bucket", F.expr(f"arrival div {ARRIVALS_PER_BUCKET}"))
    counters = keyed.groupBy("shard").agg(
        F.count(F.lit(1)).alias("examples"), F.sum("n_tokens").alias("tokens")
    )
    offsets = running_totals(
        keyed,
        SHARD,
        ["arrival_bucket"],
        ["arrival"],
        {"ordinal": F.lit(1).cast("bigint"), "end": F.col("n_tokens")},
    ).select("shard", "input_ids", "prompt_length", "n_tokens", "ordinal", "end")
    if number > 0:
        before = spark.read.schema(COUNTERS).parquet(_folder(sink, "counters", number - 1))
        counters = (
            counters.unionByName(before)
            .groupBy("shard")
            .agg(F.sum("examples").alias("examples"), F.sum("tokens").alias("tokens"))
        )
        # One row per shard, read from files of known size: Spark broadcasts it while it is small.
        offsets = (
            offsets.join(before, "shard", "left")
            .withColumns(
                {
                    "ordinal": F.col("ordinal") + F.coalesce("examples", F.lit(0)),
                    "end": F.col("end") + F.coalesce("tokens", F.lit(0)),
                }
            )
            .drop("examples", "tokens")
        )
    pieces = pieces_of(offsets.withColumn("start", F.col("end") - F.col("n_tokens")), SHARD, span)
    if number > 0:
        pieces = pieces.unionByName(_carried_pieces(spark, sink, number - 1))
    batches = gather(pieces, SHARD).withColumn("complete", F.col("n_tokens") == span)
    batches.write.mode("overwrite").partitionBy("complete").parquet(_folder(sink, "batches", number))
    if seed is not None:
        done = spark.read.schema(f"{BATCHES}, complete boolean").parquet(_folder(sink, "batches", number)).where("complete")
        blocks = blocks_of(done.drop("complete"), SHARD, max_length, batch_size).withColumn("epoch", F.lit(0))
        noise(blocks, seed).write.mode("overwrite").parquet(_folder(sink, "noised", number))
    counters.write.mode("overwrite").parquet(_folder(sink, "counters", number))


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, name: str, committed: bool = False) -> list[int]:
    """Numbers of the folders `name=N` below `path`; with `committed`, of those that were written to the end."""
    place, files = _files(spark, path)
    if not files.exists(place):
        return []
    found = [str(s.getPath().getName()) for s in files.listStatus(place)]
    numbers = [int(f.split("=")[1]) for f in found if f.startswith(f"{name}=")]
    done = lambda n: files.exists(_files(spark, f"{path}/{name}={n}/_SUCCESS")[0])
    return sorted(n for n in numbers if not committed or done(n))


def merge_micro(spark: SparkSession, sink: str) -> int:
    """Merge the complete batches (and noised blocks) of all finished micro-batches into one folder `merged/until=N`, and
    remove their own folders but for those of N, which the next micro-batch reads. Returns N, or -1.

    Merged folders are written once and never rewritten. Until the new one is written to the end, readers use the old
    folders; afterwards they ignore what is left of these, so a merge that dies in between does no harm.
    """
    finished = _numbers(spark, f"{sink}/counters", "micro", committed=True)
    before = max(_numbers(spark, f"{sink}/merged", "until", committed=True), default=-1)
    last = max(finished, default=-1)
    if last <= before:
        return before
    noised = bool(_numbers(spark, f"{sink}/noised", "micro"))
    new = [n for n in finished if n > before]
    done = _read_batches(spark, sink, new)
    if noised:
        _read_noised(spark, sink, new).coalesce(_width(spark)).write.mode("overwrite").parquet(f"{sink}/merged-noised/until={last}")
    done.coalesce(_width(spark)).write.mode("overwrite").parquet(f"{sink}/merged/until={last}")
    for table in ("batches", "noised", "counters"):
        for number in _numbers(spark, f"{sink}/{table}", "micro"):
            if number < last:
                place, files = _files(spark, _folder(sink, table, number))
                files.delete(place, True)
    return last


def _width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _read_batches(spark: SparkSession, sink: str, numbers: list[int]) -> DataFrame:
    folders = [_folder(sink, "batches", n) for n in numbers]
    if not folders:
        return spark.createDataFrame([], BATCHES)
    rows = spark.read.schema(f"{BATCHES}, micro int, complete boolean").option("basePath", f"{sink}/batches").parquet(*folders)
    return rows.where("complete").drop("micro", "complete")


def _read_noised(spark: SparkSession, sink: str, numbers: list[int]) -> DataFrame:
    folders = [_folder(sink, "noised", n) for n in numbers]
    return spark.read.schema(NOISED).parquet(*folders) if folders else spark.createDataFrame([], NOISED)


def pack_stream(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    max_length: int = MAX_LENGTH,
    batch_size: int = BATCH_SIZE,
    noise_seed: int | None = None,
    trigger: dict | None = None,
    merge_every: int = 64,
    gate: Gate | None = None,
) -> StreamingQuery:
    """Start packing `arrival, shard, input_ids, prompt_length` into `sink`.

    `arrival` is a unique whole number that orders the records; files must arrive in its order. With a
    `noise_seed` every micro-batch also writes its complete blocks noised. `trigger` is that of the stream writer,
    for example {"processingTime": "1 minute"}; by default the query takes in all that is there and ends. A `gate` lets
    `stop_packing` end it between micro-batches.
    """

    def work(rows: DataFrame, number: int) -> None:
        _pack_batch(rows, number, sink, max_length, batch_size, noise_seed)
        if (number + 1) % merge_every == 0:
            merge_micro(rows.sparkSession, sink)

    return (
        stream.writeStream.foreachBatch(gate.through(work) if gate else work)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def packed_blocks(
    spark: SparkSession, sink: str, max_length: int = MAX_LENGTH, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Complete blocks of all finished micro-batches."""
    merged, new = _parts(spark, sink)
    rows = _read_batches(spark, sink, new)
    if merged:
        rows = rows.unionByName(spark.read.schema(BATCHES).parquet(*[f"{sink}/merged/until={n}" for n in merged]))
    return blocks_of(rows, SHARD, max_length, batch_size).withColumn("epoch", F.lit(0))


def _parts(spark: SparkSession, sink: str) -> tuple[list[int], list[int]]:
    """Merged folders, and the finished micro-batches after them."""
    merged = _numbers(spark, f"{sink}/merged", "until", committed=True)
    after = max(merged, default=-1)
    return merged, [n for n in _numbers(spark, f"{sink}/counters", "micro", committed=True) if n > after]


def noised_blocks(spark: SparkSession, sink: str) -> DataFrame:
    """The noised blocks that the finished micro-batches of a stream with a `noise_seed` have written."""
    merged, new = _parts(spark, sink)
    rows = _read_noised(spark, sink, new)
    return rows.unionByName(spark.read.schema(NOISED).parquet(*[f"{sink}/merged-noised/until={n}" for n in merged])) if merged else rows


def counters(spark: SparkSession, sink: str) -> DataFrame:
    """`shard, examples, tokens` after the last finished micro-batch."""
    last = max(_numbers(spark, f"{sink}/counters", "micro", committed=True), default=None)
    return spark.createDataFrame([], COUNTERS) if last is None else spark.read.schema(COUNTERS).parquet(_folder(sink, "counters", last))


def stop_packing(spark: SparkSession, query: StreamingQuery, gate: Gate, marker: Marker, sink: str, poll: float = 1.0, seconds: float | None = None) -> DataFrame | None:
    """Run until the marker is put (or the input ends, or `seconds` are over), finish the micro-batch at work, and leave
    an end row for every shard: `shard, examples, tokens, micro, input_ended`. None if no micro-batch was finished."""
    drained = run_until(query, gate, marker, poll, seconds)
    last = max(_numbers(spark, f"{sink}/counters", "micro", committed=True), default=None)
    if last is None:
        return None
    write_end(counters(spark, sink), sink, last, not drained)
    return end_rows(spark, sink, last)


def ended(spark: SparkSession, sink: str) -> DataFrame | None:
    """The end rows, if the stream has stopped and not gone on since."""
    last = max(_numbers(spark, f"{sink}/counters", "micro", committed=True), default=None)
    return None if last is None else end_rows(spark, sink, last)
