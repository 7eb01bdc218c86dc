"""Streaming runs over the record stream, read back as tables."""

from __future__ import annotations

import math
import time

from pyspark.sql import functions as F

from tokenloom.operators import order
from tokenloom.operators.packing import record_defaults
from tokenloom.queries.common import BATCH, BLOCK, SEED, digest, select, sql_digest, widen
from tokenloom.queries.noising import NOISE_SQL
from tokenloom.queries.packing import HASH_SHARD, sql_batches
from tokenloom.queries.prepare import ID_SCHEMA, RAW_SQL
from tokenloom.sources import views
from tokenloom.sources.records import stream_records
from tokenloom.sources.workspace import new_folder
from tokenloom.streaming import packing as stream_packing

WAVES = 4
FILES = 4
SHARDS = 3
SCHEMA = "arrival bigint, shard int, id bigint, input_ids array<bigint>, prompt_length int"


def stream_folder(spark, sf_dir, wave_tokens=None) -> str:
    """Token records in shuffled order as JSON lines: wave k holds the k-th range of arrivals.

    Each wave is a job of its own that writes `FILES` files, so the source, which goes by file time and
    takes `FILES` files per trigger, meets the waves in arrival order. There are `WAVES`, or more where these would hold
    more than about `wave_tokens`: micro-batches then keep their size, and their number grows with the input.
    """
    folder = new_folder(spark, "stream")
    rows = order.assign_shards(order.order_epochs(views.tokenized(spark, sf_dir), SEED), SHARDS)
    rows = order.number_shuffled(rows).select(
        (F.col("ordinal") - 1).alias("arrival"), "shard", "id", "input_ids", "prompt_length"
    )
    staged, parts = new_folder(spark, "arrivals"), new_folder(spark, "waves")
    rows.write.parquet(staged)
    arrived = spark.read.parquet(staged)
    last, tokens = arrived.agg(F.max("arrival"), F.sum(F.greatest(F.size("input_ids"), F.lit(0)))).first()
    waves = max(WAVES, math.ceil(tokens / wave_tokens)) if wave_tokens else WAVES
    ranged = arrived.withColumn("part", F.floor(F.col("arrival") * waves / (last + 1)))
    # By wave, so that each wave's job reads its own rows only.
    ranged.repartition(waves * FILES, "part", F.col("arrival") % FILES).write.partitionBy("part").parquet(parts)
    ranged = spark.read.parquet(parts)
    for wave in range(waves):
        files = ranged.where(F.col("part") == wave).drop("part").repartition(FILES, "arrival")
        files.write.json(f"{folder}/{wave:06d}")
    return folder


def _packed_sink(spark, sf_dir, noise_seed=None) -> str:
    source = stream_folder(spark, sf_dir)
    sink = new_folder(spark, "packed")
    stream = stream_records(spark, source, SCHEMA, FILES, glob="*.json")
    query = stream_packing.pack_stream(stream, sink, new_folder(spark, "offsets"), BLOCK, BATCH, noise_seed)
    query.awaitTermination()
    return sink


def scan_jsonl_stream(spark, sf_dir):
    folder, sink = new_folder(spark, "raw"), new_folder(spark, "scanned")
    views.instruction_records(spark, sf_dir).write.json(folder)
    stream = stream_records(spark, folder, ID_SCHEMA, 2, glob="*.json")
    run_stream(stream, sink, new_folder(spark, "offsets")).awaitTermination()
    return spark.read.schema(ID_SCHEMA).parquet(sink)


def run_stream(stream, sink, checkpoint):
    """Append everything available to a Parquet sink and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
    )


def stream_pack(spark, sf_dir):
    blocks = stream_packing.packed_blocks(spark, _packed_sink(spark, sf_dir), BLOCK, BATCH)
    return widen(
        blocks.select(
            "shard", "batch_id", "chunk_id", "num_instruction", digest("input_ids").alias("ids"),
            digest("labels").alias("labels"),
        )
    )


def stream_noise(spark, sf_dir):
    blocks = stream_packing.noised_blocks(spark, _packed_sink(spark, sf_dir, SEED))
    return widen(
        blocks.select("shard", "chunk_id", digest("input_ids").alias("ids"), digest("labels").alias("labels"))
    )


def stream_backpressure(spark, sf_dir):
    """Rows each micro-batch took in when a trigger may take the files of one wave."""
    source, sink = stream_folder(spark, sf_dir), new_folder(spark, "taken")

    def keep(rows, number):
        rows.select("arrival").withColumn("micro", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/m={number}")

    stream = stream_records(spark, source, SCHEMA, FILES, glob="*.json")
    (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", new_folder(spark, "offsets"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    taken = spark.read.schema("arrival bigint, micro int").parquet(sink)
    return taken.groupBy("micro").agg(
        F.count(F.lit(1)).alias("n"), F.min("arrival").alias("first"), F.max("arrival").alias("last")
    ).drop("micro")


def stream_stop(spark, sf_dir):
    """A stream that is stopped after its first micro-batch and resumed: every row once, and by which run.

    The first run waits an hour after a micro-batch, so the stop always finds it between the first two.
    """
    source, sink, offsets = stream_folder(spark, sf_dir), new_folder(spark, "stopped"), new_folder(spark, "offsets")

    def run(before_stop, **trigger):
        def keep(rows, number):
            marked = rows.withColumn("before_stop", F.lit(before_stop))
            marked.write.mode("overwrite").parquet(f"{sink}/micro={number}")

        stream = stream_records(spark, source, SCHEMA, FILES, glob="*.json")
        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", offsets).trigger(**trigger).start()

    first = run(True, processingTime="1 hour")
    while first.isActive and not first.recentProgress:
        time.sleep(0.1)
    first.stop()
    run(False, availableNow=True).awaitTermination()
    return spark.read.schema(f"{SCHEMA}, before_stop boolean").parquet(sink).select("arrival", "id", "before_stop")


def stream_counters(spark, sf_dir):
    """Record and token counters that each micro-batch writes for itself; a repeated one writes the same."""
    source, sink = stream_folder(spark, sf_dir), new_folder(spark, "counted")
    stream = record_defaults(stream_records(spark, source, SCHEMA, FILES, glob="*.json"))
    count_stream(stream, sink, new_folder(spark, "offsets")).awaitTermination()
    return counted(spark, sink)


def count_stream(stream, sink, checkpoint):
    """Count records and tokens of every micro-batch into a table of its own."""

    def count(rows, number):
        sums = rows.agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("input_ids")).alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{sink}/micro={number}")

    return stream.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark, sink):
    sums = spark.read.schema("records bigint, tokens bigint").parquet(sink)
    return sums.agg(F.sum("records").alias("records"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


ARRIVED = f"""{sql_batches(shard=HASH_SHARD.format(SHARDS))}, arrived AS (
  SELECT id, len(input_ids) AS n, row_number() OVER (ORDER BY order_key) - 1 AS arrival, count(*) OVER () AS total FROM ordered)"""

QUERIES = {
    "scan_jsonl_stream": (scan_jsonl_stream, RAW_SQL),
    "stream_pack": (
        stream_pack,
        select(
            ARRIVED,
            f"SELECT shard, batch_id, chunk_id::BIGINT AS chunk_id, num_instruction, {sql_digest('input_ids')} AS ids, "
            f"{sql_digest('labels')} AS labels FROM blocks JOIN counts USING (epoch, shard) "
            f"WHERE chunk_id // {BATCH} = batch_id",
        ),
    ),
    "stream_noise": (
        stream_noise,
        select(
            NOISE_SQL.replace(" 0 AS shard", f" {HASH_SHARD.format(SHARDS)} AS shard")
            + f", sizes AS (SELECT shard, max(e) // {BLOCK * BATCH} AS n_batches FROM placed GROUP BY shard)",
            f"SELECT shard, chunk_id, {sql_digest('ids')} AS ids, {sql_digest('labels')} AS labels "
            f"FROM noised JOIN sizes USING (shard) WHERE chunk_id < n_batches * {BATCH}",
        ),
    ),
    "stream_backpressure": (
        stream_backpressure,
        select(
            ARRIVED,
            f"SELECT count(*) AS n, min(arrival) AS first, max(arrival) AS last FROM arrived GROUP BY arrival * {WAVES} // total",
        ),
    ),
    "stream_stop": (stream_stop, select(ARRIVED, f"SELECT arrival, id, arrival * {WAVES} // total = 0 AS before_stop FROM arrived")),
    "stream_counters": (
        stream_counters,
        select(ARRIVED, "SELECT count(*) AS records, sum(n)::BIGINT AS tokens FROM arrived"),
    ),
}
