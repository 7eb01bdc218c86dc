"""Whole runs: epochs and packing as streams, hand-over, broken lines, the decode loop, the evaluation log."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tokenloom.operators.packing import pack
from tokenloom.plans import decode, evaluation as plan
from tokenloom.queries.common import BATCH, BLOCK, SEED, digest, select, sql_digest, widen
from tokenloom.queries.evaluation import BOS, PADDED, ROWS
from tokenloom.queries.packing import HASH_SHARD, ordered, sql_batches
from tokenloom.queries.prepare import ID_SCHEMA
from tokenloom.queries.streams import ARRIVED, FILES, SCHEMA, SHARDS, stream_folder
from tokenloom.sources import handover, requests, views
from tokenloom.sources.records import split_records, stream_records
from tokenloom.sources.workspace import new_folder
from tokenloom.streaming import epochs, keyed, packing as stream_packing
from tokenloom.streaming.stop import Gate, Marker

FROM_BATCH, PER_FILE = 7, 4
#: Tokens of a micro-batch of the keyed stream, about: what its tasks hold.
WAVE_TOKENS = 1 << 25
LENGTH, SCALE, SHIFT, TAU = 8, 25, 4096, 0.3


def epochs_stream(spark, sf_dir):
    """Two epochs over record files, each in an order of its own, through the shuffle buffer."""
    folder, sink = new_folder(spark, "raw"), new_folder(spark, "epochs")
    views.instruction_records(spark, sf_dir).repartition(6, "id").write.json(folder)
    files = epochs.list_files(spark, folder, glob="*.json")

    def take(records, epoch, micro):
        records.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{sink}/micro={micro}-{epoch}")

    turns = epochs.epoch_files(spark, files.withColumn("weight", F.lit(1)), epochs=2, most=2)
    query = epochs.stream_epochs(turns, take, new_folder(spark, "offsets"), ID_SCHEMA)
    query.processAllAvailable()
    query.stop()
    return widen(spark.read.schema("epoch int, id bigint, instruction string, output string").parquet(sink).select("epoch", "id", "instruction", "output"))


def stream_pack_keyed(spark, sf_dir):
    source, sink = stream_folder(spark, sf_dir, WAVE_TOKENS), new_folder(spark, "keyed")
    stream = stream_records(spark, source, SCHEMA, FILES, glob="*.json")
    keyed.pack_keyed_stream(stream, sink, new_folder(spark, "offsets"), BLOCK, BATCH).awaitTermination()
    return widen(
        spark.read.schema(keyed.BLOCKS).parquet(sink).select(
            "shard", "batch_id", "chunk_id", "num_instruction", digest("input_ids").alias("ids"), digest("labels").alias("labels")
        )
    )


def stream_drain(spark, sf_dir):
    """End rows of a stream that is asked to stop at once, and then resumed to its end."""
    source, sink, offsets = stream_folder(spark, sf_dir), new_folder(spark, "drained"), new_folder(spark, "offsets")
    marker = Marker(spark, f"{new_folder(spark, 'stop')}/marker")

    def run():
        gate, stream = Gate(), stream_records(spark, source, SCHEMA, FILES, glob="*.json")
        query = stream_packing.pack_stream(stream, sink, offsets, BLOCK, BATCH, gate=gate, merge_every=2)
        return stream_packing.stop_packing(spark, query, gate, marker, sink, poll=0.1)

    marker.put()
    run()
    marker.clear()
    return widen(run().select("shard", "examples", "tokens", "input_ended"))


def stream_bytes(spark, sf_dir):
    """Rows taken in by micro-batches that are bounded by bytes, and whether each kept to its bound."""
    source, sink = stream_folder(spark, sf_dir), new_folder(spark, "taken")
    sizes = [r.weight for r in epochs.list_files(spark, source, glob="*.json").collect()]
    most = 2 * max(sizes)

    def keep(rows, number):
        read = rows.select("arrival", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        read.withColumn("micro", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/m={number}")

    stream = stream_records(spark, source, SCHEMA, glob="*.json", bytes_per_trigger=most).select("*", "_metadata")
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", new_folder(spark, "offsets"))
    query.trigger(availableNow=True).start().awaitTermination()
    taken = spark.read.schema("arrival bigint, file string, size bigint, micro int").parquet(sink)
    each = taken.groupBy("micro", "file").agg(F.count("*").alias("n"), F.max("size").alias("size")).groupBy("micro").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    return each.agg(F.sum("n").alias("records"), (F.max("size") <= most).alias("bounded"))


def sink_handover(spark, sf_dir):
    """One rank's blocks from a batch on, found through the manifest."""
    path = new_folder(spark, "handover")
    handover.hand_over(pack(ordered(spark, sf_dir, 2, 3), BLOCK, BATCH, streams=6), path, batches_per_file=PER_FILE)
    got = handover.read_from(spark, path, 1, 2, FROM_BATCH)
    return widen(got.select("epoch", "shard", "batch_id", "chunk_id", digest("input_ids").alias("ids"), digest("labels").alias("labels")))


def scan_broken_lines(spark, sf_dir):
    """Records and broken lines of files in which each line of a seventh id is cut short."""
    folder = new_folder(spark, "lines")
    raw = views.document_records(spark, sf_dir).select("id", "instruction", "output")
    line = F.to_json(F.struct("id", "instruction", "output"))
    cut = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "instruction": "cut'))
    raw.select(F.when(F.col("id") % 7 == 0, cut).otherwise(line).alias("value")).write.text(folder)
    good, broken = split_records(spark, folder, ID_SCHEMA, glob="*.txt")
    kept = good.select("id", F.md5(F.concat("instruction", F.lit("|"), "output")).alias("content"), F.lit(False).alias("broken"))
    faults = broken.select(F.regexp_extract("line", r'"id": (-?\d+)', 1).cast("bigint").alias("id"), F.md5("line").alias("content"), F.lit(True).alias("broken"))
    return kept.unionByName(faults)


def decode_loop(spark, sf_dir):
    """Blocks of eight positions, decoded with scores that stand in the prompt: an embedding per position."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("bigint") + SHIFT)
    rows = views.table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {LENGTH}").alias("seq_id"), F.struct("vec_id", whole.alias("v")).alias("s"))
    told = rows.groupBy("seq_id").agg(F.sort_array(F.collect_list("s")).alias("s")).where(F.size("s") == LENGTH)
    prompts = told.select("seq_id", F.flatten(F.transform("s", lambda s: s["v"])).alias("input_ids"))

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for seq, ids, start in zip(batch["seq_id"], batch["ids"], batch["start"], strict=True):
            logits = (np.asarray(ids[:start], dtype=np.float64).reshape(LENGTH, -1) - SHIFT) / SCALE
            out += [(seq, start + p, row.tolist()) for p, row in enumerate(logits)]
        return pd.DataFrame(out, columns=["seq_id", "pos", "logits"])

    done = decode.decode_blocks(prompts, model, LENGTH, LENGTH, TAU)
    return done.select("seq_id", digest("output_ids").alias("ids"), "calls", "tokens")


def evaluation_log(spark, sf_dir):
    """Per rank what the run log of an evaluation says, as throughput reports take it; seconds differ from run to run."""

    def echo(batch):
        width = batch["input_ids"].str.len().max()
        return batch[["item_id"]].assign(response="", output_ids=[[0] * width] * len(batch))

    asked = requests.request_table(views.answers(spark, sf_dir), context="response")
    _, log = plan.evaluate(asked, echo, ROWS, bos=BOS, world_size=8)
    return widen(log.groupBy("rank").agg(F.count("*").alias("batches"), F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls")))


PARTS = f"{sql_digest('input_ids')} AS ids, {sql_digest('labels')} AS labels"

QUERIES = {
    "epochs_stream": (
        epochs_stream,
        "SELECT epoch, id, instruction, output FROM (SELECT conv_id * 100 + turn AS id, role, text AS output, "
        "lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS instruction FROM conversations), "
        "(SELECT range AS epoch FROM range(2)) WHERE role = 'assistant'",
    ),
    "stream_pack_keyed": (
        stream_pack_keyed,
        select(
            ARRIVED,
            f"SELECT shard, batch_id, chunk_id::BIGINT AS chunk_id, num_instruction, {PARTS} "
            f"FROM blocks JOIN counts USING (epoch, shard) WHERE chunk_id // {BATCH} = batch_id",
        ),
    ),
    "stream_drain": (
        stream_drain,
        select(
            ARRIVED,
            f"SELECT {HASH_SHARD.format(SHARDS)} AS shard, count(*) AS examples, sum(n)::BIGINT AS tokens, true AS input_ended "
            "FROM ordered GROUP BY ALL",
        ),
    ),
    "stream_bytes": (stream_bytes, select(ARRIVED, "SELECT count(*) AS records, true AS bounded FROM arrived")),
    "sink_handover": (
        sink_handover,
        select(
            sql_batches(epochs=2, shard=HASH_SHARD.format(3)),
            f"SELECT epoch, shard, batch_id, chunk_id::BIGINT AS chunk_id, {PARTS} FROM blocks JOIN counts USING (epoch, shard) "
            f"WHERE chunk_id // {BATCH} = batch_id AND epoch = 1 AND shard = 2 AND batch_id >= {FROM_BATCH}",
        ),
    ),
    "scan_broken_lines": (
        scan_broken_lines,
        """
SELECT doc_id AS id, doc_id % 7 = 0 AS broken, CASE WHEN doc_id % 7 = 0 THEN md5('{"id": ' || doc_id || ', "instruction": "cut')
  ELSE md5(split_part(text, chr(10), 1) || '|' || substr(text, length(split_part(text, chr(10), 1)) + 2)) END AS content
FROM documents""",
    ),
    "decode_loop": (
        decode_loop,
        f"""
WITH v AS (
  SELECT vec_id, vec_id // {LENGTH} AS seq_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::BIGINT / {SCALE}::DOUBLE) AS l FROM embeddings),
c AS (
  SELECT *, list_position(l, list_max(l)) - 1 AS token, 1 / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS conf FROM v),
g AS (
  SELECT seq_id, list(token ORDER BY vec_id) AS ids, count(*) FILTER (conf > {TAU}) AS high FROM c GROUP BY seq_id HAVING count(*) = {LENGTH})
SELECT seq_id, {sql_digest('ids')} AS ids, {LENGTH} - greatest(high, 1) AS calls, {LENGTH}::BIGINT AS tokens FROM g""",
    ),
    "evaluation_log": (
        evaluation_log,
        select(
            PADDED,
            "SELECT batch_id % 8 AS rank, count(DISTINCT batch_id) AS batches, sum(width)::BIGINT AS tokens, "
            "count(DISTINCT batch_id) AS calls FROM filled GROUP BY 1",
        ),
    ),
}
