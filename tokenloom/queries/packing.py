"""Shuffles, shards, packing and its counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.operators import metrics, order, packing
from tokenloom.queries.common import BATCH, BLOCK, SEED, digest, select, sql_blocks, sql_digest, sql_streams, widen
from tokenloom.sources import views

SPAN = BLOCK * BATCH
HASH_SHARD = "('0x' || substr(order_key, 17, 8))::BIGINT % {}"


def ordered(spark, sf_dir, epochs=1, world_size=1, exact=False):
    rows = order.order_epochs(packing.record_defaults(views.tokenized(spark, sf_dir)), SEED, epochs)
    return order.assign_shards(packing.with_token_count(rows), world_size, epochs, exact)


def file_shuffle(spark, sf_dir):
    """Record groups (one per language and source, as files would be) in a seeded order."""
    groups = views.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("records"))
    named = groups.withColumn("file", F.concat_ws("/", "lang", "source"))
    keyed = order.order_epochs(named, SEED, row_id="file")
    return widen(order.number_shuffled(keyed).select("file", "records", "ordinal"))


def epoch_shuffle(spark, sf_dir):
    rows = order.number_shuffled(ordered(spark, sf_dir).drop("input_ids"))
    return rows.select("id", "order_key", "ordinal").orderBy("order_key")


def epochs(spark, sf_dir):
    rows = order.number_shuffled(ordered(spark, sf_dir, 3).drop("input_ids"), 3)
    return widen(rows.select("epoch", "id", "order_key", "ordinal"))


def shard_assign(spark, sf_dir):
    rows = ordered(spark, sf_dir, 2, 4, exact=True).withColumnRenamed("shard", "dealt")
    both = order.assign_shards(rows, 4, 2).withColumnRenamed("shard", "hashed")
    return widen(both.select("epoch", "id", "dealt", "hashed"))


def pack_offsets(spark, sf_dir):
    return widen(packing.pack_offsets(ordered(spark, sf_dir)).select("id", "ordinal", "start", "end"))


def pack_blocks(spark, sf_dir):
    blocks = packing.pack(ordered(spark, sf_dir), BLOCK, 1)
    return widen(
        blocks.select(
            "epoch", "shard", "chunk_id", F.size("input_ids").alias("n"), digest("input_ids").alias("ids"),
            digest("labels").alias("labels"),
        )
    )


def pack_batches(spark, sf_dir):
    blocks = packing.pack(ordered(spark, sf_dir, 2, 3), BLOCK, BATCH, streams=6)
    return widen(
        blocks.select(
            "epoch", "shard", "batch_id", "chunk_id", "num_instruction", digest("input_ids").alias("ids"),
            digest("labels").alias("labels"),
        )
    )


def instructions_per_batch(spark, sf_dir):
    return widen(packing.batch_counts(ordered(spark, sf_dir), BLOCK, BATCH))


def packing_stats(spark, sf_dir):
    return widen(packing.packing_stats(ordered(spark, sf_dir, 2, 3), BLOCK, BATCH, streams=6))


def training_progress(spark, sf_dir):
    counts = packing.batch_counts(ordered(spark, sf_dir, 2, 2), BLOCK, BATCH, streams=4)
    out = metrics.progress(counts, SPAN, log_every=2, accumulation=2, world_size=2)
    return widen(out.withColumn("total_tokens", F.round("total_tokens", 9)))


def sql_counts(**kwargs):
    return f"""
{sql_streams(**kwargs)},
sizes AS (SELECT epoch, shard, max(e) // {SPAN} AS n_batches FROM placed GROUP BY ALL),
slots AS (SELECT epoch, shard, unnest(range(n_batches::BIGINT)) AS batch_id FROM sizes),
completed AS (
  SELECT slots.epoch, slots.shard, batch_id, ordinal AS done FROM slots JOIN placed p
  ON p.epoch = slots.epoch AND p.shard = slots.shard
    AND p.s < (batch_id + 1) * {SPAN} AND p.e >= (batch_id + 1) * {SPAN}),
counts AS (
  SELECT epoch, shard, batch_id,
    done - coalesce(lag(done) OVER (PARTITION BY epoch, shard ORDER BY batch_id), 0) AS num_instruction
  FROM completed)
"""


def sql_batches(**kwargs):
    counts = sql_counts(**kwargs)
    blocks = sql_blocks(**kwargs)[len(sql_streams(**kwargs)) + 1 :]
    return counts + blocks


QUERIES = {
    "file_shuffle": (
        file_shuffle,
        f"SELECT file, records, row_number() OVER (ORDER BY md5('{SEED}:' || file)) AS ordinal "
        "FROM (SELECT lang || '/' || source AS file, count(*) AS records FROM documents GROUP BY ALL)",
    ),
    "epoch_shuffle": (epoch_shuffle, select(sql_streams(), "SELECT id, order_key, ordinal FROM placed")),
    "epochs": (epochs, select(sql_streams(epochs=3), "SELECT epoch, id, order_key, ordinal FROM placed")),
    "shard_assign": (
        shard_assign,
        select(
            sql_streams(epochs=2),
            "SELECT epoch, id, (row_number() OVER (PARTITION BY epoch ORDER BY order_key) - 1) % 4 AS dealt, "
            f"{HASH_SHARD.format(4)} AS hashed FROM ordered",
        ),
    ),
    "pack_offsets": (
        pack_offsets,
        select(sql_streams(), 'SELECT id, ordinal, s::BIGINT AS start, e::BIGINT AS "end" FROM placed'),
    ),
    "pack_blocks": (
        pack_blocks,
        select(
            sql_blocks(),
            f"SELECT epoch, shard::BIGINT AS shard, chunk_id::BIGINT AS chunk_id, len(input_ids) AS n, "
            f"{sql_digest('input_ids')} AS ids, {sql_digest('labels')} AS labels FROM blocks",
        ),
    ),
    "pack_batches": (
        pack_batches,
        select(
            sql_batches(epochs=2, shard=HASH_SHARD.format(3)),
            f"SELECT epoch, shard, batch_id, chunk_id::BIGINT AS chunk_id, num_instruction, "
            f"{sql_digest('input_ids')} AS ids, {sql_digest('labels')} AS labels "
            f"FROM blocks JOIN counts USING (epoch, shard) WHERE chunk_id // {BATCH} = batch_id",
        ),
    ),
    "instructions_per_batch": (
        instructions_per_batch,
        select(
            sql_counts(), "SELECT epoch, shard::BIGINT AS shard, batch_id::BIGINT AS batch_id, num_instruction FROM counts"
        ),
    ),
    "packing_stats": (
        packing_stats,
        select(
            sql_streams(epochs=2, shard=HASH_SHARD.format(3)),
            f"""
SELECT epoch, shard, count(*) AS examples, sum(n)::BIGINT AS tokens, (sum(n) // {BLOCK})::BIGINT AS blocks,
  (sum(n) // {SPAN})::BIGINT AS batches, (sum(n) % {BLOCK})::BIGINT AS tail_tokens,
  count(*) FILTER (WHERE n > 0 AND s // {BLOCK} < (e - 1) // {BLOCK}) AS straddling,
  sum(greatest(n - prompt_length, 0))::BIGINT AS supervised_tokens,
  round(sum(greatest(n - prompt_length, 0)) / greatest(sum(n), 1), 6) AS supervised_share
FROM placed GROUP BY epoch, shard""",
        ),
    ),
    "training_progress": (
        training_progress,
        select(
            sql_counts(epochs=2, shard=HASH_SHARD.format(2)),
            f"""
SELECT epoch, shard, batch_id, step, num_instruction, total_tokens FROM (
  SELECT epoch, shard, batch_id::BIGINT AS batch_id, (m - 1) // 2 AS step,
    (2 * sum(num_instruction) OVER w)::BIGINT AS num_instruction,
    round(m * {SPAN} * 2 / 1e9, 9) AS total_tokens
  FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY epoch, batch_id) AS m FROM counts)
  WINDOW w AS (PARTITION BY shard ORDER BY m))
WHERE (step + 1) % 4 = 0""",
        ),
    ),
}
