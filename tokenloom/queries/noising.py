"""Noising of packed blocks and position predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions import ids
from tokenloom.operators import noising, packing
from tokenloom.queries.common import BLOCK, SEED, digest, select, sql_blocks, sql_digest, widen
from tokenloom.queries.packing import ordered
from tokenloom.sources.records import write_blocks
from tokenloom.sources.workspace import new_folder

KEY = ["epoch", "shard", "chunk_id"]
WORD = "('0x' || substr(md5('{}:' || epoch || ':' || shard || ':' || chunk_id), 1, 8))::BIGINT"


def blocks(spark, sf_dir):
    return packing.pack(ordered(spark, sf_dir), BLOCK, 1).drop("batch_id", "num_instruction")


def noised(spark, sf_dir):
    return noising.noise(blocks(spark, sf_dir), SEED)


def noise_level(spark, sf_dir):
    """Every third block comes with a level of its own."""
    given = F.when(F.col("chunk_id") % 3 == 0, F.lit(0.25))
    out = noising.noise_level(blocks(spark, sf_dir).withColumn("t", given), SEED)
    return widen(out.select(*KEY, F.round("t", 9).alias("t")))


def _drawn(spark, sf_dir):
    return noising.drawn_mask(noising.noise_level(blocks(spark, sf_dir), SEED), SEED)


def _bits(column):
    return F.md5(F.concat_ws(",", F.transform(column, lambda m: m.cast("int").cast("string"))))


def bernoulli_mask(spark, sf_dir):
    return widen(_drawn(spark, sf_dir).select(*KEY, _bits("drawn").alias("mask")))


def force_eos_mask(spark, sf_dir):
    return widen(noising.mask_positions(_drawn(spark, sf_dir)).select(*KEY, _bits("masked").alias("mask")))


def apply_mask(spark, sf_dir):
    out = noising.mask_positions(_drawn(spark, sf_dir))
    return widen(out.select(*KEY, digest(noising.apply_mask(F.col("input_ids"), F.col("masked"))).alias("ids")))


def restore_prompt(spark, sf_dir):
    out = noising.mask_positions(_drawn(spark, sf_dir))
    noisy = noising.apply_mask(F.col("input_ids"), F.col("masked"))
    restored = noising.restore_prompt(noisy, F.col("input_ids"), F.col("labels"))
    return widen(out.select(*KEY, digest(restored).alias("ids")))


def restrict_labels(spark, sf_dir):
    out = noising.mask_positions(_drawn(spark, sf_dir))
    kept = noising.restrict_labels(F.col("labels"), F.col("masked"))
    return widen(out.select(*KEY, digest(kept).alias("labels")))


def noise_blocks(spark, sf_dir):
    return widen(
        noised(spark, sf_dir).select(
            *KEY, digest("input_ids").alias("ids"), digest("labels").alias("labels"), F.round("t", 9).alias("t")
        )
    )


def noise_stats(spark, sf_dir):
    out = noising.noise_stats(noised(spark, sf_dir))
    return widen(out.withColumns({"t": F.round("t", 9), "masked_share": F.round("masked_share", 6)}))


def sink_blocks(spark, sf_dir):
    folder = new_folder(spark, "blocks")
    write_blocks(noised(spark, sf_dir), folder)
    back = spark.read.parquet(folder)
    return widen(back.select(*KEY, digest("input_ids").alias("ids"), digest("labels").alias("labels")))


def eos_positions(spark, sf_dir):
    out = blocks(spark, sf_dir).select(*KEY, ids.eos_positions(F.col("input_ids")).alias("p"))
    return widen(out.select(*KEY, F.size("p").alias("n"), digest("p").alias("positions")))


def masked_positions(spark, sf_dir):
    out = noised(spark, sf_dir).select(*KEY, ids.masked_positions(F.col("input_ids")).alias("p"))
    return widen(out.select(*KEY, F.size("p").alias("n"), digest("p").alias("positions")))


def masked_count(spark, sf_dir):
    return widen(noised(spark, sf_dir).select(*KEY, ids.masked_count(F.col("input_ids")).alias("n")))


def stop_reached(spark, sf_dir):
    return widen(blocks(spark, sf_dir).select(*KEY, ids.stop_reached(F.col("input_ids")).alias("stopped")))


NOISE_SQL = f"""
{sql_blocks()},
leveled AS (
  SELECT *, 0.8::DOUBLE * ({WORD.format(f"t:{SEED}")} / 4294967296.0::DOUBLE) + 0.1::DOUBLE AS t,
    {WORD.format(f"m:{SEED}")} AS h
  FROM blocks),
cells0 AS (
  SELECT epoch, shard, chunk_id, t, unnest(input_ids) AS x, unnest(labels) AS label,
    generate_subscripts(input_ids, 1) - 1 AS i, h
  FROM leveled),
cells1 AS (SELECT *, (h + i * 2654435769) & 4294967295 AS w0 FROM cells0),
cells2 AS (SELECT *, (xor(w0 >> 16, w0) * 73244475) & 4294967295 AS w1 FROM cells1),
cells3 AS (SELECT *, (xor(w1 >> 16, w1) * 73244475) & 4294967295 AS w2 FROM cells2),
cells4 AS (SELECT *, xor(w2 >> 16, w2) / 4294967296.0::DOUBLE < t AS drawn, x IN (126081, 126348) AS ended FROM cells3),
noised AS (
  SELECT epoch, shard::BIGINT AS shard, chunk_id::BIGINT AS chunk_id, any_value(t) AS t,
    list(drawn::INT ORDER BY i) AS drawn, list((drawn OR ended)::INT ORDER BY i) AS masked,
    list(CASE WHEN drawn OR ended THEN 126336 ELSE x END ORDER BY i) AS all_masked,
    list(CASE WHEN (drawn OR ended) AND label <> -100 THEN 126336 ELSE x END ORDER BY i) AS ids,
    list(CASE WHEN drawn OR ended THEN label ELSE -100 END ORDER BY i) AS labels
  FROM cells4 GROUP BY epoch, shard, chunk_id)
"""

K = "epoch, shard, chunk_id"
KC = "epoch, shard::BIGINT AS shard, chunk_id::BIGINT AS chunk_id"


def _noised(body: str) -> str:
    return select(NOISE_SQL, f"SELECT {K}, {body} FROM noised")


QUERIES = {
    "sink_blocks": (sink_blocks, _noised(f"{sql_digest('ids')} AS ids, {sql_digest('labels')} AS labels")),
    "eos_positions": (
        eos_positions,
        select(
            sql_blocks(),
            f"SELECT {KC}, len(p) AS n, {sql_digest('p')} AS positions FROM (SELECT *, list_filter("
            "list_transform(input_ids, lambda x, i: CASE WHEN x IN (126081, 126348) THEN i - 1 END), "
            "lambda x: x IS NOT NULL) AS p FROM blocks)",
        ),
    ),
    "masked_positions": (
        masked_positions,
        select(
            NOISE_SQL,
            f"SELECT {K}, len(p) AS n, {sql_digest('p')} AS positions FROM (SELECT *, list_filter("
            "list_transform(ids, lambda x, i: CASE WHEN x = 126336 THEN i - 1 END), "
            "lambda x: x IS NOT NULL) AS p FROM noised)",
        ),
    ),
    "masked_count": (masked_count, _noised("len(list_filter(ids, lambda x: x = 126336)) AS n")),
    "stop_reached": (
        stop_reached,
        select(sql_blocks(), f"SELECT {KC}, list_has_any(input_ids, [126081, 126348]) AS stopped FROM blocks"),
    ),
    "noise_level": (
        noise_level,
        select(
            NOISE_SQL,
            f"SELECT {K}, round(CASE WHEN chunk_id % 3 = 0 THEN 0.8::DOUBLE * 0.25 + 0.1::DOUBLE ELSE t END, 9) AS t "
            "FROM noised",
        ),
    ),
    "bernoulli_mask": (bernoulli_mask, _noised(f"{sql_digest('drawn')} AS mask")),
    "force_eos_mask": (force_eos_mask, _noised(f"{sql_digest('masked')} AS mask")),
    "apply_mask": (apply_mask, _noised(f"{sql_digest('all_masked')} AS ids")),
    "restore_prompt": (restore_prompt, _noised(f"{sql_digest('ids')} AS ids")),
    "restrict_labels": (restrict_labels, _noised(f"{sql_digest('labels')} AS labels")),
    "noise_blocks": (
        noise_blocks,
        _noised(f"{sql_digest('ids')} AS ids, {sql_digest('labels')} AS labels, round(t, 9) AS t"),
    ),
    "noise_stats": (
        noise_stats,
        _noised(
            "round(t, 9) AS t, len(list_filter(ids, lambda x: x = 126336)) AS masked_tokens, "
            "len(list_filter(labels, lambda x: x <> -100)) AS supervised_tokens, "
            "round(len(list_filter(ids, lambda x: x = 126336)) / len(ids), 6) AS masked_share"
        ),
    ),
}
