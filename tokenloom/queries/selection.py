"""Score selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.operators import metrics, select as picks
from tokenloom.queries.common import SEED, digest, select, sql_digest, widen
from tokenloom.sources import views

TAU = 0.9
LOW_TAU = 0.3
TOP = 2
STEPS = 7
BLOCK = 8


def scored(spark, sf_dir):
    return picks.confidence(views.scores(spark, sf_dir))


def softmax_confidence(spark, sf_dir):
    return widen(scored(spark, sf_dir).select("seq_id", "pos", "token", F.round("conf", 6).alias("conf")))


def threshold_or_top1(spark, sf_dir):
    return widen(picks.pick_threshold(scored(spark, sf_dir), TAU))


def threshold_union_edit(spark, sf_dir):
    return widen(picks.pick_threshold(scored(spark, sf_dir), TAU, edit=True))


def high_conf_or_topk(spark, sf_dir):
    return widen(picks.pick_high_or_topk(scored(spark, sf_dir), TAU, TOP))


def even_quota(spark, sf_dir):
    groups = (
        views.run_log(spark, sf_dir)
        .groupBy(F.col("batch_id").alias("seq_id"))
        .agg(F.sum("tokens").alias("n"))
    )
    return widen(picks.even_quota(groups, STEPS))


def frontier(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("before", (F.col("seq_id") % 10).cast("int"))
    return widen(picks.frontier(rows, LOW_TAU, BLOCK, "before"))


def stability(spark, sf_dir):
    out = picks.stability(views.frontier_trace(spark, sf_dir), 2, 1.0, 24, steps_per_bucket=64)
    return widen(out)


def weighted_sample(spark, sf_dir):
    rows = views.scores(spark, sf_dir)
    warm = picks.weighted_sample(rows, 0.7, SEED).withColumn("temperature", F.lit(0.7))
    cold = picks.weighted_sample(rows, 0, SEED).withColumn("temperature", F.lit(0.0))
    return widen(warm.unionByName(cold))


def apply_updates(spark, sf_dir):
    """Masked sequences (126336) filled with the threshold picks."""
    rows = scored(spark, sf_dir)
    cell = F.when(F.col("filled"), F.lit(7)).otherwise(F.lit(126336)).cast("bigint")
    sequences = rows.groupBy("seq_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", cell.alias("id")))), lambda s: s["id"]).alias("ids")
    )
    out = picks.apply_updates(sequences, picks.pick_threshold(rows, TAU))
    return out.select("seq_id", F.size("ids").cast("bigint").alias("n"), digest("ids").alias("ids"))


def masked_mean_nll(spark, sf_dir):
    out = metrics.masked_nll(views.scores(spark, sf_dir))
    return out.select("positions", F.round("mean_nll", 6).alias("mean_nll"))


SCORES = """
scores AS (
  SELECT vec_id // 8 AS seq_id, vec_id % 8 AS pos, list_transform(embedding, lambda x: x::DOUBLE * 40) AS logits,
    CASE WHEN vec_id % 3 = 0 THEN -100 ELSE label END AS label, vec_id % 4 = 0 AS filled FROM embeddings),
scored AS (
  SELECT *, (list_position(logits, list_max(logits)) - 1)::BIGINT AS token,
    1 / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))) AS conf FROM scores)
"""
OPEN = f"""{SCORES},
open_rows AS (
  SELECT *, max(conf) OVER (PARTITION BY seq_id) AS best, count(*) FILTER (WHERE conf >= {TAU}) OVER (PARTITION BY seq_id) AS high,
    row_number() OVER (PARTITION BY seq_id ORDER BY conf DESC, pos) AS rn FROM scored WHERE NOT filled),
picked AS (SELECT seq_id, pos, token FROM open_rows WHERE conf > {TAU} OR (best <= {TAU} AND rn = 1))
"""

QUERIES = {
    "softmax_confidence": (
        softmax_confidence, select(SCORES, "SELECT seq_id, pos, token, round(conf, 6) AS conf FROM scored")
    ),
    "threshold_or_top1": (threshold_or_top1, select(OPEN, "SELECT seq_id, pos, token FROM picked")),
    "threshold_union_edit": (
        threshold_union_edit,
        select(
            OPEN,
            "SELECT seq_id, pos, token FROM picked UNION ALL "
            "SELECT seq_id, pos, token FROM scored WHERE filled AND conf > 0",
        ),
    ),
    "high_conf_or_topk": (
        high_conf_or_topk,
        select(
            OPEN,
            f"SELECT seq_id, pos, token FROM open_rows WHERE CASE WHEN high > 1 THEN conf >= {TAU} ELSE rn <= {TOP} END",
        ),
    ),
    "even_quota": (
        even_quota,
        f"""
SELECT seq_id, step, n // {STEPS} + CASE WHEN step < n % {STEPS} THEN 1 ELSE 0 END AS quota FROM (
  SELECT event_id // 16 AS seq_id, sum(floor(value)::BIGINT + 1)::BIGINT AS n FROM events GROUP BY 1),
  (SELECT unnest(range({STEPS})) AS step)""",
    ),
    "frontier": (
        frontier,
        select(
            SCORES,
            f"""
SELECT seq_id, least(greatest(CASE WHEN b >= {BLOCK} THEN b ELSE coalesce(far, b) + 1 END, 1), {BLOCK}) AS frontier FROM (
  SELECT seq_id, seq_id % 10 AS b, max(CASE WHEN NOT filled AND conf >= {LOW_TAU} AND pos >= seq_id % 10 THEN pos END) AS far
  FROM scored GROUP BY seq_id)""",
        ),
    ),
    "stability": (
        stability,
        """
SELECT seq_id, step, coalesce(n >= 2 AND abs(f - prev) / 2.0 < 1.0, false) AS stable,
  least(greatest(CASE WHEN n >= 2 AND abs(f - prev) / 2.0 < 1.0 THEN f
    WHEN n >= 2 THEN (f + prev) // 2 ELSE f END, 1), 24) AS length
FROM (
  SELECT user_id AS seq_id, event_id AS step, 1 + event_id % 32 AS f,
    lag(1 + event_id % 32) OVER (PARTITION BY user_id ORDER BY event_id) AS prev,
    least(row_number() OVER (PARTITION BY user_id ORDER BY event_id), 2) AS n
  FROM events)""",
    ),
    "weighted_sample": (
        weighted_sample,
        select(
            f"""{SCORES},
w0 AS (
  SELECT seq_id, pos, unnest(logits) AS x, generate_subscripts(logits, 1) - 1 AS i,
    ('0x' || substr(md5('g:{SEED}:' || seq_id || ':' || pos), 1, 8))::BIGINT AS h FROM scores),
w1 AS (SELECT *, (h + i * 2654435769) & 4294967295 AS a FROM w0),
w2 AS (SELECT *, (xor(a >> 16, a) * 73244475) & 4294967295 AS b FROM w1),
w3 AS (SELECT *, (xor(b >> 16, b) * 73244475) & 4294967295 AS c FROM w2),
w4 AS (SELECT seq_id, pos, i, x - 0.7::DOUBLE * ln(-ln((xor(c >> 16, c) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) AS r FROM w3)""",
            "SELECT seq_id, pos, arg_max(i, r) AS token, 0.7::DOUBLE AS temperature FROM w4 GROUP BY ALL "
            "UNION ALL SELECT seq_id, pos, token, 0.0::DOUBLE FROM scored",
        ),
    ),
    "apply_updates": (
        apply_updates,
        select(
            OPEN,
            f"""
SELECT seq_id, count(*) AS n, {sql_digest("list(CASE WHEN p.token IS NOT NULL THEN p.token WHEN filled THEN 7 ELSE 126336 END ORDER BY pos)")} AS ids
FROM scored LEFT JOIN (SELECT seq_id, pos, token FROM picked) p USING (seq_id, pos) GROUP BY seq_id""",
        ),
    ),
    "masked_mean_nll": (
        masked_mean_nll,
        select(
            SCORES,
            "SELECT count(*) AS positions, round(avg(ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) "
            "+ list_max(logits) - logits[label + 1]), 6) AS mean_nll FROM scores WHERE label <> -100",
        ),
    ),
}
