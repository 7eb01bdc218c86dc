"""Selection rules over tables of position scores.

Groups may be of any size: group facts are aggregated before they are shuffled, and rows of one
group are spread over salts when they meet those facts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tokenloom.constants import SEED
from tokenloom.functions.draws import SCALE, final_word, hash32, position_words
from tokenloom.operators.prefix import number_rows

SALTS = 16
RANGES = 4096
POSITIONS = 1 << 16


def confidence(scores: DataFrame) -> DataFrame:
    """Add `token` (zero-based argmax of `logits`, first on ties; NaN is the largest) and `conf` (its softmax share)."""
    topped = scores.withColumn("_top", F.array_max("logits"))
    shifted = topped.withColumn("_shifted", F.zip_with(
        "logits", F.array_repeat(F.col("_top"), F.size("logits")), lambda x, top: x - top
    ))
    return shifted.select(
        *scores.columns,
        (F.array_position("logits", F.col("_top")) - 1).alias("token"),
        (F.lit(1.0) / F.aggregate("_shifted", F.lit(0.0), lambda a, x: a + F.exp(x))).alias("conf"),
    )


def _salted(facts: DataFrame) -> DataFrame:
    return facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt():
    return F.pmod(F.col("pos"), F.lit(SALTS)).cast("int").alias("_salt")


def pick_threshold(scored: DataFrame, tau: float = 0.9, edit: bool = False) -> DataFrame:
    """Open positions above `tau`; in a group without one, its single best open position.

    With `edit`, positions already filled are picked again when their confidence is above 0.
    The fallback is an aggregate over the group, so no group is gathered in one task.
    """
    columns = ["seq_id", "pos", "token"]
    still_open = scored.where(~F.col("filled"))
    best = (
        still_open.groupBy("seq_id")
        .agg(F.max(F.struct("conf", (-F.col("pos")).alias("back"), "token")).alias("b"))
        .where(F.col("b.conf") <= tau)
        .select("seq_id", (-F.col("b.back")).alias("pos"), F.col("b.token").alias("token"))
    )
    picks = still_open.where(F.col("conf") > tau).select(columns).unionByName(best)
    if edit:
        picks = picks.unionByName(scored.where(F.col("filled") & (F.col("conf") > 0)).select(columns))
    return picks


def pick_high_or_topk(
    scored: DataFrame, tau: float = 0.9, k: int | str = 1, previous: str | None = None
) -> DataFrame:
    """All open positions with confidence of at least `tau` when a group has several, else its top k.

    `k` is a number or names a column constant per group (a quota of `even_quota`, say; null counts as 0).
    With `previous`, a column constant per group, only positions from that length on are looked at. A small
    number k limits ranks before the exchange; a large or varying one numbers rows in ranges of confidence, and of
    positions where all confidences of a range are equal, so no group is ranked in one task.
    """
    columns = ["seq_id", "pos", "token"]
    open_rows = scored.where(~F.col("filled"))
    if previous:
        open_rows = open_rows.where(F.col("pos") >= F.coalesce(F.col(previous), F.lit(0)))
    quota = F.coalesce(F.col(k), F.lit(0)) if isinstance(k, str) else F.lit(k)
    still_open = open_rows.select(*columns, "conf", quota.cast("bigint").alias("_k"))
    many = (
        still_open.groupBy("seq_id")
        .agg(F.count_if(F.col("conf") >= tau).alias("n_high"))
        .where(F.col("n_high") > 1)
        .select("seq_id")
    )
    high = (
        still_open.where(F.col("conf") >= tau)
        .select("*", _salt())
        .join(_salted(many), ["seq_id", "_salt"], "left_semi")
    )
    limit = int(scored.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if not isinstance(k, str) and k <= limit:
        # Spark applies such a rank limit in each map task, so at most k rows per group and task move.
        rank = F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("conf"), "pos"))
        top = still_open.withColumn("_rank", rank).where(F.col("_rank") <= k).join(many, "seq_id", "left_anti")
        return high.select(columns).unionByName(top.select(columns))
    # Falling ranges of confidence; nothing is above 1, and NaN sorts above all numbers.
    falling = F.when(F.isnan("conf"), -1).otherwise(F.floor((F.lit(1.0) - F.col("conf")) * RANGES))
    rows = still_open.withColumn("_range", F.coalesce(falling, F.lit(RANGES + 1)).cast("bigint"))
    # A range whose confidences are all the same is cut by position too, so saturated groups are not ranked in one task.
    whole = rows.groupBy("seq_id", "_range").agg((F.min("conf").eqNullSafe(F.max("conf"))).alias("_even"))
    met = rows.select("*", _salt()).join(_salted(whole), ["seq_id", "_range", "_salt"]).drop("_salt")
    placed = met.withColumn("_place", F.when(F.col("_even"), F.floor(F.col("pos") / POSITIONS)).otherwise(0).cast("bigint")).drop("_even")
    ranked = number_rows(placed, ["seq_id"], ["_range", "_place"], [F.desc("conf"), "pos"], "_rank")
    top = ranked.where(F.col("_rank") <= F.col("_k")).join(many, "seq_id", "left_anti")
    return high.select(columns).unionByName(top.select(columns))


def even_quota(groups: DataFrame, steps: int) -> DataFrame:
    """Split each group's `n` over `steps`; the first `n % steps` steps get one more."""
    return groups.select("seq_id", "n", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).select(
        "seq_id", "step", F.expr(f"n div {steps} + if(step < n % {steps}, 1, 0)").alias("quota")
    )


def frontier(scored: DataFrame, tau: float = 0.3, block_length: int = 128, previous: str | None = None) -> DataFrame:
    """`seq_id, frontier`: how far the confident open positions reach, from the previous length on.

    One past the farthest open position with confidence of at least `tau`; one past the previous
    length when there is none; clamped to 1..block_length. `previous` names a column constant per group.
    """
    before = F.col(previous) if previous else F.lit(0)
    hit = ~F.col("filled") & (F.col("conf") >= tau) & (F.col("pos") >= before) & (F.col("pos") < block_length)
    reach = scored.groupBy("seq_id").agg(
        F.max(before).cast("bigint").alias("before"), F.max(F.when(hit, F.col("pos"))).alias("far")
    )
    estimate = F.when(F.col("before") >= block_length, F.col("before")).otherwise(
        F.coalesce(F.col("far") + 1, F.col("before") + 1)
    )
    return reach.select(
        "seq_id", F.least(F.greatest(estimate, F.lit(1)), F.lit(block_length)).cast("bigint").alias("frontier")
    )


def stability(
    trace: DataFrame,
    window: int = 2,
    sigma: float = 1.0,
    block_length: int = 128,
    steps_per_bucket: int = 65536,
) -> DataFrame:
    """Per step of each group: is the length estimate stable, and which length does it give.

    Stable when the last `window` values exist and deviate (population) by less than `sigma`: the
    last value counts; otherwise the truncated mean of the values there are. `trace` has unique
    `seq_id, step` and `frontier`. Groups are cut into ranges of their row numbers that overlap by
    `window - 1` rows, so that a range of one group is the most a task holds; a wider window widens them.
    """
    steps_per_bucket = max(steps_per_bucket, window)
    keyed = trace.withColumn("_steps", F.expr(f"step div {steps_per_bucket}"))
    numbered = number_rows(keyed, ["seq_id"], ["_steps"], ["step"], coarser=[1 << 24]).drop("_steps")
    own = F.expr(f"(ordinal - 1) div {steps_per_bucket}")
    runs_over = F.expr(f"(ordinal - 1) % {steps_per_bucket}") >= steps_per_bucket - (window - 1)
    spread = numbered.withColumn("_own", own).withColumn(
        "_range", F.explode(F.when(runs_over, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    frame = Window.partitionBy("seq_id", "_range").orderBy("step").rowsBetween(1 - window, 0)
    seen = spread.withColumns(
        {
            "_n": F.count("frontier").over(frame),
            "_std": F.stddev_pop("frontier").over(frame),
            "_mean": F.avg("frontier").over(frame),
        }
    ).where(F.col("_range") == F.col("_own"))
    stable = (F.col("_n") >= window) & (F.col("_std") < sigma)
    length = F.when(stable, F.col("frontier")).otherwise(F.floor("_mean"))
    return seen.select(
        "seq_id",
        "step",
        stable.alias("stable"),
        F.least(F.greatest(length, F.lit(1)), F.lit(block_length)).cast("bigint").alias("length"),
    )


def weighted_sample(scores: DataFrame, temperature: float = 1.0, seed: int = SEED) -> DataFrame:
    """`seq_id, pos, token`: one draw per position with probability in proportion to exp(logit / T).

    An exponential race on hashed draws; temperature 0 takes the largest logit.
    """
    if temperature == 0:
        return confidence(scores).select("seq_id", "pos", "token")
    words = position_words(hash32("g", seed, F.col("seq_id"), F.col("pos")), F.col("logits"))
    draw = F.transform(words, lambda x: (final_word(x) + F.lit(0.5)) / F.lit(SCALE))
    raced = F.zip_with("logits", draw, lambda x, u: x - F.lit(float(temperature)) * F.ln(-F.ln(u)))
    return scores.select("seq_id", "pos", raced.alias("raced")).select(
        "seq_id", "pos", (F.array_position("raced", F.array_max("raced")) - 1).alias("token")
    )


def apply_updates(sequences: DataFrame, picks: DataFrame) -> DataFrame:
    """Write picked tokens into their sequences: `sequences` has `seq_id, ids`.

    Picks of a sequence (never more than its length, one per position) are merged with its ids by
    position in one sort, so long sequences with many picks stay near linear.
    """
    updates = picks.groupBy("seq_id").agg(
        F.collect_list(
            F.struct(F.col("pos").cast("int").alias("pos"), F.lit(0).alias("rank"), F.col("token").alias("id"))
        ).alias("updates")
    )
    inside = F.filter("updates", lambda u: (u["pos"] >= 0) & (u["pos"] < F.size("ids")))
    merged = sequences.join(updates, "seq_id", "left").select(
        "seq_id",
        F.sort_array(
            F.concat(
                F.transform(
                    "ids", lambda x, i: F.struct(i.alias("pos"), F.lit(1).alias("rank"), x.alias("id"))
                ),
                F.coalesce(inside, F.array().cast("array<struct<pos:int,rank:int,id:bigint>>")),
            )
        ).alias("merged"),
    )
    # After the sort an update stands right before the id it replaces.
    rest = F.slice("merged", F.lit(1), F.greatest(F.size("merged") - 1, F.lit(0)))
    last = F.concat(F.array(F.lit(-1)), F.transform(rest, lambda m: m["pos"]))
    marked = F.zip_with("merged", last, lambda m, before: F.when(m["pos"] != before, m["id"]))
    return merged.select("seq_id", F.filter(marked, lambda x: x.isNotNull()).alias("ids"))
