"""Score selection against plain loops."""

import math
import random
import statistics

from pyspark.sql import functions as F

from tokenloom.operators import metrics, select

SCORED = "seq_id bigint, pos int, filled boolean, token bigint, conf double"


def table(seed, groups=40, ties=True):
    rng = random.Random(seed)
    rows = []
    for s in range(groups):
        for p in range(rng.randrange(1, 30)):
            conf = rng.choice([0.2, 0.5, 0.95]) if ties and rng.random() < 0.5 else rng.random()
            rows.append((s, p, rng.random() < 0.3 or s == 3, rng.randrange(1000), conf))
    return rows


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def got(df):
    return sorted((r.seq_id, r.pos, r.token) for r in df.collect())


def test_threshold(spark):
    rows = table(1)
    want, edit = [], []
    for s, g in grouped(rows).items():
        open_rows = [r for r in g if not r[2]]
        chosen = [r for r in open_rows if r[4] > 0.9]
        if not chosen and open_rows:
            chosen = [max(open_rows, key=lambda r: (r[4], -r[1]))]
        want += [(s, r[1], r[3]) for r in chosen]
        edit += [(s, r[1], r[3]) for r in g if r[2] and r[4] > 0]
    df = spark.createDataFrame(rows, SCORED)
    assert got(select.pick_threshold(df, 0.9)) == sorted(want)
    assert got(select.pick_threshold(df, 0.9, edit=True)) == sorted(want + edit)


def test_high_or_topk(spark):
    rows = table(2)
    for k in (1, 3):
        want = []
        for s, g in grouped(rows).items():
            open_rows = sorted((r for r in g if not r[2]), key=lambda r: (-r[4], r[1]))
            high = [r for r in open_rows if r[4] >= 0.9]
            want += [(s, r[1], r[3]) for r in (high if len(high) > 1 else open_rows[:k])]
        assert got(select.pick_high_or_topk(spark.createDataFrame(rows, SCORED), 0.9, k)) == sorted(want)


def test_topk_is_cut_before_the_shuffle(spark, tmp_path):
    spark.createDataFrame(table(3), SCORED).write.parquet(f"{tmp_path}/s")
    df = spark.read.parquet(f"{tmp_path}/s")
    plan = select.pick_high_or_topk(df, 0.9, 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_confidence_and_loss(spark):
    rng = random.Random(4)
    rows = [(0, p, [rng.uniform(-30, 30) for _ in range(9)], rng.choice([-100, 3, 8])) for p in range(50)]
    rows.append((0, 50, [1.0, 5.0, 5.0], 1))
    df = spark.createDataFrame(rows, "seq_id bigint, pos int, logits array<double>, label bigint")
    losses = []
    for r in select.confidence(df).collect():
        logits = rows[r.pos][2]
        shares = [math.exp(x - max(logits)) for x in logits]
        assert r.token == logits.index(max(logits))
        assert abs(r.conf - max(shares) / sum(shares)) < 1e-12
        if r.label != -100:
            losses.append(-math.log(shares[r.label] / sum(shares)))
    row = metrics.masked_nll(df).collect()[0]
    assert row.positions == len(losses) and abs(row.mean_nll - sum(losses) / len(losses)) < 1e-9


def test_quota(spark):
    df = spark.createDataFrame([(1, 10), (2, 3), (3, 0)], "seq_id bigint, n bigint")
    rows = {}
    for r in select.even_quota(df, 4).collect():
        rows.setdefault(r.seq_id, {})[r.step] = r.quota
    assert rows == {
        1: {0: 3, 1: 3, 2: 2, 3: 2}, 2: {0: 1, 1: 1, 2: 1, 3: 0}, 3: {0: 0, 1: 0, 2: 0, 3: 0}
    }


def test_frontier(spark):
    rows = table(5)
    for before in (0, 7, 40):
        df = spark.createDataFrame(rows, SCORED).withColumn("before", F.lit(before))
        out = {r.seq_id: r.frontier for r in select.frontier(df, 0.5, 24, "before").collect()}
        for s, g in grouped(rows).items():
            scope = [r[1] - before for r in g if not r[2] and r[4] >= 0.5 and before <= r[1] < 24]
            step = 0 if before >= 24 else (max(scope) + 1 if scope else 1)
            assert out[s] == min(max(before + step, 1), 24)


def test_stability(spark):
    rng = random.Random(6)
    rows = [(s, 3 * t, rng.randrange(1, 40)) for s in range(3) for t in range(200)]
    df = spark.createDataFrame(rows, "seq_id bigint, step bigint, frontier bigint")
    for window in (1, 2, 5):
        out = {
            (r.seq_id, r.step): (r.stable, r.length)
            for r in select.stability(df, window, 1.5, 32, steps_per_bucket=16).collect()
        }
        assert len(out) == len(rows)
        for s in range(3):
            values = [r[2] for r in rows if r[0] == s]
            for t in range(200):
                seen = values[max(0, t - window + 1) : t + 1]
                stable = len(seen) >= window and statistics.pstdev(seen) < 1.5
                length = seen[-1] if stable else int(sum(seen) / len(seen))
                assert out[s, 3 * t] == (stable, min(max(length, 1), 32))


def test_weighted_sample(spark):
    """Shares of the draws follow the softmax; temperature 0 takes the largest."""
    logits = [0.0, 1.0, 2.0, 0.5]
    df = spark.range(20000).select(
        F.lit(1).cast("bigint").alias("seq_id"), F.col("id").alias("pos"), F.array(*map(F.lit, logits)).alias("logits")
    )
    for temperature in (1.0, 0.5):
        counts = {
            r.token: r["count"] for r in select.weighted_sample(df, temperature).groupBy("token").count().collect()
        }
        weights = [math.exp(x / temperature) for x in logits]
        for token, weight in enumerate(weights):
            assert abs(counts[token] / 20000 - weight / sum(weights)) < 0.015
    assert {r.token for r in select.weighted_sample(df.limit(10), 0).collect()} == {2}


def test_apply_updates(spark):
    sequences = spark.createDataFrame(
        [(1, [5, 6, 7]), (2, []), (3, [9, 9])], "seq_id bigint, ids array<bigint>"
    )
    picks = spark.createDataFrame(
        [(1, 0, 50), (1, 2, 70), (1, 8, 1), (2, 0, 4), (4, 0, 4)], "seq_id bigint, pos int, token bigint"
    )
    out = {r.seq_id: r.ids for r in select.apply_updates(sequences, picks).collect()}
    assert out == {1: [50, 6, 70], 2: [], 3: [9, 9]}


def test_run_reports(spark):
    rows = [(0, 0, 10, 2, 1.0), (0, 1, 30, 3, 2.0), (1, 0, 5, 5, 4.0), (1, 0, 5, 0, 1.0)]
    runs = spark.createDataFrame(rows, "rank int, batch_id bigint, tokens bigint, calls bigint, seconds double")
    speed = metrics.throughput(runs).collect()[0]
    assert (speed.tokens, speed.per_rank_second, speed.per_wall_second) == (50, 50 / 8, 10.0)
    calls = metrics.tokens_per_call(runs).collect()[0]
    assert calls.rank_mean == ((5 + 10) / 2 + 2) / 2 and calls.weighted_mean == 5.0
    assert metrics.mean_work_length(runs).collect()[0].mean_length == 5.0


def test_quota_per_group_and_scope(spark):
    rows = [(g, p, 10 * g + p, 0.5 - p / 100, False, g, 3) for g in range(4) for p in range(20)]
    scored = spark.createDataFrame(rows, "seq_id bigint, pos int, token bigint, conf double, filled boolean, quota bigint, before int")
    got = sorted((r.seq_id, r.pos) for r in select.pick_high_or_topk(scored, 0.9, "quota").collect())
    assert got == [(g, p) for g in range(4) for p in range(g)]
    got = sorted((r.seq_id, r.pos) for r in select.pick_high_or_topk(scored, 0.9, "quota", previous="before").collect())
    assert got == [(g, 3 + p) for g in range(4) for p in range(g)]
    assert select.pick_high_or_topk(scored, 0.45, 1).count() == 4 * 6


def test_confidence_of_odd_logits(spark):
    rows = [(1, [0.0, float("inf"), 1.0]), (2, [0.0, float("nan"), 1.0]), (3, [2.0, 2.0])]
    got = {r.seq_id: r.token for r in select.confidence(spark.createDataFrame(rows, "seq_id bigint, logits array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_stability_of_sparse_steps_and_wide_windows(spark):
    rows = [(1, i * 10_000_000, 5) for i in range(300)]
    trace = spark.createDataFrame(rows, "seq_id bigint, step bigint, frontier bigint")
    got = select.stability(trace, window=2).collect()
    assert len(got) == 300 and sum(r.stable for r in got) == 299
    wide = select.stability(trace, window=100, steps_per_bucket=10).collect()
    assert sum(r.stable for r in wide) == 201
