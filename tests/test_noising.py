"""Noising: a sequential model, invariants, and the quality of the draws."""

import hashlib

from pyspark.sql import functions as F

from tokenloom.constants import MASK_ID
from tokenloom.functions.draws import SCALE, final_word, hash32, position_words
from tokenloom.operators import noising

N = 64
EOS = (126081, 126348)


def blocks(spark, n):
    ids = F.transform(
        F.sequence(F.lit(0), F.lit(N - 1)),
        lambda i: F.when((i + F.col("chunk_id")) % 13 == 0, F.lit(EOS[0]))
        .when((i + F.col("chunk_id")) % 17 == 0, F.lit(EOS[1]))
        .otherwise(i + 5)
        .cast("bigint"),
    )
    rows = spark.range(n).select(
        F.lit(0).alias("epoch"), F.lit(1).alias("shard"), F.col("id").alias("chunk_id"), ids.alias("input_ids")
    )
    hidden = F.transform("input_ids", lambda x, i: F.when(i < F.col("chunk_id") % 40, F.lit(-100)).otherwise(x).cast("bigint"))
    return rows.withColumn("labels", hidden)


def word(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def draw(h, i):
    x = (h + i * 2654435769) & 0xFFFFFFFF
    for _ in range(2):
        x = (((x >> 16) ^ x) * 73244475) & 0xFFFFFFFF
    return ((x >> 16) ^ x) / 2**32


def test_equals_sequential_model(spark):
    clean = {r.chunk_id: r for r in blocks(spark, 50).collect()}
    for r in noising.noise(blocks(spark, 50), seed=7).collect():
        source = clean[r.chunk_id]
        key = f"0:1:{r.chunk_id}"
        t = (0.9 - 0.1) * (word(f"t:7:{key}") / 2**32) + 0.1
        assert r.t == t
        h = word(f"m:7:{key}")
        for i in range(N):
            x, label = source.input_ids[i], source.labels[i]
            hit = (draw(h, i) < t or x in EOS) and label != -100
            assert r.input_ids[i] == (MASK_ID if hit else x)
            assert r.labels[i] == (label if hit else -100)


def test_equals_the_steps_as_expressions(spark):
    clean = blocks(spark, 300).withColumn("batch_id", F.col("chunk_id") % 7)
    steps = noising.mask_positions(noising.drawn_mask(noising.noise_level(clean)))
    noisy = noising.apply_mask(F.col("input_ids"), F.col("masked"))
    want = steps.select(
        "epoch",
        "shard",
        "chunk_id",
        "batch_id",
        noising.restore_prompt(noisy, F.col("input_ids"), F.col("labels")).alias("input_ids"),
        noising.restrict_labels(F.col("labels"), F.col("masked")).alias("labels"),
        "t",
    )
    got = noising.noise(clean)
    assert sorted(got.columns) == sorted(want.columns)
    assert got.select(want.columns).exceptAll(want).count() == 0 == want.exceptAll(got.select(want.columns)).count()


def test_empty_and_uneven_blocks(spark):
    rows = [(0, 0, i, [5] * n, [5] * n) for i, n in enumerate([0, 3, 0, 1, 40])]
    df = spark.createDataFrame(
        rows, "epoch int, shard int, chunk_id bigint, input_ids array<bigint>, labels array<bigint>"
    ).coalesce(1)
    out = noising.noise(df).orderBy("chunk_id").collect()
    assert [len(r.input_ids) for r in out] == [0, 3, 0, 1, 40] == [len(r.labels) for r in out]
    assert noising.noise(df.where("chunk_id > 9")).count() == 0


def test_invariants(spark):
    joined = noising.noise(blocks(spark, 200)).collect()
    clean = {r.chunk_id: r for r in blocks(spark, 200).collect()}
    for r in joined:
        source = clean[r.chunk_id]
        for x, label, old, old_label in zip(r.input_ids, r.labels, source.input_ids, source.labels):
            if label != -100:
                assert x == MASK_ID and label == old
            else:
                assert x == old
            if old in EOS and old_label != -100:
                assert x == MASK_ID


def test_given_level_wins(spark):
    given = blocks(spark, 10).withColumn("t", F.when(F.col("chunk_id") < 5, F.lit(0.5)))
    for r in noising.noise_level(given).collect():
        assert 0.1 <= r.t < 0.9
        assert (r.t == (0.9 - 0.1) * 0.5 + 0.1) == (r.chunk_id < 5)


def test_independent_of_partitions(spark):
    one = noising.noise(blocks(spark, 40).coalesce(1)).orderBy("chunk_id").collect()
    many = noising.noise(blocks(spark, 40).repartition(16)).orderBy("chunk_id").collect()
    assert one == many


def test_draws_look_uniform_and_unrelated(spark):
    """Mean, spread, neighbouring positions and neighbouring blocks."""
    u = F.transform(
        position_words(hash32("x", F.col("id")), F.sequence(F.lit(1), F.lit(512))),
        lambda w: final_word(w) / F.lit(SCALE),
    )
    rows = [r.u for r in spark.range(200).select(u.alias("u")).collect()]
    flat = [x for r in rows for x in r]
    mean = sum(flat) / len(flat)
    spread = sum((x - mean) ** 2 for x in flat) / len(flat)
    assert abs(mean - 0.5) < 0.005 and abs(spread - 1 / 12) < 0.002

    def correlation(pairs):
        pairs = list(pairs)
        return sum((a - mean) * (b - mean) for a, b in pairs) / len(pairs) / spread

    for lag in (1, 2, 3, 7, 64):
        assert abs(correlation((r[i], r[i + lag]) for r in rows for i in range(512 - lag))) < 0.02
    assert abs(correlation((a, b) for p, q in zip(rows, rows[1:]) for a, b in zip(p, q))) < 0.02


def test_stats(spark):
    noised = noising.noise(blocks(spark, 30))
    stats = {r.chunk_id: r for r in noising.noise_stats(noised).collect()}
    for r in noised.collect():
        assert stats[r.chunk_id].masked_tokens == sum(x == MASK_ID for x in r.input_ids)
        assert stats[r.chunk_id].supervised_tokens == sum(x != -100 for x in r.labels)


def test_missing_blocks_pass(spark):
    rows = [(0, 0, 0, None, None), (0, 0, 1, [1, 2], [1, 2]), (0, 0, 2, [3, 126081], None)]
    blocks = spark.createDataFrame(rows, "epoch int, shard int, chunk_id bigint, input_ids array<bigint>, labels array<bigint>")
    got = {r.chunk_id: r for r in noising.noise(blocks).collect()}
    assert got[0].input_ids == [] and len(got[1].input_ids) == 2
    assert got[2].input_ids == [3, 126081] and got[2].labels == [-100, -100]
