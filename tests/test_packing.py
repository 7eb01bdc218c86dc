"""Packing against a sequential model, its invariants and its plan."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import cutter, metrics, order, packing
from tokenloom.operators.prefix import number_rows
from tokenloom.sources.records import write_blocks

L, B = 16, 3
SCHEMA = "id bigint, input_ids array<bigint>, prompt_length int"


def examples(seed, n):
    rng = random.Random(seed)
    lengths = [0, 1, L - 1, L, L + 1, 3 * L + 1, L * B, L * B - 1, 4 * L * B + 2]
    rows = []
    for i in range(n):
        size = rng.choice(lengths) if rng.random() < 0.3 else rng.randrange(0, 2 * L)
        ids = [1000 * i + j for j in range(size)]
        rows.append((i, None if rng.random() < 0.05 else ids, rng.choice([None, 0, size // 2, size, size + 7])))
    return rows


def key_of(seed, epoch, i):
    return hashlib.md5(f"{seed + epoch}:{i}".encode()).hexdigest()


def sequential(rows, seed=42, epoch=0, block=L, batch=B):
    """The rule read as a loop: extend two buffers, cut blocks, count examples per batch."""
    tokens, labels, waiting, done, seen = [], [], [], [], 0
    chunk = 0
    for i, ids, prompt in sorted(rows, key=lambda r: key_of(seed, epoch, r[0])):
        ids, prompt = ids or [], prompt or 0
        tokens += ids
        labels += [-100] * min(prompt, len(ids)) + ids[prompt:]
        seen += 1
        while len(tokens) >= block:
            waiting.append((chunk, tokens[:block], labels[:block]))
            tokens, labels, chunk = tokens[block:], labels[block:], chunk + 1
            if len(waiting) == batch:
                done += [(c, seen, t, l) for c, t, l in waiting]
                waiting, seen = [], 0
    return done, [(c, t, l) for c, t, l in waiting], tokens


def packed(df, streams=1, **kwargs):
    out = packing.pack(df, kwargs.pop("block", L), kwargs.pop("batch", B), streams=streams, **kwargs)
    return sorted(
        (r.epoch, r.shard, r.chunk_id, r.num_instruction, r.input_ids, r.labels) for r in out.collect()
    )


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 700), (3, 5)])
def test_equals_sequential_model(spark, seed, n):
    rows = examples(seed, n)
    df = order.assign_shards(order.order_epochs(spark.createDataFrame(rows, SCHEMA)), 1)
    want = [(0, 0, c, k, t, l) for c, k, t, l in sequential(rows)[0]]
    assert packed(df) == want


def test_single_blocks_and_tail(spark):
    rows = examples(4, 300)
    df = order.assign_shards(order.order_epochs(spark.createDataFrame(rows, SCHEMA)), 1)
    done, waiting, tail = sequential(rows)
    single = packed(df, batch=1)
    assert [(c, t, l) for _, _, c, _, t, l in single] == [(c, t, l) for c, _, t, l in done] + waiting
    everything = packed(df, drop_tail=False)
    assert sum(len(t) for *_, t, _ in everything) == sum(len(r[1] or []) for r in rows)
    assert len(single) * L + len(tail) == sum(len(r[1] or []) for r in rows)


def test_epochs_and_shards(spark):
    rows = examples(5, 400)
    for exact in (False, True):
        df = order.assign_shards(
            packing.with_token_count(
                packing.record_defaults(order.order_epochs(spark.createDataFrame(rows, SCHEMA), epochs=2))
            ),
            3,
            2,
            exact=exact,
        )
        shards = {(r.epoch, r.id): r.shard for r in df.select("epoch", "id", "shard").collect()}
        assert set(shards) == {(e, r[0]) for e in (0, 1) for r in rows}
        if exact:
            sizes = [sum(s == k for (e, _), s in shards.items() if e == 0) for k in range(3)]
            assert max(sizes) - min(sizes) <= 1
        want = []
        for epoch in (0, 1):
            for shard in range(3):
                part = [r for r in rows if shards[epoch, r[0]] == shard]
                want += [(epoch, shard, c, k, t, l) for c, k, t, l in sequential(part, epoch=epoch)[0]]
        assert packed(df, streams=6) == want


@pytest.mark.parametrize("partitions", [1, 4, 64])
@pytest.mark.parametrize("tasks", ["2", "40"])
def test_layout_independent(spark, partitions, tasks):
    rows = examples(6, 200)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
        got = packed(order.assign_shards(order.order_epochs(df), 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == [(0, 0, c, k, t, l) for c, k, t, l in sequential(rows)[0]]


def test_shuffle_join_of_bucket_table(spark):
    """A bucket table that Spark does not broadcast is joined by its key, with equal results."""
    rows = examples(7, 150)
    df = order.assign_shards(order.order_epochs(spark.createDataFrame(rows, SCHEMA)), 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert packed(df) == [(0, 0, c, k, t, l) for c, k, t, l in sequential(rows)[0]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_batches_keep_rows_without_a_key(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "item_id bigint")
    got = {(r.item_id, r.ordinal, r.batch_id) for r in order.number_batches(rows, 2).collect()}
    assert got == {(None, 1, 0), (1, 2, 0), (2, 3, 1)}


def test_counts_and_progress(spark):
    rows = examples(8, 500)
    df = order.assign_shards(order.order_epochs(spark.createDataFrame(rows, SCHEMA), epochs=2), 1)
    counts = packing.batch_counts(df, L, B, streams=2)
    got = {(r.epoch, r.batch_id): r.num_instruction for r in counts.collect()}
    want = {}
    for epoch in (0, 1):
        for c, k, _, _ in sequential(rows, epoch=epoch)[0]:
            want[epoch, c // B] = k
    assert got == want
    assert 0 in want.values()
    steps = metrics.progress(counts, L * B, log_every=1, accumulation=2, world_size=4, batches_per_bucket=8)
    running, expected = 0, {}
    for micro, key in enumerate(sorted(want)):
        running += want[key]
        if (micro // 2 + 1) % 2 == 0:
            expected[key] = (running * 4, (micro + 1) * L * B * 4 / 1e9)
    assert {(r.epoch, r.batch_id): (r.num_instruction, r.total_tokens) for r in steps.collect()} == expected


def test_arrays_are_exchanged_and_sorted_once(spark, tmp_path):
    rows = examples(9, 100)
    packing.with_token_count(spark.createDataFrame(rows, SCHEMA)).write.parquet(f"{tmp_path}/t")
    df = order.assign_shards(order.order_epochs(spark.read.parquet(f"{tmp_path}/t")), 1)
    blocks = packing.pack(df, L, B)
    blocks.collect()
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("REPARTITION_BY_COL") == final.count("Sort [slot") == final.count("MapInArrow") == 1, plan
    assert "BroadcastHashJoin" in plan and "Union" not in plan
    assert "ReadSchema: struct<id:bigint,n_tokens:bigint>" in plan


@pytest.mark.parametrize("held", [1, 200])
def test_runs_hand_over_open_batches(spark, monkeypatch, held):
    """Small runs and buffers: batches reach over several cells and runs, with empty examples at the borders."""
    rows = examples(11, 900)
    monkeypatch.setattr(cutter, "HELD", held)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = order.assign_shards(order.order_epochs(spark.createDataFrame(rows, SCHEMA)), 1)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        for block, batch in ((1, 1), (2, 2), (5, 3), (64, 8), (10_000, 1)):
            want = [(0, 0, c, k, t, l) for c, k, t, l in sequential(rows, block=block, batch=batch)[0]]
            assert packed(df, block=block, batch=batch) == want
            tail = packed(df, block=block, batch=batch, drop_tail=False)
            assert tail[: len(want)] == want
            done, waiting, rest = sequential(rows, block=block, batch=batch)
            assert [t for *_, t, _ in tail[len(want) :]] == [t for _, t, _ in waiting] + [rest] * bool(rest)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_streams(spark):
    for rows in ([], [(1, [], 0), (2, None, None)]):
        df = order.assign_shards(order.order_epochs(spark.createDataFrame(rows, SCHEMA)), 1)
        assert packed(df) == packed(df, drop_tail=False) == []


def test_stats_sum_up(spark):
    rows = examples(10, 250)
    df = order.assign_shards(order.order_epochs(spark.createDataFrame(rows, SCHEMA)), 1)
    stats = packing.packing_stats(df, L, B).collect()[0]
    done, waiting, tail = sequential(rows)
    assert stats.blocks == len(done) + len(waiting)
    assert stats.batches == len(done) // B
    assert stats.tail_tokens == len(tail)
    assert stats.tokens == stats.blocks * L + stats.tail_tokens


def test_number_batches(spark):
    items = spark.range(0, 1000, 7).withColumnRenamed("id", "item_id")
    rows = order.number_batches(items, 10, rows_per_bucket=64).orderBy("item_id").collect()
    assert [r.batch_id for r in rows] == [i // 10 for i in range(len(rows))]
    whole = order.number_batches(items, 10, keep_short=False).count()
    assert whole == len(rows) // 10 * 10


def test_number_batches_of_sparse_ids(spark):
    """Ids over the whole range of whole numbers, also negative ones."""
    ids = sorted({(i * 7919 * 2**44 + i) % 2**63 - 2**62 for i in range(500)} | set(range(-50, 50)))
    items = spark.createDataFrame([(i,) for i in ids], "item_id bigint").repartition(7)
    for width in (4, 65536):
        rows = order.number_batches(items, 10, rows_per_bucket=width).orderBy("item_id").collect()
        assert [r.item_id for r in rows] == ids
        assert [r.batch_id for r in rows] == [i // 10 for i in range(len(ids))]


def test_levels_of_buckets(spark):
    """More levels give the same totals."""
    rows = spark.range(3000).select(F.col("id") * 3, (F.col("id") % 2).alias("g")).toDF("id", "g")
    keyed = rows.withColumn("bucket", F.expr("id div 8"))
    want = number_rows(keyed, ["g"], ["bucket"], ["id"]).orderBy("id").collect()
    for coarser in ([16], [4, 8], [2, 2, 2]):
        assert number_rows(keyed, ["g"], ["bucket"], ["id"], coarser=coarser).orderBy("id").collect() == want
    assert [r.ordinal for r in want] == [1 + i // 2 for i in range(3000)]


def test_written_blocks(spark, tmp_path):
    rows = examples(13, 300)
    df = order.assign_shards(order.order_epochs(spark.createDataFrame(rows, SCHEMA), epochs=2), 2, 2)
    blocks = packing.pack(df, L, B, streams=4)
    want = sorted((r.epoch, r.shard, r.chunk_id, r.input_ids) for r in blocks.collect())
    for rebalance in (False, True):
        path = f"{tmp_path}/{rebalance}"
        write_blocks(blocks, path, rebalance=rebalance)
        back = spark.read.parquet(path)
        assert sorted((r.epoch, r.shard, r.chunk_id, r.input_ids) for r in back.collect()) == want
        one = spark.read.parquet(f"{path}/epoch=1/shard=0")
        assert one.count() == sum(w[:2] == (1, 0) for w in want)
    files = {str(f) for f in tmp_path.glob("True/epoch=*/shard=*/*.parquet")}
    assert len(files) == 4


def test_blocks_leave_in_bounded_batches(monkeypatch):
    """A long Arrow batch of one run is cut in slices; no batch of blocks holds much more than HELD tokens."""
    import pyarrow as pa

    from tokenloom.functions import slices
    from tokenloom.operators import cutter

    def made():
        rng, n = random.Random(3), 400
        sizes = [rng.randrange(0, 30) for _ in range(n)]
        whole = pa.RecordBatch.from_pydict({
            "epoch": pa.array([0] * n, pa.int32()), "shard": pa.array([0] * n, pa.int32()), "bucket": pa.array([0] * n, pa.int64()), "cell": pa.array([0] * n, pa.int32()),
            "cell_start": pa.array([0] * n, pa.int64()), "cell_rows": pa.array([0] * n, pa.int64()), "own": [True] * n, "n_tokens": pa.array(sizes, pa.int64()),
            "input_ids": pa.array([list(range(s)) for s in sizes], pa.list_(pa.int64())), "prompt_length": pa.array([rng.randrange(5) for _ in range(n)], pa.int64()),
        })
        return list(cutter.cutter(8, 2, False)(iter([whole])))

    want = pa.Table.from_batches(made()).to_pylist()
    monkeypatch.setattr(cutter, "HELD", 64)
    monkeypatch.setattr(slices, "ELEMENTS", 64, raising=False)
    got = made()
    assert max(len(b.column("input_ids").flatten()) for b in got) <= 64 + 64 + 30 + 16
    assert pa.Table.from_batches(got).to_pylist() == want
