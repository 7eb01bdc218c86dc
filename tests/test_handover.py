"""Hand-over of batches by a manifest, and broken lines of record files."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from tests.test_packing import B, L, SCHEMA, examples
from tokenloom.operators import order, packing
from tokenloom.sources import handover, records


def blocks_of(spark, rows):
    df = order.assign_shards(order.order_epochs(spark.createDataFrame(rows, SCHEMA), epochs=2), 2, 2)
    return packing.pack(df, L, B, streams=4)


def test_read_back_from_any_batch(spark, tmp_path):
    path = str(tmp_path)
    blocks = blocks_of(spark, examples(31, 300))
    want = sorted((r.epoch, r.shard, r.batch_id, r.chunk_id, r.input_ids, r.labels) for r in blocks.collect())
    run = handover.hand_over(blocks, path, batches_per_file=5)
    listed = handover.manifest(spark, path).collect()
    assert sum(r.blocks for r in listed) == len(want) and {r.run for r in listed} == {run}
    assert all(r.last_batch // 5 == r.first_batch // 5 for r in listed)
    for start in (0, 1, 7, 10_000):
        mine = [w for w in want if w[:2] == (1, 0) and w[2] >= start]
        got = handover.read_from(spark, path, 1, 0, start)
        assert sorted((r.epoch, r.shard, r.batch_id, r.chunk_id, r.input_ids, r.labels) for r in got.collect()) == mine
        told = list(handover.batches(spark, path, 1, 0, start))
        assert [n for n, _ in told] == sorted({w[2] for w in mine})
        assert [x for _, t in told for x in t.column("input_ids").to_pylist()] == [w[4] for w in mine]
    files = handover.files_from(spark, path, 1, 0, 7)
    assert 0 < len(files) < len(handover.files_from(spark, path, 1, 0))
    assert handover.read_from(spark, path, 9, 9).collect() == []


def test_runs_without_a_manifest_are_not_there(spark, tmp_path):
    path = str(tmp_path)
    blocks = blocks_of(spark, examples(32, 60))
    handover.hand_over(blocks.where("epoch = 0"), path, "first")
    blocks.where("epoch = 1").write.partitionBy("epoch", "shard").parquet(f"{path}/data/run=died")
    assert {r.run for r in handover.manifest(spark, path).collect()} == {"first"}
    assert handover.read_from(spark, path, 1, 0).collect() == []
    handover.hand_over(blocks.where("epoch = 1"), path, "second")
    assert handover.read_from(spark, path, 1, 0).count() == blocks.where("epoch = 1 and shard = 0").count()
    handover.hand_over(blocks.where("epoch = 0").limit(0), path, "first")
    assert handover.read_from(spark, path, 0, 0).collect() == []


def plain_blocks(spark, batches, shards):
    """Two blocks a batch, of ids that tell where they are from."""
    cells = spark.range(batches * shards * 2).select(
        F.lit(0).alias("epoch"), (F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {2 * shards}").alias("batch_id"),
        F.expr(f"id div {shards}").alias("chunk_id"), F.lit(1).cast("bigint").alias("num_instruction"),
    )
    return cells.withColumn("input_ids", F.array("chunk_id", F.col("shard").cast("bigint"))).withColumn("labels", F.col("input_ids"))


def test_files_of_a_long_run_hold_several_parts(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    monkeypatch.setattr(handover, "SAME_SIZE", 8, raising=False)
    handover.hand_over(plain_blocks(spark, 200, 2), path, batches_per_file=2)
    listed = handover.manifest(spark, path).collect()
    # A row of the manifest is a part still: two batches, of two blocks each.
    assert sorted((r.shard, r.first_batch, r.last_batch, r.blocks) for r in listed) == [(s, b, b + 1, 4) for s in (0, 1) for b in range(0, 200, 2)]
    files = handover.files_from(spark, path, 0, 1)
    assert len(files) == 8 + 8 + 8 + 6 and len({r.file for r in listed}) == 2 * len(files)
    assert handover.files_from(spark, path, 0, 1, 15) == files[7:] and handover.files_from(spark, path, 0, 1, 19) == files[8:]
    whole = [r.input_ids[0] for r in handover.read_from(spark, path, 0, 1).orderBy("chunk_id").collect()]
    assert whole == list(range(400))
    for start in (19, 131, 197):
        got = handover.read_from(spark, path, 0, 1, start).orderBy("chunk_id").collect()
        assert [(r.shard, r.batch_id, r.input_ids) for r in got] == [(1, c // 2, [c, 1]) for c in range(2 * start, 400)]
    told = list(handover.batches(spark, path, 0, 1, 187))
    assert [(n, t.column("chunk_id").to_pylist()) for n, t in told] == [(n, [2 * n, 2 * n + 1]) for n in range(187, 200)]


def test_parts_of_a_file(spark):
    for size in (1, 4, 500, 5000):
        most = max(1, handover.MOST_BATCHES // size)
        batch = spark.range(0, 2**40, 2**30).union(spark.range(20_000))
        got = batch.select("id", F.col("id").alias("batch_id")).withColumn("part", handover.file_part(size)).collect()
        first, want, width = 0, {}, 1
        last = 20_000 // size
        while first <= last:
            for _ in range(handover.SAME_SIZE):
                want.update(dict.fromkeys(range(first, first + width), first))
                first += width
            width = min(2 * width, 1 << (most.bit_length() - 1))
        assert all(r.part == want[r.id // size] for r in got if r.id < 20_000)
        assert all(0 <= r.id // size - r.part < most for r in got)
    odd = spark.sql("SELECT * FROM VALUES (-9L), (NULL) t(batch_id)").select(handover.file_part(4).alias("part")).collect()
    assert [r.part for r in odd] == [-2, None]


LINES = ['{"instruction": "a", "output": "ü"}', "{broken", "", '{"instruction": "b"}', "  ", '{"instruction": 5, "output": ["x"', '{"instruction": "a", "output": "ü"}', "no json"]


@pytest.mark.parametrize("split", ["64", "128m"])
def test_broken_lines_are_kept_apart(spark, tmp_path, split):
    (tmp_path / "sub").mkdir()
    texts = {"a.jsonl": "\n".join(LINES * 5) + "\n", "sub/b.jsonl": "\n".join(LINES[::-1]), "sub/c.jsonl": LINES[0] + "\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        good, broken = records.split_records(spark, str(tmp_path))
        rows, faults = good.collect(), broken.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    lines = [x for t in texts.values() for x in t.split("\n") if x.strip()]
    assert len(rows) + len(faults) == len(lines)
    assert sorted(r.line for r in faults) == sorted(x for x in lines if x in (LINES[1], LINES[5], LINES[7]))
    for r in faults:
        data = texts[r.file.split(str(tmp_path) + "/")[1]].encode()
        assert data[r.offset :].startswith(r.line.encode()) and (r.offset == 0 or data[r.offset - 1 : r.offset] == b"\n")
    assert len({r.id for r in rows}) == len(rows)
    again, _ = records.split_records(spark, str(tmp_path))
    assert {r.id for r in again.collect()} == {r.id for r in rows}


def test_ids_follow_content_and_copies(spark, tmp_path, monkeypatch):
    rows = [("x", None, "y")] * 50 + [(f"i{i}", "", "o") for i in range(200)]
    df = spark.createDataFrame(rows, records.RAW_SCHEMA)
    ids = []
    for parts, most in ((1, 1 << 20), (7, 1 << 20), (5, 0)):
        monkeypatch.setattr(records, "MOST_COPIES", most)
        got = records.with_record_ids(df.repartition(parts))
        assert got.columns == ["instruction", "input", "output", "id"]
        ids.append({(r.instruction, r.id) for r in got.collect()})
        assert len({i for _, i in ids[-1]}) == 250
    assert ids[0] == ids[1] == ids[2]
    assert records.with_record_ids(df.limit(0)).collect() == []


def test_texts_are_not_exchanged_for_ids(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"instruction": f"{i % 9}", "output": "o"}) + "\n" for i in range(30)))
    got = records.read_records(spark, str(tmp_path))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "instruction" in plan and "Exchange hashpartitioning" not in plan and "FileScan json" not in plan


def test_schema_with_ids_keeps_them(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 7, "instruction": "q"}\n{"id": "seven"}\n')
    good, broken = records.split_records(spark, str(tmp_path), T.StructType([T.StructField("id", T.LongType()), *records.RAW_SCHEMA.fields]))
    assert [(r.id, r.instruction) for r in good.collect()] == [(7, "q")]
    assert [(r.offset, r.line) for r in broken.collect()] == [(30, '{"id": "seven"}')]
    assert good.select(F.max("id")).first()[0] == 7
