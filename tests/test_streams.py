"""Stream packing equals batch packing, also over restarts and repeated micro-batches."""

from pyspark.sql import functions as F

from tests.test_packing import B, L, examples
from tokenloom.operators import noising
from tokenloom.sources.records import stream_records
from tokenloom.streaming import packing as stream

SCHEMA = "arrival bigint, shard int, id bigint, input_ids array<bigint>, prompt_length int"


def write(spark, folder, rows, lo, hi):
    part = [(a, a % 3, i, ids, p) for a, (i, ids, p) in enumerate(rows)][lo:hi]
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(f"{folder}/{lo}")


def start(spark, folder, sink, offsets):
    source = stream_records(spark, folder, SCHEMA, 1, glob="*.json")
    query = stream.pack_stream(source, sink, offsets, L, B, noise_seed=42)
    query.awaitTermination()
    return query


def expected(rows):
    want = []
    for shard in range(3):
        tokens, labels, waiting, seen, chunk = [], [], [], 0, 0
        for a, (_, ids, prompt) in enumerate(rows):
            if a % 3 != shard:
                continue
            ids, prompt = ids or [], prompt or 0
            tokens += ids
            labels += [-100] * min(prompt, len(ids)) + ids[prompt:]
            seen += 1
            while len(tokens) >= L:
                waiting.append((shard, chunk, tokens[:L], labels[:L]))
                tokens, labels, chunk = tokens[L:], labels[L:], chunk + 1
                if len(waiting) == B:
                    want += [(s, c, seen, t, l) for s, c, t, l in waiting]
                    waiting, seen = [], 0
    return want


def test_stream_equals_loop_over_restarts(spark, tmp_path):
    rows = examples(11, 160)
    folder, sink, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    for lo, hi in ((0, 5), (5, 70), (70, 71)):
        write(spark, folder, rows, lo, hi)
        start(spark, folder, sink, offsets)
    write(spark, folder, rows, 71, 160)
    start(spark, folder, sink, offsets)
    blocks = stream.packed_blocks(spark, sink, L, B)
    got = sorted((r.shard, r.chunk_id, r.num_instruction, r.input_ids, r.labels) for r in blocks.collect())
    assert got == expected(rows)
    again = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(f"{folder}/71")
    stream._pack_batch(again, 3, sink, L, B, 42)
    repeated = stream.packed_blocks(spark, sink, L, B)
    assert sorted((r.shard, r.chunk_id, r.num_instruction, r.input_ids, r.labels) for r in repeated.collect()) == got
    noised = stream.noised_blocks(spark, sink)
    assert noised.exceptAll(noising.noise(repeated).select(noised.columns)).count() == 0


def test_stream_of_empty_records(spark, tmp_path):
    folder, sink, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    write(spark, folder, [(i, None, None) for i in range(6)], 0, 6)
    start(spark, folder, sink, offsets)
    assert stream.packed_blocks(spark, sink, L, B).count() == 0
    rows = [(i, None, None) for i in range(6)] + [(6, list(range(L * B)), 0)]
    write(spark, folder, rows, 6, 7)
    start(spark, folder, sink, offsets)
    assert {r.num_instruction for r in stream.packed_blocks(spark, sink, L, B).collect()} == {3}


def test_files_per_trigger(spark, tmp_path):
    folder, sink = str(tmp_path / "in"), str(tmp_path / "taken")
    rows = examples(12, 30)
    for lo in (0, 10, 20):
        write(spark, folder, rows, lo, lo + 10)
    query = (
        stream_records(spark, folder, SCHEMA, 2, glob="*.json")
        .observe("seen", F.count(F.lit(1)).alias("n"))
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "offsets"))
        .trigger(availableNow=True)
        .start(sink)
    )
    query.awaitTermination()
    seen = [p.observedMetrics["seen"].n for p in query.recentProgress if "seen" in p.observedMetrics]
    assert [n for n in seen if n] == [20, 10]


def test_counters_of_many_micro_batches(spark, tmp_path):
    """More micro-batches than a query's progress list holds."""
    from tokenloom.queries.streams import count_stream, counted

    folder, sink = str(tmp_path / "in"), str(tmp_path / "counted")
    (tmp_path / "in").mkdir()
    for i in range(104):
        (tmp_path / "in" / f"{i}.json").write_text('{"arrival": %d, "input_ids": [1, 2]}\n' % i)
    source = stream_records(spark, folder, SCHEMA, 1, glob="*.json")
    count_stream(source, sink, str(tmp_path / "offsets")).awaitTermination()
    assert spark.read.parquet(sink).count() == 104
    assert tuple(counted(spark, sink).first()) == (104, 208)


def test_input_is_read_once_per_micro_batch(spark, tmp_path):
    """A timed trigger, stopped after its first micro-batch; the copy of the micro-batch is removed."""
    import time

    rows = examples(13, 30)
    folder, sink, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    write(spark, folder, rows, 0, 30)
    reads = spark.sparkContext.accumulator(0)
    source = stream_records(spark, folder, SCHEMA, 1, glob="*.json")

    def mark(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    query = stream.pack_stream(source.mapInArrow(mark, source.schema), sink, offsets, L, B, trigger={"processingTime": "1 hour"})
    while query.isActive and not query.recentProgress:
        time.sleep(0.1)
    query.stop()
    assert reads.value == 30
    blocks = stream.packed_blocks(spark, sink, L, B)
    assert sorted((r.shard, r.chunk_id, r.num_instruction, r.input_ids, r.labels) for r in blocks.collect()) == expected(rows)
