"""Epochs as a stream, the shuffle buffer, bounds of micro-batches, graceful stops, keyed state and counters."""

import hashlib
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_packing import B, L, examples
from tests.test_streams import SCHEMA, expected, write
from tokenloom.operators.buffer import shuffle_buffer
from tokenloom.sources.records import stream_records
from tokenloom.streaming import epochs, keyed, packing
from tokenloom.streaming.counters import count_items, observed
from tokenloom.streaming.stop import Gate, Marker


def plain_buffer(rows, size, draw):
    held, out = [], []
    for row in rows:
        if len(held) < size:
            held.append(row)
        else:
            at = int(draw.random() * size)
            out.append(held[at])
            held[at] = row
    return out + [held[i] for i in np.argsort([draw.random() for _ in held], kind="stable")]


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
def test_buffer_equals_a_plain_one(spark, size):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        df = spark.range(0, 1000, 1, 3).select("id", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("s"))
        got = shuffle_buffer(df, size, 9).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for part, (low, high) in enumerate(((0, 333), (333, 666), (666, 1000))):
        rows = [r for r in got if r.part == part]
        assert [r.id for r in rows] == plain_buffer(list(range(low, high)), size, np.random.default_rng([9, part]))
        assert all(r.s == (str(r.id) if r.id % 5 else None) for r in rows)


def test_buffer_bounds(spark):
    assert shuffle_buffer(spark.range(0), 3).collect() == []
    with pytest.raises(ValueError, match="size"):
        shuffle_buffer(spark.range(3), 0)


def folder_of(tmp_path, files=9):
    for i in range(files):
        inner = tmp_path / "in" / str(i % 2)
        inner.mkdir(parents=True, exist_ok=True)
        (inner / f"{i}.jsonl").write_text("".join(json.dumps({"instruction": f"{i}-{k}", "output": "x" * i}) + "\n" for k in range(3)))
    return str(tmp_path / "in")


def run_epochs(spark, tmp_path, turns, most_batches=None, seed=5):
    """(micro, epoch, instructions in order) of every micro-batch; stops after `most_batches`."""
    seen, gate, enough = [], Gate(), threading.Event()

    def take(records, epoch, micro):
        seen.append((micro, epoch, [r.instruction for r in records.collect()]))
        if most_batches is not None and len(seen) >= most_batches:
            enough.set()

    def finished(query):
        last = query.lastProgress
        return last is not None and last["numInputRows"] == 0 and seen

    query = epochs.stream_epochs(turns, take, str(tmp_path / "offsets"), seed=seed, buffer_rows=2)
    while query.isActive and not enough.is_set() and not finished(query):
        threading.Event().wait(0.05)
    gate.drained(query)
    return seen


def test_two_epochs_differ_in_order_and_resume_exactly(spark, tmp_path):
    folder = folder_of(tmp_path)
    files = epochs.list_files(spark, folder)
    names = [r.file for r in files.collect()]
    assert len(names) == 9 and all(r.weight > 0 for r in files.collect())
    one = files.withColumn("weight", F.lit(1))
    turns = lambda: epochs.epoch_files(spark, one, seed=5, epochs=2, most=2)
    whole = run_epochs(spark, tmp_path / "a", turns())
    by_epoch = {e: [x for _, epoch, xs in whole if epoch == e for x in xs] for e in (0, 1)}
    want = {f"{i}-{k}" for i in range(9) for k in range(3)}
    assert set(by_epoch[0]) == set(by_epoch[1]) == want and len(by_epoch[0]) == len(by_epoch[1]) == 27
    assert by_epoch[0] != by_epoch[1]
    for e in (0, 1):
        key = lambda f, e=e: hashlib.md5(f"{5 + e}:{f}".encode()).hexdigest()
        order = [name.rsplit("/", 1)[1].split(".")[0] for name in sorted(names, key=key)]
        taken = [sorted({x.split("-")[0] for x in xs}) for _, epoch, xs in whole if epoch == e]
        assert taken == [sorted(order[at : at + 2]) for at in range(0, 9, 2)]
    # Stopped in the middle and resumed: the same micro-batches, each once (the one at the stop may be repeated).
    first = run_epochs(spark, tmp_path / "b", turns(), most_batches=3)
    rest = run_epochs(spark, tmp_path / "b", turns())
    joined = dict((m, (m, e, xs)) for m, e, xs in first + rest)
    assert [joined[m] for m in sorted(joined)] == whole and rest[0][0] <= first[-1][0] + 1


def test_micro_batches_stay_within_their_weight(spark, tmp_path):
    """Admission by tokens per file, counted by the caller; a file beyond the bound comes alone."""
    folder = folder_of(tmp_path)
    files = epochs.list_files(spark, folder)
    number = F.regexp_extract("file", r"(\d+)\.jsonl$", 1).cast("long")
    weighted = files.withColumn("weight", F.when(number == 7, 100).otherwise(number))
    seen = run_epochs(spark, tmp_path / "c", epochs.epoch_files(spark, weighted, seed=1, epochs=1, most=10))
    weights = [sum(100 if f == "7" else int(f) for f in {x.split("-")[0] for x in xs}) for _, _, xs in seen]
    assert sum(weights) == 100 + sum(i for i in range(9) if i != 7)
    assert all(w <= 10 or w == 100 for w in weights) and 100 in weights


def test_no_files_and_endless_epochs(spark, tmp_path):
    empty = spark.createDataFrame([], "file string, weight long")
    reader = epochs.Turns({"files": "[]", "seed": "1", "epochs": "0", "most": "5"})
    assert reader.read(reader.initialOffset())[1] == {"epoch": 0, "file": 0} and list(reader.read({"epoch": 0, "file": 0})[0]) == []
    assert epochs.epoch_files(spark, empty).isStreaming
    reader = epochs.Turns({"files": json.dumps([["a", 1], ["b", 1], ["c", 1]]), "seed": "1", "epochs": "0", "most": "2"})
    at, rows = reader.initialOffset(), []
    for _ in range(8):
        more, to = reader.read(at)
        more = list(more)
        assert more == list(reader.readBetweenOffsets(at, to))
        at, rows = to, rows + more
    assert at == {"epoch": 4, "file": 0} and [r[:2] for r in rows] == [(e, p) for e in range(4) for p in range(3)]
    assert list(reader.readBetweenOffsets({"epoch": 0, "file": 1}, {"epoch": 2, "file": 1})) == rows[1:7]


def test_bytes_per_trigger(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(8):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"arrival": i, "id": i, "input_ids": [1] * 50}) for _ in range(5)))
    size = (folder / "0.json").stat().st_size
    sizes = []
    stream = stream_records(spark, str(folder), SCHEMA, glob="*.json", bytes_per_trigger=3 * size + 10)
    query = stream.writeStream.foreachBatch(lambda rows, n: sizes.append(rows.select("arrival").distinct().count())).option("checkpointLocation", str(tmp_path / "o"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == 8 and max(sizes) == 3


def test_graceful_stop_finishes_the_batch_and_leaves_end_rows(spark, tmp_path):
    rows = examples(21, 120)
    folder, sink, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    for lo in range(0, 120, 30):
        write(spark, folder, rows, lo, lo + 30)
    marker = Marker(spark, str(tmp_path / "stop"))
    gate, begun = Gate(), threading.Event()
    source = lambda: stream_records(spark, folder, SCHEMA, 1, glob="*.json")

    class Telling(Gate):
        def through(self, work):
            inner = super().through(work)

            def told(rows, micro):
                begun.set()
                inner(rows, micro)

            return told

    gate = Telling()
    query = packing.pack_stream(source(), sink, offsets, L, B, gate=gate, merge_every=2)
    begun.wait(60)
    assert not marker.present()
    marker.put()  # asked for while a micro-batch is at work
    ends = packing.stop_packing(spark, query, gate, marker, sink, poll=0.02)
    done = gate.finished
    assert not query.isActive and 0 <= done < 3
    assert {r.micro for r in ends.collect()} == {done} and not any(r.input_ended for r in ends.collect())
    seen = 30 * (done + 1)
    assert ends.agg({"examples": "sum"}).first()[0] == seen
    got = lambda: sorted((r.shard, r.chunk_id, r.num_instruction, r.input_ids, r.labels) for r in packing.packed_blocks(spark, sink, L, B).collect())
    assert got() == expected(rows[:seen])
    marker.clear()
    gate = Gate()
    ends = packing.stop_packing(spark, packing.pack_stream(source(), sink, offsets, L, B, gate=gate, merge_every=2), gate, marker, sink, poll=0.05)
    assert {(r.micro, r.input_ended) for r in ends.collect()} == {(3, True)} and packing.ended(spark, sink).count() == 3
    assert got() == expected(rows)


def test_micro_folders_are_merged(spark, tmp_path):
    rows = examples(22, 90)
    folder, sink, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    for lo in range(0, 90, 10):
        write(spark, folder, rows, lo, lo + 10)
    packing.pack_stream(stream_records(spark, folder, SCHEMA, 1, glob="*.json"), sink, offsets, L, B, noise_seed=4, merge_every=4).awaitTermination()
    kept = sorted(p.name for p in (tmp_path / "out" / "batches").iterdir() if p.is_dir())
    assert kept == ["micro=7", "micro=8"]
    assert sorted(p.name for p in (tmp_path / "out" / "merged").iterdir() if p.is_dir()) == ["until=3", "until=7"]
    got = sorted((r.shard, r.chunk_id, r.num_instruction, r.input_ids, r.labels) for r in packing.packed_blocks(spark, sink, L, B).collect())
    assert got == expected(rows)
    assert packing.noised_blocks(spark, sink).count() == len(got)
    assert packing.merge_micro(spark, sink) == 8 and packing.merge_micro(spark, sink) == 8
    assert packing.packed_blocks(spark, sink, L, B).count() == len(got)
    assert packing.counters(spark, sink).agg({"examples": "sum"}).first()[0] == 90


def test_keyed_state_equals_the_batch_form_after_a_restart(spark, tmp_path):
    rows = examples(23, 140)
    folder, sink, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        for lo, hi in ((0, 40), (40, 41), (41, 140)):
            write(spark, folder, rows, lo, hi)
            source = stream_records(spark, folder, SCHEMA, 1, glob="*.json")
            keyed.pack_keyed_stream(source, sink, offsets, L, B).awaitTermination()
        got = sorted((r.shard, r.chunk_id, r.num_instruction, r.input_ids, r.labels) for r in spark.read.parquet(sink).collect())
        assert got == expected(rows)
        # Lanes: each is a packing of its own.
        source = stream_records(spark, folder, SCHEMA, 1, glob="*.json")
        keyed.pack_keyed_stream(source, f"{sink}2", f"{offsets}2", L, B, lanes=2).awaitTermination()
        lanes = spark.read.parquet(f"{sink}2").collect()
        assert {r.lane for r in lanes} == {0, 1} and all(len(r.input_ids) == L for r in lanes)
        for lane in (0, 1):
            part = [(i, ids if a % 2 == lane else None, p) for a, (i, ids, p) in enumerate(rows)]
            want = [(s, c, t, x) for s, c, _, t, x in expected(part)]
            assert sorted((r.shard, r.chunk_id, r.input_ids, r.labels) for r in lanes if r.lane == lane) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_counter_tells_every_so_many_items(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(7):
        (tmp_path / "in" / f"{i}.json").write_text("".join('{"arrival": 1, "input_ids": [1, 2]}\n' for _ in range(5)))
    told = []
    counter = count_items(spark, lambda name, records, tokens: told.append((records, tokens)), every=10, name="seen")
    try:
        stream = observed(stream_records(spark, str(tmp_path / "in"), SCHEMA, 1, glob="*.json"), name="seen")
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if sum(t[0] for t in counter.totals.values()) == 35:
                break
            threading.Event().wait(0.1)
    finally:
        spark.streams.removeListener(counter)
    assert told == [(10, 20), (20, 40), (30, 60)] and list(counter.totals.values()) == [(35, 70)]
