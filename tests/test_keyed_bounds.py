"""What a task of the keyed stream holds is bounded."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tokenloom.queries import streams
from tokenloom.streaming import keyed


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    def getValueState(self, name, schema):
        return Value()


def test_blocks_leave_in_bounded_frames(monkeypatch):
    rng = np.random.default_rng(4)
    arrays = [rng.integers(1, 900, n) for n in rng.integers(0, 40, 300)]
    frame = pd.DataFrame({"arrival": range(300), "input_ids": arrays, "prompt_length": rng.integers(0, 30, 300)})
    mixed = frame.sample(frac=1, random_state=1)
    made = []
    for held in (64, 1 << 20):
        monkeypatch.setattr(keyed, "HELD", held, raising=False)
        packer = keyed.ShardPacker(8, 2)
        packer.init(Handle())
        frames = [f for part in (mixed[mixed.arrival < 170], mixed[mixed.arrival >= 170]) for f in packer.handleInputRows((1, 0), iter([part[:50], part[50:]]), None)]
        made.append([(r.batch_id, r.chunk_id, r.num_instruction, list(r.input_ids), list(r.labels)) for f in frames for r in f.itertuples()])
        if held == 64:
            assert len(frames) > 20 and max(len(f) for f in frames) * 8 <= 64 + 2 * 40 + 16
        total = sum(map(len, arrays))
        assert packer.totals.get() == (300, total) and len(packer.open.get()[0]) == total % 16
    assert made[0] == made[1]
    assert [x for r in made[0] for x in r[3]] == np.concatenate(arrays)[: len(made[0]) * 8].tolist()


def test_waves_keep_their_size(spark, sf_dir):
    schema = streams.SCHEMA
    few, many = (spark.read.schema(schema).option("recursiveFileLookup", True).json(f).withColumn("wave", F.regexp_extract(F.input_file_name(), r"/(\d+)/[^/]*$", 1).cast("int")) for f in (streams.stream_folder(spark, sf_dir), streams.stream_folder(spark, sf_dir, wave_tokens=9000)))
    assert few.drop("wave").exceptAll(many.drop("wave")).count() == 0 and few.count() == many.count()
    sizes = many.groupBy("wave").agg(F.sum(F.size("input_ids")).alias("n"), F.min("arrival").alias("low"), F.max("arrival").alias("high")).orderBy("wave").collect()
    assert few.select("wave").distinct().count() == 4 < len(sizes)
    assert all(x.high < y.low for x, y in zip(sizes, sizes[1:]))
