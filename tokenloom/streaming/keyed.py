"""Packing of a record stream with keyed state: each shard's open batch and counters lie in the state store."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tokenloom.constants import BATCH_SIZE, IGNORE_LABEL, MAX_LENGTH
from tokenloom.operators.packing import record_defaults

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "ids array<bigint>, labels array<bigint>, next_batch bigint, examples bigint"
BLOCKS = "shard int, lane int, batch_id bigint, chunk_id bigint, num_instruction bigint, input_ids array<bigint>, labels array<bigint>"
NAMES = [c.split(" ")[0] for c in BLOCKS.split(", ")]
TOTALS = "examples bigint, tokens bigint"
#: Tokens that are put together at a time, about.
HELD = 1 << 20


class ShardPacker(StatefulProcessor):
    """State of a (shard, lane): ids and labels of its unfinished batch, the number of the next batch, how many examples
    came since the last one; and, apart from them, counters of all examples and tokens."""

    def __init__(self, max_length: int, batch_size: int) -> None:
        self.max_length, self.batch_size = max_length, batch_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", STATE)
        self.totals = handle.getValueState("totals", TOTALS)

    def handleInputRows(self, key, rows, timerValues):
        shard, lane = key
        frames = list(rows)
        order = np.argsort(np.concatenate([f["arrival"].to_numpy() for f in frames]), kind="stable")
        # Ids stay where they came, in Arrow's buffers; only HELD tokens at a time are put together.
        examples = [x for f in frames for x in f["input_ids"]]
        prompts = np.concatenate([f["prompt_length"].to_numpy() for f in frames])
        sizes = np.array([len(examples[k]) for k in order], dtype=np.int64)
        held_ids, held_labels, batch, seen = self.open.get() if self.open.exists() else ([], [], 0, 0)
        self.ids, self.labels = np.asarray(held_ids, dtype=np.int64), np.asarray(held_labels, dtype=np.int64)
        self.batch, self.seen, made = batch, seen, False
        part = np.cumsum(sizes) // HELD
        for at in np.split(np.arange(len(order)), np.flatnonzero(np.diff(part)) + 1):
            out = self.pack(shard, lane, [examples[k] for k in order[at]], prompts[order[at]])
            if len(out):
                made = True
                yield out
        self.open.update((self.ids.tolist(), self.labels.tolist(), self.batch, self.seen))
        before = self.totals.get() if self.totals.exists() else (0, 0)
        self.totals.update((before[0] + len(order), before[1] + int(sizes.sum())))
        if not made:
            yield pd.DataFrame([], columns=NAMES)

    def pack(self, shard: int, lane: int, examples: list, prompts: np.ndarray) -> pd.DataFrame:
        """The blocks that the next examples complete; the rest stays open."""
        examples = [np.asarray(x, dtype=np.int64) for x in examples]
        labels = [np.where(np.arange(len(x)) < p, IGNORE_LABEL, x) for x, p in zip(examples, prompts, strict=True)]
        ids, labels = np.concatenate([self.ids, *examples]), np.concatenate([self.labels, *labels])
        ends = len(self.ids) + np.cumsum([len(x) for x in examples])
        span, length, batch = self.max_length * self.batch_size, self.max_length, self.batch
        full = len(ids) // span
        # The example that fills a batch is the last one counted for it.
        done = np.searchsorted(ends, span * np.arange(1, full + 1)) + 1
        counts = np.diff(np.concatenate([[-self.seen], done]))
        out = [
            (shard, lane, batch + b, (batch + b) * self.batch_size + s, int(counts[b]), ids[at : at + length], labels[at : at + length])
            for b in range(full)
            for s, at in enumerate(range(b * span, (b + 1) * span, length))
        ]
        self.seen = len(examples) - int(done[-1]) if full else self.seen + len(examples)
        self.ids, self.labels, self.batch = ids[full * span :].copy(), labels[full * span :].copy(), batch + full
        return pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def pack_keyed(stream: DataFrame, max_length: int = MAX_LENGTH, batch_size: int = BATCH_SIZE, lanes: int = 1) -> DataFrame:
    """Stream of the complete blocks of `arrival, shard, input_ids, prompt_length`, for any sink in append mode.

    Per (shard, lane) the state holds less than one batch of tokens. With several `lanes` the arrivals of every shard are
    dealt over as many packings with numbers of their own, so that a hot shard fills several tasks; with one, the
    blocks are those of `pack_stream`. Records arrive in the order of `arrival` from one micro-batch to the next, and those
    of one micro-batch, which the source must bound, are sorted: a task holds a shard's ids of one micro-batch once, and
    all other memory is bounded. Missing ids are empty, a missing prompt length is 0.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = record_defaults(stream).select("shard", F.pmod("arrival", F.lit(lanes)).cast("int").alias("lane"), "arrival", "input_ids", "prompt_length")
    return rows.groupBy("shard", "lane").transformWithStateInPandas(
        statefulProcessor=ShardPacker(max_length, batch_size), outputStructType=BLOCKS, outputMode="Append", timeMode="None"
    )


def pack_keyed_stream(stream: DataFrame, sink: str, checkpoint: str, max_length: int = MAX_LENGTH, batch_size: int = BATCH_SIZE, lanes: int = 1, trigger: dict | None = None) -> StreamingQuery:
    """Start `pack_keyed` into Parquet files below `sink`. The number of shuffle partitions of the first run stays."""
    blocks = pack_keyed(stream, max_length, batch_size, lanes)
    writer = blocks.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(sink)
