"""Approximate shuffle of a stream of rows through a buffer of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tokenloom.constants import SEED

BUFFER_ROWS = 10_000


def shuffle_buffer(df: DataFrame, size: int = BUFFER_ROWS, seed: int = SEED) -> DataFrame:
    """The rows of every task in the order of a shuffle buffer: once `size` rows are held, each further row takes the place
    of one drawn by (seed, task), which is given out; at the end the rest follows in a drawn order.

    A task holds `size` rows and one Arrow batch. Nothing is exchanged, so a row stays near its place in its files; a
    full shuffle is `order_epochs`. A repeated task gives the same order. On a stream each micro-batch drains its buffers.
    """
    if size < 1:
        raise ValueError("size must be 1 or more")

    def work(batches):
        draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            slots = list(range(held.num_rows if held is not None else 0))
            first = len(slots)
            free = min(size - first, rows.num_rows - first)
            slots += range(first, first + free)
            out = []
            for row, u in enumerate(draw.random(rows.num_rows - first - free), first + free):
                at = int(u * size)
                out.append(slots[at])
                slots[at] = row
            if out:
                yield from rows.take(out).combine_chunks().to_batches()
            held = rows.take(slots)
        if held is not None and held.num_rows:
            yield from held.take(np.argsort(draw.random(held.num_rows), kind="stable")).combine_chunks().to_batches()

    return df.mapInArrow(work, df.schema)
