"""Cut sorted examples into blocks in one pass over Arrow batches.

A task gets runs of consecutive examples of a stream, in order, each with its place. It carries the open ids and
labels along and emits batches as they fill. A run ends with the few examples, of the run after it, that complete its
last batch, so no batch has to be put together from two tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tokenloom.constants import IGNORE_LABEL
from tokenloom.functions.slices import list_slices

#: Tokens that a run holds before it emits what is complete.
HELD = 1 << 20
INPUT = ["epoch", "shard", "bucket", "cell", "cell_start", "cell_rows", "own", "n_tokens", "input_ids", "prompt_length"]
SCHEMA = "epoch int, shard int, batch_id bigint, chunk_id bigint, num_instruction bigint, input_ids array<bigint>, labels array<bigint>"


class Run:
    """One run of a stream. It emits the batches that begin right after one of its own tokens (the first batch: with its
    first token), so it always knows the example that ended the batch before."""

    def __init__(self, epoch: int, shard: int, max_length: int, batch_size: int) -> None:
        self.epoch, self.shard, self.max_length, self.batch_size = epoch, shard, max_length, batch_size
        self.span = max_length * batch_size
        self.ids: list[np.ndarray] = []
        self.labels: list[np.ndarray] = []
        self.at, self.size, self.own_end, self.next = 0, 0, 0, None
        self.starts, self.ordinals = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.cell, self.cell_tokens, self.cell_rows = None, 0, 0

    def add(self, rows: pa.RecordBatch) -> None:
        column = lambda name: rows.column(name).to_numpy(zero_copy_only=False)
        cell, n = column("cell"), column("n_tokens")
        before, place = np.cumsum(n) - n, np.arange(len(n))
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))
        start = column("cell_start") + before - before[first][group]
        ordinal = column("cell_rows") + 1 + place - first[group]
        if cell[0] == self.cell:
            start[group == 0] += self.cell_tokens
            ordinal[group == 0] += self.cell_rows
        else:
            self.cell_tokens = self.cell_rows = 0
        if len(first) > 1:
            self.cell_tokens = self.cell_rows = 0
        self.cell = cell[-1]
        self.cell_tokens += int(n[first[-1] :].sum())
        self.cell_rows += len(n) - int(first[-1])
        some = np.flatnonzero(n > 0)
        if not len(some):
            return
        if self.next is None:
            self.at = int(start[some[0]])
            self.next = self.at // self.span + 1 if self.at else 0
        own = some[column("own")[some]]
        if len(own):
            self.own_end = int(start[own[-1]] + n[own[-1]])
        ids = rows.column("input_ids").flatten().to_numpy()
        inside = np.arange(len(ids)) - np.repeat(before, n)
        self.ids.append(ids)
        self.labels.append(np.where(inside < np.repeat(column("prompt_length"), n), IGNORE_LABEL, ids))
        self.size += len(ids)
        self.starts, self.ordinals = np.append(self.starts, start[some]), np.append(self.ordinals, ordinal[some])

    def emit(self, tail: bool = False) -> Iterator[pa.RecordBatch]:
        """The batches that are complete, and with `tail` the incomplete last one."""
        if self.next is None:
            return
        end = self.at + self.size
        stop = min(self.own_end // self.span, end // self.span - 1) + 1
        rest = tail and self.next <= self.own_end // self.span and max(stop, self.next) * self.span < min(end, self.own_end + 1)
        ids, labels = np.concatenate(self.ids), np.concatenate(self.labels)
        if stop > self.next:
            yield self.blocks(ids, labels, self.next, stop)
            self.next = stop
        if rest:
            yield self.blocks(ids, labels, self.next, self.next + 1)
        used = min(max(self.next * self.span - self.at, 0), self.size)
        self.ids, self.labels, self.at, self.size = [ids[used:]], [labels[used:]], self.at + used, self.size - used
        known = max(int(np.searchsorted(self.starts, self.next * self.span)) - 1, 0)
        self.starts, self.ordinals = self.starts[known:], self.ordinals[known:]

    def blocks(self, ids: np.ndarray, labels: np.ndarray, low: int, high: int) -> pa.RecordBatch:
        """Batches low to high - 1 as blocks; the last block of an incomplete batch may be short."""
        done = np.searchsorted(self.starts, np.arange(low, high + 1) * self.span) - 1
        last = np.where(done >= 0, self.ordinals[done], 0)
        first, stop = low * self.span - self.at, min(high * self.span - self.at, self.size)
        cuts = np.append(np.arange(0, stop - first, self.max_length), stop - first)
        chunk = low * self.batch_size + np.arange(len(cuts) - 1)
        batch = chunk // self.batch_size
        lists = lambda x: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[first:stop], pa.int64()))
        same = lambda x: pa.array(np.full(len(chunk), x), pa.int32())
        columns = [same(self.epoch), same(self.shard), pa.array(batch, pa.int64()), pa.array(chunk, pa.int64()), pa.array(np.diff(last)[batch - low], pa.int64()), lists(ids), lists(labels)]
        return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in SCHEMA.split(", ")])


def cutter(max_length: int, batch_size: int, drop_tail: bool) -> Callable:
    """Function for `mapInArrow` over rows of INPUT, sorted by run and place."""

    def work(batches):
        run, now = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("epoch", "shard", "bucket")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                key = tuple(int(k) for k in keys[:, low])
                if key != now:
                    if run:
                        yield from run.emit(not drop_tail)
                    run, now = Run(key[0], key[1], max_length, batch_size), key
                for part in list_slices(batch.slice(low, high - low), "input_ids"):
                    run.add(part)
                    if run.size >= HELD:
                        yield from run.emit()
        if run:
            yield from run.emit(not drop_tail)

    return work
