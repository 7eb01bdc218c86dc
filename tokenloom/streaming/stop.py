"""Graceful end of a stream: a marker asks for it, the micro-batch at work is finished, and end rows say so."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


class Marker:
    """A file whose presence asks a stream to stop, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self) -> None:
        self.files.create(self.path, True).close()

    def clear(self) -> None:
        self.files.delete(self.path, False)

    def present(self) -> bool:
        return self.files.exists(self.path)


DRAINED = "the stream is drained; this micro-batch is left to the run that resumes"


class Gate:
    """Between micro-batches. `through` wraps a `foreachBatch` function: it lets one micro-batch work at a time and, once
    the gate is shut, none. `drained` shuts it after the micro-batch at work."""

    def __init__(self) -> None:
        self.lock, self.shut, self.finished = threading.Lock(), False, -1

    def through(self, work: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def guarded(rows: DataFrame, micro: int) -> None:
            with self.lock:
                if self.shut:
                    raise RuntimeError(DRAINED)
                work(rows, micro)
                self.finished = micro

        return guarded

    def drained(self, query: StreamingQuery, wait: float = 60.0) -> int:
        """Stop the query when the micro-batch at work is finished and recorded as such; the last finished number."""
        with self.lock:
            self.shut = True
        pause = threading.Event()
        for _ in range(int(wait / 0.05)):
            last = query.lastProgress
            if not query.isActive or self.finished < 0 or last and last["batchId"] >= self.finished:
                break
            pause.wait(0.05)
        query.stop()
        return self.finished


def run_until(query: StreamingQuery, gate: Gate, marker: Marker, poll: float = 1.0, seconds: float | None = None) -> bool:
    """Wait until the query ends by itself (False) or the marker is there, or `seconds` are over, and drain it (True)."""
    pause, waited = threading.Event(), 0.0
    while query.isActive:
        if marker.present() or seconds is not None and waited >= seconds:
            gate.drained(query)
            return True
        pause.wait(poll)
        waited += poll
    if (fault := query.exception()) is not None and DRAINED not in str(fault):
        raise fault
    return gate.shut


def write_end(counters: DataFrame, sink: str, micro: int, complete: bool) -> None:
    """End rows, one per shard: its counters, the last micro-batch, and whether the input had ended too."""
    rows = counters.withColumns({"micro": F.lit(micro), "input_ended": F.lit(complete)})
    rows.coalesce(1).write.mode("overwrite").parquet(f"{sink}/end/{micro}")


def end_rows(spark: SparkSession, sink: str, micro: int) -> DataFrame | None:
    """The end rows of a stream that stopped after micro-batch `micro`; None while it runs, or after a resumed run has
    gone on beyond the stop."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/end/{micro}/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{sink}/end/{micro}") if found else None
