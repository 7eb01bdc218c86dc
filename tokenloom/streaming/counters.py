"""Counters of a stream as it runs: what it has taken in, told every so many items."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "tokenloom-counters"
EVERY = 200


def observed(stream: DataFrame, tokens: str = "input_ids", name: str = NAME) -> DataFrame:
    """The stream, observed: the job that processes a micro-batch also counts its records and tokens."""
    return stream.observe(name, F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.greatest(F.size(tokens), F.lit(0))), F.lit(0)).cast("bigint").alias("tokens"))


class ItemCounter(StreamingQueryListener):
    """Calls `tell(query name, records, tokens)` with running totals each time another `every` records have been taken
    in (a micro-batch that passes several such marks tells each, with the totals at its end). Micro-batches count once,
    by number, also when a restart reports one again."""

    def __init__(self, tell: Callable[[str, int, int], None], every: int = EVERY, name: str = NAME) -> None:
        self.tell, self.every, self.name = tell, every, name
        self.totals: dict[str, tuple[int, int]] = {}
        self.seen: dict[str, int] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = progress.observedMetrics.get(self.name)
        if found is None:
            return
        key = str(progress.id)
        with self.lock:
            if progress.batchId <= self.seen.get(key, -1):
                return
            self.seen[key] = progress.batchId
            records, tokens = self.totals.get(key, (0, 0))
            self.totals[key] = now = (records + found.records, tokens + found.tokens)
            marks = now[0] // self.every - records // self.every
        for _ in range(marks):
            self.tell(progress.name or key, *now)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def count_items(spark: SparkSession, tell: Callable[[str, int, int], None], every: int = EVERY, name: str = NAME) -> ItemCounter:
    """Register a counter; `spark.streams.removeListener` takes it away."""
    counter = ItemCounter(tell, every, name)
    spark.streams.addListener(counter)
    return counter
