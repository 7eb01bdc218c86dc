"""Endless epochs over record files as a stream.

A Python data source deals out files, not rows: each micro-batch names the next files of the current epoch, in an order
that is new for every epoch, and Spark's own readers then read them wherever they lie. The offset is (epoch, file), so a
restart goes on with the file after the last one that was finished.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from tokenloom.constants import SEED
from tokenloom.operators.buffer import BUFFER_ROWS, shuffle_buffer
from tokenloom.sources.records import RAW_SCHEMA

FORMAT = "tokenloom_file_turns"


class Turns(SimpleDataSourceStreamReader):
    """Reader of `FileTurns`; it holds the list of files, as a file index does."""

    def __init__(self, options: dict) -> None:
        self.files = [(str(f), int(w)) for f, w in json.loads(options["files"])]
        self.seed, self.epochs, self.most = int(options["seed"]), int(options["epochs"]), int(options["most"])
        self.known: tuple[int, list] = (-1, [])

    def order(self, epoch: int) -> list[tuple[str, int]]:
        if self.known[0] != epoch:
            key = lambda f: hashlib.md5(f"{self.seed + epoch}:{f[0]}".encode()).hexdigest()
            self.known = epoch, sorted(self.files, key=lambda f: (key(f), f))
        return self.known[1]

    def initialOffset(self) -> dict:
        return {"epoch": 0, "file": 0}

    def read(self, start: dict) -> tuple:
        epoch, low = start["epoch"], start["file"]
        if not self.files or 0 < self.epochs <= epoch:
            return iter([]), start
        files, high, weight = self.order(epoch), low, 0
        while high < len(files) and (high == low or weight + files[high][1] <= self.most):
            weight, high = weight + files[high][1], high + 1
        end = {"epoch": epoch, "file": high} if high < len(files) else {"epoch": epoch + 1, "file": 0}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict):
        rows = []
        for epoch in range(start["epoch"], end["epoch"] + 1):
            files = self.order(epoch) if self.files else []
            low = start["file"] if epoch == start["epoch"] else 0
            high = end["file"] if epoch == end["epoch"] else len(files)
            rows += [(epoch, place, *files[place]) for place in range(low, high)]
        return iter(rows)


class FileTurns(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "epoch int, place bigint, file string, weight bigint"

    def simpleStreamReader(self, schema: T.StructType) -> Turns:
        return Turns(self.options)


def list_files(spark: SparkSession, path: str, glob: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """(file, weight): the files below `path` with their sizes in bytes. No content is read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    reader = reader.option("recursiveFileLookup", True) if recursive else reader
    return reader.load(path).select(F.col("path").alias("file"), F.col("length").alias("weight"))


def epoch_files(spark: SparkSession, files: DataFrame, seed: int = SEED, epochs: int | None = None, most: int = 1 << 30) -> DataFrame:
    """Stream of `epoch, place, file, weight`: every file once per epoch, in an order hashed from seed + epoch and the name.

    A micro-batch takes files of one epoch while their weights (bytes, or tokens where the caller counts them) stay within
    `most`, and one at least. `epochs` ends the stream; without it, it goes on for ever. The driver holds the names
    of the files, as any reader of files does.
    """
    spark.dataSource.register(FileTurns)
    listed = json.dumps([[r.file, r.weight or 0] for r in files.select("file", "weight").collect()])
    reader = spark.readStream.format(FORMAT).option("files", listed)
    return reader.option("seed", str(seed)).option("epochs", str(epochs or 0)).option("most", str(most)).load()


def stream_epochs(
    turns: DataFrame,
    take: Callable[[DataFrame, int, int], None],
    checkpoint: str,
    schema: T.StructType | str = RAW_SCHEMA,
    seed: int = SEED,
    buffer_rows: int = BUFFER_ROWS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Call `take(records, epoch, micro)` for every micro-batch of `epoch_files`, with the records of its files in the order
    of a shuffle buffer seeded by seed + epoch (none with `buffer_rows` of 0). A repeated micro-batch gives the
    same records in the same order."""

    def work(rows: DataFrame, micro: int) -> None:
        spark, by_epoch = rows.sparkSession, {}
        for r in rows.collect():  # as many files as one micro-batch takes
            by_epoch.setdefault(r.epoch, []).append((r.place, r.file))
        for epoch, files in sorted(by_epoch.items()):
            records = spark.read.schema(schema).json([f for _, f in sorted(files)])
            take(shuffle_buffer(records, buffer_rows, seed + epoch) if buffer_rows else records, epoch, micro)

    writer = turns.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "0 seconds"})).start()
