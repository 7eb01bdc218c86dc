"""Hand-over of finished batches to training ranks: runs are committed by a manifest, and a rank seeks and resumes in it.

A part is K (`batches_per_file`) batches of one rank: part P has batches P * K to P * K + K - 1. Layout below one path:
`data/run=R/epoch=E/shard=S/part=P` holds part P, and from the 16th part of a rank on its neighbours too, in one file, in order (see
`file_part`); `manifest/run=R` lists the parts of a run with their files and batch ranges. A run counts from the moment its
manifest is there, so data of a job that died are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokenloom.operators.cutter import SCHEMA

FILES = "run string, epoch int, shard int, file string, first_batch bigint, last_batch bigint, blocks bigint, batches_per_file bigint"
#: Files of a rank that hold equally many parts, before the next ones hold twice as many.
SAME_SIZE = 16
#: Batches up to which files of several parts grow.
MOST_BATCHES = 1024
#: Rows of a Parquet page, so that a reader skips the pages before a batch inside a file.
PAGE_ROWS = 64


def file_part(batches_per_file: int) -> Column:
    """First part in the file of a batch. A rank's first 16 files hold one part each, the next 16 two, then four, and so on
    up to MOST_BATCHES batches, so that a long run has few files and a short one can be sought part by part. It follows from
    `batch_id` alone: nothing is counted before the blocks are dealt."""
    steps = max(1, MOST_BATCHES // batches_per_file).bit_length() - 1
    part = f"(batch_id div {batches_per_file})"
    width = f"shiftleft(1L, least(length(bin(greatest({part}, 0L) div {SAME_SIZE} + 1)) - 1, {steps}))"
    return F.expr(f"{part} - ({part} - {SAME_SIZE} * ({width} - 1)) % {width}")


def hand_over(blocks: DataFrame, path: str, run: str | None = None, batches_per_file: int = 64) -> str:
    """Write `epoch, shard, batch_id, chunk_id, ...` as a run and commit it; returns the run's name.

    `batches_per_file` batches make a part: what the manifest lists, a rank seeks, and `batches` holds. Short runs have
    a file per part, in longer ones files hold several. One exchange brings the batches of a file together. Writing a run
    again under its name replaces it, manifest last; its readers see the old files as missing, not as other data.
    """
    run = run or uuid.uuid4().hex
    spark, folder = blocks.sparkSession, f"{path}/data/run={run}"
    parts = blocks.withColumn("part", file_part(batches_per_file))
    dealt = parts.repartition("epoch", "shard", "part").sortWithinPartitions("epoch", "shard", "part", "batch_id", "chunk_id")
    writer = dealt.write.mode("overwrite").partitionBy("epoch", "shard", "part").option("parquet.page.row.count.limit", PAGE_ROWS)
    writer.parquet(folder)
    # One narrow pass over what was written: the manifest says what is there.
    written = spark.read.schema(blocks.select("epoch", "shard", "batch_id").schema).option("recursiveFileLookup", False).parquet(folder)
    unit = F.expr(f"batch_id div {batches_per_file}").alias("unit")
    listed = written.groupBy("epoch", "shard", F.col("_metadata.file_path").alias("file"), unit).agg(
        F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"), F.count("*").alias("blocks")
    )
    listed = listed.drop("unit")
    relative = F.concat(F.lit("data/run="), F.lit(run), F.regexp_extract("file", r"(/epoch=[^/]*/shard=[^/]*/part=[^/]*/[^/]*)$", 1))
    listed = listed.withColumn("file", relative).withColumn("batches_per_file", F.lit(batches_per_file).cast("bigint"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/run={run}")
    return run


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Parts of all committed runs, by file: `run, epoch, shard, file, first_batch, last_batch, blocks, batches_per_file`."""
    return spark.read.schema(FILES).parquet(f"{path}/manifest")


def parts_from(spark: SparkSession, path: str, epoch: int, shard: int, from_batch: int = 0, run: str | None = None) -> DataFrame:
    """The manifest of a rank, as far as it holds batches from `from_batch` on."""
    rows = manifest(spark, path).where((F.col("epoch") == epoch) & (F.col("shard") == shard) & (F.col("last_batch") >= from_batch))
    return rows if run is None else rows.where(F.col("run") == run)


def files_from(spark: SparkSession, path: str, epoch: int, shard: int, from_batch: int = 0, run: str | None = None) -> list[str]:
    """A rank's files, in batch order, that hold batches from `from_batch` on."""
    rows = parts_from(spark, path, epoch, shard, from_batch, run).groupBy("file").agg(F.min("first_batch").alias("first_batch"))
    return [f"{path}/{r.file}" for r in rows.orderBy("first_batch", "file").collect()]


def read_from(spark: SparkSession, path: str, epoch: int, shard: int, from_batch: int = 0, run: str | None = None) -> DataFrame:
    """The blocks of a rank from a batch on, whole files before it unread. An unknown rank gives no rows."""
    files = files_from(spark, path, epoch, shard, from_batch, run)
    if not files:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.option("basePath", f"{path}/data").parquet(*files).where(F.col("batch_id") >= from_batch).drop("run", "part")


def batches(spark: SparkSession, path: str, epoch: int, shard: int, from_batch: int = 0, run: str | None = None) -> Iterator[tuple[int, pa.Table]]:
    """(batch_id, its blocks) in order, for a consumer of one rank. The driver holds one part's batches at a time."""
    for part in parts_from(spark, path, epoch, shard, from_batch, run).orderBy("first_batch", "file").collect():
        wanted = F.col("batch_id").between(max(from_batch, part.first_batch), part.last_batch)
        rows = spark.read.parquet(f"{path}/{part.file}").where(wanted).toArrow().sort_by([("batch_id", "ascending"), ("chunk_id", "ascending")])
        ids = rows.column("batch_id").to_numpy()
        at = 0
        while at < len(ids):
            end = at + int((ids[at:] == ids[at]).sum())
            yield int(ids[at]), rows.slice(at, end - at)
            at = end
