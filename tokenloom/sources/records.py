"""Readers and writers for instruction records, tokenized records, blocks and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tokenloom.operators.prefix import number_rows, running_totals
from tokenloom.sources.workspace import stage

RAW_SCHEMA = T.StructType(
    [
        T.StructField("instruction", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
    ]
)
#: Copies of repeated records whose numbers are broadcast (16 bytes each).
MOST_COPIES = 1 << 20
TOKENIZED_SCHEMA = T.StructType(
    [
        T.StructField("input_ids", T.ArrayType(T.LongType())),
        T.StructField("prompt_length", T.IntegerType()),
    ]
)


def read_records(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_SCHEMA,
    recursive: bool = True,
    glob: str = "*.jsonl",
    mode: str = "FAILFAST",
) -> DataFrame:
    """JSON-lines files below `path` as one table.

    `recursive` takes every nested folder; otherwise only the files directly in `path` are read. A `path` that is
    a file is read under any name; `glob` picks files in folders only. The schema is given, so no inference pass
    runs; fields missing from a record are null. A broken line is an error unless `mode` says otherwise
    ("DROPMALFORMED" leaves it out, "PERMISSIVE" makes it a record of nulls, `split_records` keeps it in a table
    of its own). A schema without `id` gets one by `with_record_ids`.
    """
    reader = spark.read.schema(schema).option("mode", mode)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if not is_file(spark, path):
        reader = reader.option("pathGlobFilter", glob)
    table = reader.json(path)
    return table if "id" in schema.fieldNames() else with_record_ids(table)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether the file system holds a file, not a folder or a pattern, at `path`."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and files.getFileStatus(place).isFile()


def with_record_ids(table: DataFrame) -> DataFrame:
    """Add `id`, a 64-bit hash of a record's content and of its number among equal records.

    Ids follow from what the files hold, whatever their number, order and splits. The records are parsed once, into a
    stage table, and stay where they are: hashes alone are exchanged to find records that occur more than once, and
    only their copies are numbered, in two levels, so many copies of one record do not meet in one task. A
    table of copies of at most MOST_COPIES rows is broadcast to the records; a larger one is joined by row.
    """
    content = F.to_json(F.struct(*table.columns))
    hashed = table.withColumns({"_content": F.xxhash64(content), "_again": F.xxhash64(F.lit("again"), content), "_row": F.monotonically_increasing_id()})
    return numbered_records(stage(hashed, "records"))


def numbered_records(staged: DataFrame) -> DataFrame:
    same = ["_content", "_again"]
    hashes = staged.select(*same, "_row")
    repeated = hashes.groupBy(*same).count().where("count > 1").drop("count")
    again = hashes.join(repeated, same, "left_semi").withColumn("_part", F.shiftright("_row", 33))
    copies = stage(number_rows(again, same, ["_part"], ["_row"], "_copy").where("_copy > 1").select("_row", "_copy"), "copies")
    copies = F.broadcast(copies) if copies.count() <= MOST_COPIES else copies
    numbered = staged.join(copies, "_row", "left")
    return numbered.withColumn("id", F.xxhash64(*same, F.coalesce("_copy", F.lit(1).cast("bigint")))).drop(*same, "_row", "_copy")


def split_records(
    spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, recursive: bool = True, glob: str = "*.jsonl"
) -> tuple[DataFrame, DataFrame]:
    """(records, broken): the records of all lines that fit the schema, as `read_records` gives them, and the lines that do
    not as `file, offset, line`, where `offset` is the byte at which the line starts.

    Lines are parsed once, into a stage table that both results read. Offsets are running sums over line lengths, per split and
    over the splits of a file, only for files that hold a broken line. Blank lines are neither.
    """
    reader = spark.read.option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if not is_file(spark, path):
        reader = reader.option("pathGlobFilter", glob)
    parsed = F.from_json("value", T.StructType([*schema.fields, T.StructField("_broken", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    fields = [F.col(f"_record.{f}").alias(f) for f in schema.fieldNames()]
    content = F.to_json(F.struct(*schema.fieldNames()))
    staged = (
        lines.withColumns({"_record": parsed, "_size": F.octet_length("value") + 1, "_row": F.monotonically_increasing_id()})
        .select(*fields, "_record._broken", F.trim(F.col("value")) == "", "_file", "_block", "_size", "_row")
        .toDF(*schema.fieldNames(), "_broken", "_blank", "_file", "_block", "_size", "_row")
        .withColumns({"_content": F.xxhash64(content), "_again": F.xxhash64(F.lit("again"), content)})
    )
    staged = stage(staged, "lines")
    good = staged.where("_broken is null and not _blank").drop("_broken", "_blank", "_file", "_block", "_size")
    records = good.drop("_content", "_again", "_row") if "id" in schema.fieldNames() else numbered_records(good)
    faults = staged.where("_broken is not null and not _blank").select("_file", "_block", "_row", F.col("_broken").alias("line"))
    sizes = staged.select("_file", "_block", "_row", "_size").join(faults.select("_file").distinct(), "_file", "left_semi")
    placed = running_totals(sizes, ["_file"], ["_block"], ["_row"], {"end": F.col("_size").cast("bigint")})
    broken = faults.join(placed, ["_file", "_block", "_row"]).select(F.col("_file").alias("file"), (F.col("end") - F.col("_size")).alias("offset"), "line")
    return records, broken


def stream_records(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    files_per_trigger: int | None = 1,
    glob: str = "*.jsonl",
    bytes_per_trigger: int | None = None,
) -> DataFrame:
    """The same files as a stream. What one micro-batch takes in is bounded by `bytes_per_trigger` if given (files whose
    sizes stay within it, and one at least), else by `files_per_trigger`. A bound by tokens: `streaming.epochs`."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    elif files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def write_tokenized(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Tokenized records as a folder of JSON lines (UTF-8, non-ASCII kept) or Parquet parts."""
    df.drop("token_count").write.mode(mode).format(fmt).save(path)


def write_blocks(
    df: DataFrame, path: str, mode: str = "errorifexists", rebalance: bool = False
) -> None:
    """Finished blocks, one folder per epoch and shard, so that each consumer reads only its own.

    Each file is in block order. Packed blocks give about one file per key bucket. `rebalance` exchanges
    them once more by folder, where Spark merges small and splits large partitions: for many folders with
    little data each.
    """
    rows = df.hint("rebalance", "epoch", "shard") if rebalance else df
    ordered = rows.sortWithinPartitions("epoch", "shard", "chunk_id")
    ordered.write.mode(mode).partitionBy("epoch", "shard").parquet(path)


def write_samples(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Evaluation samples as JSON lines, one folder per task."""
    df.write.mode(mode).partitionBy("task").json(path)
