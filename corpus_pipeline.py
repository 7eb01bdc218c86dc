"""From raw documents to packed training windows: rate, deduplicate, remove secrets, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenloom.llm import neardup, packs, quality, secrets
from tokenloom.sources.workspace import discard, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose top grade (good and not toxic) is less likely than not; the model is fitted on the graded
    documents among them, and without any keeps all it has no reason to reject. A null text is rated as an empty one,
    repeated rows are kept or rejected alike, an empty table stays empty, and columns beyond those of documents are left out,
    also where they are named like one that is worked out here."""
    rows = docs.select(*COLUMNS)
    model = quality.train(rows, quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(rows, model).where("keep").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one of the least id, one row of it if it is repeated. Null and
    empty texts are copies of one another; an empty table stays empty."""
    return neardup.classify(docs.select(*COLUMNS)).where("keep").select(*COLUMNS)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, widely copied examples and live-looking ones by
    different words. `n_chars` follows the text; texts without a secret, null ones too, are left as they are."""
    found = secrets.scan(docs.select(*COLUMNS))
    clean = found.withColumn("clean", secrets.redact(F.col("text"), F.col("spans")))
    length = F.when(F.size("spans") > 0, F.char_length("clean").cast("bigint")).otherwise(F.col("n_chars"))
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", length.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed windows, with their token ids. Repeated rows are packed each, a null or empty text
    is its closing id alone, and an empty table gives no rows."""
    return packs.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", keep_one_of_each),
    ("secret_scan", remove_secrets),
    ("packing", pack),
]
#: A classifier, consistent sampling and a tokenizer are not SQL; tests compare the run with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each on a stage table of the one before; a stage's table goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
