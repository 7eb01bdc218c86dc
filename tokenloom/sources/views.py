"""Token-data views of the analytics tables: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenloom.constants import IGNORE_LABEL
from tokenloom.functions.text import HashEncoder, clean
from tokenloom.operators.order import number_batches
from tokenloom.sources.workspace import spread


# Token records at the edges of the format.
EDGES = """
SELECT id, CAST(input_ids AS array<bigint>) AS input_ids, CAST(prompt_length AS int) AS prompt_length FROM VALUES
  (-1L, array(), 0), (-2L, NULL, 3), (-3L, array(11, 12, 126081), 8), (-4L, array(13, 14, 126348), NULL), (-5L, NULL, NULL)
  AS t(id, input_ids, prompt_length)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def instruction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per assistant turn: the turn before it, the system text if any, the answer."""
    turns = chat(spark, sf_dir)
    answers = turns.where("role = 'assistant'").select(
        "conv_id", "turn", (F.col("turn") - 1).alias("asked"), F.col("text").alias("output")
    )
    questions = turns.select("conv_id", F.col("turn").alias("asked"), F.col("text").alias("instruction"))
    # One row per conversation, also where it has several system messages.
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.max("text").alias("input"))
    return (
        answers.join(questions, ["conv_id", "asked"], "left")
        .join(system, "conv_id", "left")
        .select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "instruction", "input", "output")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return spread(texts, "id")


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: first line, no input, the rest."""
    first = F.substring_index("text", "\n", 1)
    return documents(spark, sf_dir).select(
        "id",
        first.alias("instruction"),
        F.lit(None).cast("string").alias("input"),
        F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)").alias("output"),
    )


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token records with both end-of-text ids, and the edge cases of the format as rows of their own
    (negative ids): empty and missing ids, prompt lengths missing or beyond the end."""
    encoder = HashEncoder()
    end = F.when(F.col("id") % 97 == 0, F.lit(126348)).otherwise(F.lit(126081)).cast("bigint")
    ids = F.concat(encoder.encode(F.concat(clean("instruction"), clean("output"))), F.array(end))
    prompt = encoder.count(clean("instruction"))
    encoded = document_records(spark, sf_dir).select("id", ids.alias("input_ids"), prompt.cast("int").alias("prompt_length"))
    return encoded.unionByName(spark.sql(EDGES))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 8").alias("seq_id"),
        (F.col("vec_id") % 8).cast("int").alias("pos"),
        F.transform("embedding", lambda x: x.cast("double") * 40).alias("logits"),
        F.when(F.col("vec_id") % 3 == 0, F.lit(IGNORE_LABEL)).otherwise(F.col("label")).cast("bigint").alias("label"),
        (F.col("vec_id") % 4 == 0).alias("filled"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).cast("int").alias("rank"),
        F.expr("event_id div 16").alias("batch_id"),
        F.col("event_id").alias("step"),
        (F.floor("value") + 1).cast("bigint").alias("tokens"),
        (F.lit(1) + F.col("event_id") % 5).alias("calls"),
        (F.col("value") / 100).alias("seconds"),
    )


def frontier_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seq_id"),
        F.col("event_id").alias("step"),
        (F.lit(1) + F.col("event_id") % 32).alias("frontier"),
    )


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("context"))


def numbered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses by row number from 0, so that every evaluation item has the one of its number."""
    numbered = number_batches(answers(spark, sf_dir), 1)
    return numbered.select(F.col("batch_id").alias("item_id"), "response")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant texts as responses; a third start with a stop term, a third hold an end marker."""
    said = chat(spark, sf_dir).where("role = 'assistant'")
    key = F.col("conv_id") * 100 + F.col("turn")
    text = (
        F.when(key % 3 == 0, F.concat(F.lit("."), "text"))
        .when(key % 3 == 1, F.regexp_replace("text", " ", "<|endoftext|>"))
        .otherwise(F.col("text"))
    )
    return said.select(key.alias("item_id"), text.alias("response"))
