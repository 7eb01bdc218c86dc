"""Instruction records to token records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from tokenloom.constants import END_OF_TEXT, END_OF_TEXT_ID, MAX_LENGTH, VOCAB_SIZE
from tokenloom.functions.text import HashEncoder, clean
from tokenloom.operators.vocab import vocab_encode, vocab_length


def compose(df: DataFrame, end_text: str = END_OF_TEXT) -> DataFrame:
    """Add `text` (instruction, input, output and end marker) and `prompt` (instruction, input)."""
    return df.withColumns(
        {
            "text": F.concat(clean("instruction"), clean("input"), clean("output"), F.lit(end_text)),
            "prompt": F.concat(clean("instruction"), clean("input")),
        }
    )


def encode_record(encoder: HashEncoder, text: Column, end_id: int, max_length: int) -> Column:
    """Ids of the whole text and the end id, truncated to `max_length`."""
    whole = F.concat(encoder.encode(text), F.array(F.lit(end_id).cast("bigint")))
    return F.slice(whole, 1, max_length)


def drop_overlong(ids: Column, max_length: int) -> Column:
    """One-row generator: the ids, or no row when they fill `max_length`.

    A generator keeps the value encoded below it; a `where` would be pushed below the projection and
    encode every text twice. Encode in a projection of its own: generators are not compiled.
    """
    return F.explode(F.filter(F.array(ids), lambda a: F.size(a) < max_length))


def tokenize(
    df: DataFrame,
    encoder: HashEncoder = HashEncoder(),
    max_length: int = MAX_LENGTH,
    end_id: int = END_OF_TEXT_ID,
    observation: Observation | None = None,
) -> DataFrame:
    """`id, input_ids, prompt_length, token_count` of the records shorter than `max_length`.

    The prompt is encoded on its own and only for records that stay. With an `observation` the
    number of records and tokens is gathered by the job that writes the result.
    """
    text = F.concat(clean("instruction"), clean("input"), clean("output"))
    prompt = F.concat(clean("instruction"), clean("input"))
    encoded = df.select(
        "id", prompt.alias("prompt"), encode_record(encoder, text, end_id, max_length).alias("encoded")
    )
    return _finish(encoded, encoder.count(F.col("prompt")), max_length, observation)


def tokenize_with_vocab(
    df: DataFrame,
    vocab: DataFrame,
    max_length: int = MAX_LENGTH,
    end_id: int = END_OF_TEXT_ID,
    max_vocab: int = VOCAB_SIZE,
    observation: Observation | None = None,
) -> DataFrame:
    """The same records with the ids of a vocabulary (see `build_vocab`) instead of hashed ones."""
    composed = compose(df, end_text="").select("id", "prompt", "text")
    coded = vocab_encode(composed, "text", vocab, "encoded", max_vocab)
    ended = F.concat("encoded", F.array(F.lit(end_id).cast("bigint")))
    truncated = coded.withColumn("encoded", F.slice(ended, 1, max_length))
    return _finish(truncated, vocab_length(F.col("prompt")), max_length, observation)


def tokenize_with(
    df: DataFrame,
    encode: Callable[[list[str]], list[list[int]]],
    max_length: int = MAX_LENGTH,
    end_id: int = END_OF_TEXT_ID,
    observation: Observation | None = None,
) -> DataFrame:
    """The same records with the ids of a user's tokenizer, which also counts the prompts' tokens. `encode` takes
    the texts of an Arrow batch and runs where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [list(ids) for ids in encode(batch.column("text").to_pylist())]
            asked = [len(ids) for ids in encode(batch.column("prompt").to_pylist())]
            columns = [batch.column("id"), pa.array(whole, pa.list_(pa.int64())), pa.array(asked, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "encoded", "asked"])

    composed = compose(df, end_text="").select("id", "prompt", "text")
    schema = T.StructType(
        [composed.schema["id"], T.StructField("encoded", T.ArrayType(T.LongType())), T.StructField("asked", T.IntegerType())]
    )
    coded = composed.mapInArrow(run, schema)
    ended = F.slice(F.concat("encoded", F.array(F.lit(end_id).cast("bigint"))), 1, max_length)
    return _finish(coded.withColumn("encoded", ended), F.col("asked"), max_length, observation)


def _finish(
    encoded: DataFrame, asked: Column, max_length: int, observation: Observation | None
) -> DataFrame:
    """Drop overlong records, then count the tokens of the prompts that are left."""
    rest = [c for c in encoded.columns if c not in ("id", "encoded")]
    kept = encoded.select("id", *rest, drop_overlong(F.col("encoded"), max_length).alias("input_ids"))
    out = kept.select(
        "id",
        "input_ids",
        F.least(asked, F.lit(max_length)).alias("prompt_length"),
        F.size("input_ids").alias("token_count"),
    )
    if observation is not None:
        out = out.observe(
            observation,
            F.count(F.lit(1)).alias("records"),
            F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"),
        )
    return out


def token_totals(tokenized: DataFrame) -> DataFrame:
    """Records, tokens and tokens in billions."""
    return tokenized.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(F.sum("token_count"), F.lit(0)) / 1e9, 6).alias("billions"),
    )


def global_batch(
    tokenized: DataFrame, local_batch: int, accumulation: int, world_size: int, max_length: int
) -> DataFrame:
    """Global batch size, tokens per step and steps one epoch gives."""
    blocks = local_batch * accumulation * world_size
    return token_totals(tokenized).select(
        F.lit(blocks).alias("global_batch_size"),
        F.lit(blocks * max_length).cast("bigint").alias("tokens_per_step"),
        F.expr(f"total_tokens div {blocks * max_length}").alias("steps_per_epoch"),
        "total_tokens",
    )
