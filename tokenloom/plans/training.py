"""Raw instruction records to noised training blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tokenloom.constants import BATCH_SIZE, MAX_LENGTH, SEED
from tokenloom.functions.text import HashEncoder
from tokenloom.operators.noising import noise
from tokenloom.operators.order import assign_shards, order_epochs
from tokenloom.operators.packing import pack, with_token_count
from tokenloom.operators.prepare import tokenize
from tokenloom.sources.workspace import stage


def training_blocks(
    raw: DataFrame,
    max_length: int = MAX_LENGTH,
    batch_size: int = BATCH_SIZE,
    record_length: int = MAX_LENGTH,
    epochs: int = 1,
    world_size: int = 1,
    seed: int = SEED,
    encoder: HashEncoder = HashEncoder(),
    staged: bool = True,
    tokenizer: Callable[[DataFrame, int], DataFrame] | None = None,
    max_steps: int | None = None,
    accumulation: int = 1,
) -> DataFrame:
    """Prepare, pack and noise. With `max_steps` the number of epochs follows from the staged token total: enough for
    that many optimizer steps of `accumulation` batches on every consumer.

    `tokenizer` turns (raw records, length limit) into token records in place of hashing: a partial application of
    `tokenize_with_vocab` or `tokenize_with`, for example.

    The tokenized records are written once as a stage table: the pass that totals buckets then reads
    two small columns, texts are encoded once, and a lost executor costs no re-encoding.
    """
    made = tokenizer(raw, record_length) if tokenizer else tokenize(raw, encoder, record_length)
    records = with_token_count(made.drop("token_count"))
    if staged:
        records = stage(records, "tokenized")
    if max_steps is not None:
        total = max(1, records.agg(F.sum("n_tokens")).first()[0] or 1)
        epochs = max(1, -(-max_steps * accumulation * batch_size * max_length * world_size // total))
    ordered = assign_shards(order_epochs(records, seed, epochs), world_size, epochs)
    return noise(pack(ordered, max_length, batch_size, streams=epochs * world_size), seed)
