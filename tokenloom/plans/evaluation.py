"""Evaluation items to cut responses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tokenloom.constants import END_OF_TEXT, PAD_ID, SEED
from tokenloom.functions.text import HashEncoder
from tokenloom.operators.hooks import generate, generate_logged
from tokenloom.operators.order import number_batches
from tokenloom.operators.prompts import ChatTemplate, add_bos, as_question, cut_at_stop, few_shot, left_pad, left_truncate, split_until
from tokenloom.sources.workspace import stage


def padded_batches(
    items: DataFrame,
    batch_size: int,
    max_prompt: int | None = None,
    bos: str = "",
    encoder: HashEncoder = HashEncoder(),
    pad_id: int = PAD_ID,
    tokenizer: Callable[[list[str]], list[list[int]]] | None = None,
) -> DataFrame:
    """Encode `item_id, context`, keep the last `max_prompt` ids (all, when not given) and pad per batch. A `tokenizer`
    of the user's own gets the texts of an Arrow batch and takes the encoder's place; a missing text is empty."""
    prompts = add_bos(items, bos, "context") if bos else items
    encoded = encode_with(prompts, tokenizer) if tokenizer else prompts.withColumn("input_ids", encoder.encode(F.col("context")))
    kept = encoded if max_prompt is None else left_truncate(encoded, max_prompt)
    return left_pad(number_batches(kept, batch_size), pad_id)


def encode_with(items: DataFrame, tokenizer: Callable[[list[str]], list[list[int]]], text: str = "context") -> DataFrame:
    """Add `input_ids`, encoded by the user's tokenizer where the rows are."""

    @F.arrow_udf("array<bigint>")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([list(ids) for ids in tokenizer(pc.fill_null(texts, "").to_pylist())], pa.list_(pa.int64()))

    return items.withColumn("input_ids", encode(F.col(text)))


def assemble(
    requests: DataFrame, exemplars: DataFrame | None = None, shots: int = 0, template: ChatTemplate | None = None, seed: int = SEED
) -> DataFrame:
    """`item_id, context`: the prompt of each request (`item_id, text`), with `shots` exemplars in front where given, and
    rendered as the user's message of a chat with a template."""
    items = requests.select("item_id", F.col("text").alias("context"))
    if exemplars is not None and shots > 0:
        items = few_shot(items, exemplars, shots, seed)
    return items.withColumn("context", as_question(F.col("context"), template)) if template else items


def evaluate(
    requests: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    batch_size: int,
    max_prompt: int | None = None,
    bos: str = "",
    world_size: int = 1,
    eos_text: str = END_OF_TEXT,
    encoder: HashEncoder = HashEncoder(),
    tokenizer: Callable[[list[str]], list[list[int]]] | None = None,
    exemplars: DataFrame | None = None,
    shots: int = 0,
    template: ChatTemplate | None = None,
) -> tuple[DataFrame, DataFrame]:
    """From requests (`item_id, text` and, if given, `until`) to samples and the run log.

    Prompts are put together by `assemble` (few-shot exemplars, chat template), get the BOS text in front, and are encoded by
    the `tokenizer` or else by the encoder. `until` is a list of stop terms per request or one text of them separated by spaces. Samples are `item_id,
    response`, each cut at its own terms. The log has `rank, batch_id, step, tokens, calls, seconds` as `throughput`
    takes it; batches go to ranks in turn. The function's output is staged, so it runs once for both.
    """
    prompts = assemble(requests, exemplars, shots, template)
    padded = padded_batches(prompts, batch_size, max_prompt, bos, encoder, tokenizer=tokenizer)
    made = stage(generate_logged(padded, fn), "responses")
    samples = made.select("item_id", "response")
    terms = F.array().cast("array<string>")
    if "until" in requests.columns:
        own = F.col("until") if dict(requests.dtypes)["until"].startswith("array") else split_until(F.col("until"))
        samples = samples.join(requests.select("item_id", own.alias("until")), "item_id")
        terms = F.coalesce("until", terms)
    samples = cut_at_stop(samples, terms, eos_text).select("item_id", "response")
    sums = made.groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in ("tokens", "calls", "seconds")])
    log = sums.select(
        F.pmod("batch_id", F.lit(world_size)).cast("int").alias("rank"), "batch_id", F.col("batch_id").alias("step"),
        "tokens", "calls", "seconds",
    )
    return samples, log


def responses(
    padded: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    until: Column,
    eos_text: str = END_OF_TEXT,
) -> DataFrame:
    """Run the inference function on every batch and cut what it returns (`item_id, response`)."""
    return cut_at_stop(generate(padded, fn, "item_id bigint, response string"), until, eos_text)
