"""Prompt assembly, token batches and response cutting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tokenloom.constants import EOS_IDS, PAD_ID, SEED, STOP_TEXT
from tokenloom.functions.draws import hash32
from tokenloom.functions.ids import is_eos, keep_last, non_pad_mask
from tokenloom.functions.text import cut_at_terms
from tokenloom.operators.order import key_bucket, key_digits
from tokenloom.operators.prefix import number_rows
from tokenloom.sources.workspace import stage


@dataclass(frozen=True)
class ChatTemplate:
    """Text around each message and the header that asks for an answer."""

    before_role: str = "<|start_header_id|>"
    after_role: str = "<|end_header_id|>\n\n"
    after_text: str = STOP_TEXT
    answer_role: str = "assistant"


def drop_role(df: DataFrame, role: str = "system", drop: bool = True) -> DataFrame:
    """Leave out one role's messages, for templates that refuse them; a message without a role stays."""
    return df.where(~F.col("role").eqNullSafe(role)) if drop else df


def render_chat(
    df: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    add_generation_prompt: bool = True,
    drop_system: bool = False,
) -> DataFrame:
    """`conv_id, prompt`: the messages of each conversation in turn order as one text.

    With `add_generation_prompt` the answer header follows the last message; without it the last
    message is left open, so that it can be continued. A missing role is an empty one.
    """
    message = F.concat(
        F.lit(template.before_role), F.coalesce("role", F.lit("")), F.lit(template.after_role), F.trim(F.coalesce("text", F.lit("")))
    )
    rendered = drop_role(df, drop=drop_system).select("conv_id", F.struct("turn", message.alias("m")).alias("s"))
    ordered = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    body = F.array_join(F.transform("s", lambda s: s["m"]), template.after_text)
    tail = (
        template.after_text + template.before_role + template.answer_role + template.after_role
        if add_generation_prompt
        else ""
    )
    return ordered.select("conv_id", F.concat(body, F.lit(tail)).alias("prompt"))


def as_question(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """One text as the user's message, with the header that asks for an answer."""
    return F.concat(
        F.lit(template.before_role + "user" + template.after_role), F.trim(F.coalesce(text, F.lit(""))),
        F.lit(template.after_text + template.before_role + template.answer_role + template.after_role),
    )


def add_bos(df: DataFrame, bos: str, column: str = "prompt") -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(bos), column))


def few_shot(
    items: DataFrame,
    exemplars: DataFrame,
    k: int,
    seed: int = SEED,
    separator: str = "\n\n",
) -> DataFrame:
    """`item_id, context`: k seeded exemplars in front of each item's context.

    `items` has `item_id, context`; `exemplars` has `exemplar_id, example`. The exemplars are
    numbered in hashed order and each item draws one from each of k equal ranges of that order, so
    the draws differ from one another and reach their exemplars by an equi-join on the number; no
    item meets the whole pool. An item never draws itself (same id) while its range offers another.
    A pool of fewer than k exemplars gives every range that is not empty.

    The numbered pool is a stage table, as three steps read it. A small pool is copied under salts until it has rows for
    every task, so its texts don't meet all items in a few tasks.
    """
    digits = key_digits(exemplars)
    keyed = exemplars.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(str(seed)), "exemplar_id")))
    keyed = keyed.withColumn("key_bucket", key_bucket("order_key", digits))
    numbered = number_rows(keyed, [], ["key_bucket"], ["order_key"])
    pool = stage(numbered.select((F.col("ordinal") - 1).alias("slot"), "exemplar_id", "example"), "exemplars")
    size = pool.count()
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-4 * tasks // max(size, 1)))
    draws = (
        items.select("item_id", F.lit(size).cast("bigint").alias("pool"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("shot"))
        .withColumns({"low": F.expr(f"shot * pool div {k}"), "high": F.expr(f"(shot + 1) * pool div {k}")})
        .where(F.col("high") > F.col("low"))
    )
    drawn = draws.select(
        "item_id",
        "shot",
        "low",
        (F.col("high") - F.col("low")).alias("width"),
        hash32(seed, F.col("item_id"), F.col("shot")).alias("word"),
    ).withColumn("offset", F.col("word") % F.col("width"))
    # The exemplar that is the item itself: its slot says which range must step aside.
    own = pool.select(F.col("exemplar_id").alias("item_id"), F.col("slot").alias("own_slot"))
    slots = drawn.join(own, "item_id", "left").select(
        "item_id",
        "shot",
        (
            F.col("low")
            + F.when(F.col("low") + F.col("offset") == F.col("own_slot"), (F.col("offset") + 1) % F.col("width"))
            .otherwise(F.col("offset"))
        ).alias("slot"),
        F.pmod(F.xxhash64("item_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    copies = pool.select("slot", "example", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    chosen = slots.join(copies, ["slot", "salt"]).groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("shot", "example"))).alias("shots")
    )
    return items.join(chosen, "item_id", "left").select(
        "item_id",
        F.concat(
            F.coalesce(
                F.array_join(F.transform("shots", lambda s: F.concat(s["example"], F.lit(separator))), ""),
                F.lit(""),
            ),
            "context",
        ).alias("context"),
    )


def left_truncate(df: DataFrame, n: int, ids: str = "input_ids") -> DataFrame:
    """Keep the last n ids of every row."""
    return df.withColumn(ids, keep_last(F.col(ids), n))


def left_pad(df: DataFrame, pad_id: int = PAD_ID, ids: str = "input_ids") -> DataFrame:
    """Pad on the left to the longest row of the batch; adds `attention_mask`."""
    width = F.max(F.size(ids)).over(Window.partitionBy("batch_id"))
    sized = df.withColumn("_pad", width - F.size(ids))
    return sized.withColumns(
        {
            ids: F.concat(F.array_repeat(F.lit(pad_id).cast("bigint"), F.col("_pad")), F.col(ids)),
            "attention_mask": F.concat(
                F.array_repeat(F.lit(0), F.col("_pad")), F.array_repeat(F.lit(1), F.size(ids))
            ),
        }
    ).drop("_pad")


def pad_mask(df: DataFrame, pad_id: int = PAD_ID, ids: str = "input_ids") -> DataFrame:
    """Add `attention_mask` computed from the ids alone: 1 wherever the id is not the pad id."""
    return df.withColumn("attention_mask", non_pad_mask(F.col(ids), pad_id))


def split_until(until: Column) -> Column:
    """A single string of stop terms is a space-separated list."""
    return F.split(until, " ")


def cut_at_stop(
    df: DataFrame,
    until: Column,
    eos_text: str,
    response: str = "response",
    escape_until: bool = False,
) -> DataFrame:
    """Cut every response at the first end-of-text, `until` or end-of-turn term."""
    if escape_until:
        return df
    terms = F.concat(F.array(F.lit(eos_text)), until, F.array(F.lit(STOP_TEXT)))
    return df.withColumn(response, cut_at_terms(F.col(response), terms))


def cut_at_eos(
    df: DataFrame,
    block_length: int,
    gen_length: int,
    eos_ids: Sequence[int] = EOS_IDS,
    ids: str = "input_ids",
) -> DataFrame:
    """End a generation with the first block that holds an end-of-text id.

    Adds `blocks_used`, `kept_ids` (whole blocks) and `content_length` (ids before the first end).
    """
    most = (gen_length // block_length) * block_length
    held = F.slice(ids, 1, most)
    hit = F.array_position(F.transform(held, lambda x: is_eos(x, eos_ids)), True)
    size = F.size(held)
    used = F.ceil(F.when(hit > 0, hit).otherwise(size) / block_length).cast("int")
    return df.withColumns(
        {
            "blocks_used": used,
            "kept_ids": F.slice(ids, F.lit(1), F.least(used * block_length, F.lit(most))),
            "content_length": F.when(hit > 0, hit - 1).otherwise(size).cast("int"),
        }
    )


def join_responses(requests: DataFrame, responses: DataFrame, key: str = "item_id") -> DataFrame:
    """Put responses produced elsewhere back beside their request."""
    return requests.join(responses, key, "left")
