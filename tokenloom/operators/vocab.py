"""Frequency-ranked vocabularies and the encoding and decoding that use them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tokenloom.constants import UNKNOWN_ID, VOCAB_SIZE
from tokenloom.functions.slices import list_slices
from tokenloom.functions.text import tokens
from tokenloom.operators.prefix import number_rows

# Counts up to this one form rank levels of their own; larger counts share a level per power of 2.
EXACT_COUNTS = 64


def build_vocab(df: DataFrame, text: str = "text", max_vocab: int = VOCAB_SIZE) -> DataFrame:
    """`token, n, token_id`: the `max_vocab` most frequent tokens, ids 1.. by (count desc, token).

    Counting combines before its shuffle, so frequent tokens do not skew it. Ranks come from numbering in levels:
    a bucket is a count level and the first two characters, the next level joins second characters, the last one
    first characters. The one window without a key is over the count levels, at most 128 rows of any corpus.
    """
    counts = (
        df.select(F.explode(tokens(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    level = F.when(F.col("n") <= EXACT_COUNTS, F.col("n")).otherwise(
        F.lit(EXACT_COUNTS) + F.floor(F.log2("n"))
    )
    split = F.col("n") <= EXACT_COUNTS
    first = F.when(split, F.ascii("token")).otherwise(F.lit(0))
    second = F.when(split, F.ascii(F.substring("token", 2, 1))).otherwise(F.lit(0))
    falling = F.lit(2 * EXACT_COUNTS) - level.cast("bigint")
    # Characters are below 2^21, and their order is that of the tokens' bytes.
    bucket = (falling * F.lit(1 << 21) + first) * F.lit(1 << 21) + second
    order = [F.desc("n"), F.asc("token")]
    ranked = number_rows(
        counts.withColumn("bucket", bucket), [], ["bucket"], order, "token_id", limit=max_vocab, coarser=[1 << 21, 1 << 21]
    )
    return ranked.select("token", "n", "token_id")


def fetched(vocab: DataFrame, max_vocab: int) -> pa.Table:
    """Fetch a whole vocabulary of at most `max_vocab` tokens; a larger one is an error, never cut."""
    words = vocab.select("token", "token_id").limit(max_vocab + 1).toArrow()
    if len(words) > max_vocab:
        raise ValueError(f"the vocabulary has more than max_vocab = {max_vocab} tokens; pass its size")
    return words


class Lookup:
    """Values by key, as one hash table that is built when a task first asks and used for all its batches."""

    def __init__(self, known: pa.Array, values: pa.Array, default) -> None:
        self.known, self.values, self.default, self.index = known, values, default, None

    def lists(self, lists: pa.ListArray) -> pa.ListArray:
        """Replace every list element by its value, or by the default."""
        if self.index is None:
            self.index = pd.Index(self.known.to_pandas())
        coded = lists.flatten().dictionary_encode()
        place = self.index.get_indexer(coded.dictionary.to_pandas())
        found = self.values.take(pa.array(np.where(place < 0, 0, place), mask=place < 0))
        filled = pc.fill_null(found, pa.scalar(self.default, self.values.type)).take(coded.indices)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), filled)


def vocab_length(text: Column) -> Column:
    """How many ids `vocab_encode` gives a text: it cuts the text in the same way."""
    return F.coalesce(F.size(tokens(text)), F.lit(0))


def vocab_encode(
    df: DataFrame, text: str, vocab: DataFrame, out: str = "input_ids", max_vocab: int = VOCAB_SIZE
) -> DataFrame:
    """Replace `text` by `out`: its tokens by vocabulary id, 0 for unknown ones.

    The vocabulary is fetched whole, like a fitted model, and goes out with the tasks; one of more than
    `max_vocab` tokens raises. Rows are encoded where they are; neither texts nor tokens are exchanged. Pass a
    staged vocabulary when it is used more than once: it is computed here.
    """
    words = fetched(vocab, max_vocab)
    table = Lookup(
        words["token"].combine_chunks().cast(pa.string()), words["token_id"].combine_chunks().cast(pa.int64()), UNKNOWN_ID
    )

    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in list_slices(batch, "_tokens"):
                coded = table.lists(part.column("_tokens"))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], coded], names=[*kept, out])

    split = df.select(*kept, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("_tokens"))
    return split.mapInArrow(run, df.select(*kept).schema.add(out, T.ArrayType(T.LongType())))


def decode(
    df: DataFrame,
    vocab: DataFrame,
    ids: str = "input_ids",
    out: str = "text",
    special: dict[int, str] | None = None,
    skip_special: bool = False,
    unknown: str = "<unk>",
    max_vocab: int = VOCAB_SIZE,
) -> DataFrame:
    """Replace `ids` by `out`: text with tokens separated by single spaces; also without an exchange."""
    special = special or {}
    words = fetched(vocab, max_vocab)
    shown = {} if skip_special else special
    known = pa.concat_arrays([words["token_id"].combine_chunks().cast(pa.int64()), pa.array(shown, pa.int64())])
    names = pa.concat_arrays(
        [words["token"].combine_chunks().cast(pa.string()), pa.array(shown.values(), pa.string())]
    )
    table = Lookup(known, names, unknown)
    kept = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in list_slices(batch, "_ids"):
                text = pc.binary_join(table.lists(part.column("_ids")), " ")
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], text], names=[*kept, out])

    column = F.col(ids).cast("array<bigint>")
    if special and skip_special:
        column = F.filter(column, lambda x: ~x.isin(*special))
    rows = df.select(*kept, F.coalesce(column, F.array().cast("array<bigint>")).alias("_ids"))
    return rows.mapInArrow(run, df.select(*kept).schema.add(out, T.StringType()))
