"""Text column expressions: field cleaning, tokenizing, hash encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tokenloom.constants import VOCAB_SIZE

# Fixed value: one token is a run of letters, digits and underscores, or one other visible sign.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def clean(col: str | Column) -> Column:
    """Null text becomes the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


@dataclass(frozen=True)
class HashEncoder:
    """Token ids 1..vocab_size from a CRC-32 of the token: no vocabulary pass, no shuffle."""

    vocab_size: int = VOCAB_SIZE

    def token_id(self, token: Column) -> Column:
        return F.lit(1) + F.crc32(token.cast("binary")) % F.lit(self.vocab_size)

    def encode(self, text: Column) -> Column:
        return F.transform(tokens(text), self.token_id)

    def count(self, text: Column) -> Column:
        return F.size(tokens(text))


def cut_at_terms(text: Column, terms: Column) -> Column:
    """Keep what stands before the first hit of any non-empty term."""
    return F.aggregate(
        F.filter(terms, lambda t: t != ""),
        text,
        lambda s, t: F.call_function("substring_index", s, t, F.lit(1)),
    )


def coerce_text(text: Column) -> Column:
    """Typed reading of a text value: true/false become a flag, text holding `e` or `.` a number.

    Returns struct<flag boolean, number double, text string> with exactly one field set.
    """
    number = F.when(
        (F.contains(text, F.lit("e")) | F.contains(text, F.lit(".")))
        & text.rlike(r"^\s*[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?\s*$"),
        F.trim(F.replace(text, F.lit("_"), F.lit(""))).try_cast("double"),
    )
    flag = F.when(F.lower(text) == "true", F.lit(True)).when(F.lower(text) == "false", F.lit(False))
    return F.struct(
        flag.alias("flag"),
        F.when(flag.isNull(), number).alias("number"),
        F.when(flag.isNull() & number.isNull(), text).alias("text"),
    )
