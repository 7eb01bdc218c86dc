"""Reproducible random draws from hashed keys: equal for every partition layout and retry."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

WORD = 4294967295
SCALE = 4294967296.0


def hash32(*parts: Column | int | str) -> Column:
    """Unsigned 32-bit number from the md5 of the parts joined by colons."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    key = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def unit(*parts: Column | int | str) -> Column:
    """Uniform draw in [0, 1) per key."""
    return hash32(*parts) / F.lit(SCALE)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`.

    A value named inside a lambda over an array would otherwise be computed for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def _fold(x: Column) -> Column:
    return F.shiftrightunsigned(x, 16).bitwiseXOR(x)


def position_words(seed_word: Column, array: Column) -> Column:
    """One unsigned 32-bit word per element of `array`: integer mixing of the seed and position.

    The chain of `transform`s keeps every step linear. The caller folds once more with
    `final_word`, so that the last step fuses with its use.
    """

    def mix(x: Column) -> Column:
        return (_fold(x) * F.lit(73244475)).bitwiseAND(F.lit(WORD))

    start = bind(
        seed_word,
        lambda seed: F.transform(
            array,
            lambda _, i: (seed + i.cast("bigint") * F.lit(2654435769)).bitwiseAND(F.lit(WORD)),
        ),
    )
    return F.transform(F.transform(start, mix), mix)


def final_word(x: Column) -> Column:
    return _fold(x)


def position_draws(seed_words: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The same draws as `final_word` over `position_words`, in [0, 1), for flat arrays."""
    x = (seed_words.astype(np.int64) + positions.astype(np.int64) * 2654435769) & WORD
    for _ in range(2):
        x = ((x >> 16 ^ x) * 73244475) & WORD
    return (x >> 16 ^ x) / SCALE
