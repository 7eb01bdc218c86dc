"""Column expressions over arrays of token ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tokenloom.constants import EOS_IDS, IGNORE_LABEL, MASK_ID


def labels_for(ids: Column, prompt_length: Column) -> Column:
    """Copy of the ids with the prompt part (clamped to the array) set to the ignore label."""
    hidden = F.greatest(F.least(prompt_length, F.size(ids)), F.lit(0))
    return F.concat(
        F.array_repeat(F.lit(IGNORE_LABEL).cast("bigint"), hidden),
        F.slice(ids, hidden + 1, F.size(ids)),
    )


def completion(ids: Column, prompt_length: Column) -> Column:
    """Drop the first `prompt_length` ids."""
    return F.slice(ids, F.greatest(prompt_length, F.lit(0)) + 1, F.greatest(F.size(ids), F.lit(0)))


def is_eos(x: Column, eos_ids: Sequence[int] = EOS_IDS) -> Column:
    return x.isin(*eos_ids)


def eos_positions(ids: Column, eos_ids: Sequence[int] = EOS_IDS) -> Column:
    """Zero-based positions that hold an end-of-text id."""
    return positions(ids, lambda x: is_eos(x, eos_ids))


def masked_positions(ids: Column, mask_id: int = MASK_ID) -> Column:
    """Zero-based positions that still hold the mask id."""
    return positions(ids, lambda x: x == mask_id)


def positions(ids: Column, test) -> Column:
    marked = F.transform(ids, lambda x, i: F.when(test(x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def masked_count(ids: Column, mask_id: int = MASK_ID) -> Column:
    return F.size(F.filter(ids, lambda x: x == mask_id))


def non_pad_mask(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda x: (x != pad_id).cast("int"))


def stop_reached(ids: Column, eos_ids: Sequence[int] = EOS_IDS) -> Column:
    return F.exists(ids, lambda x: is_eos(x, eos_ids))


def keep_last(ids: Column, n: int) -> Column:
    """Keep the last n ids."""
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n))
