"""Flatten nested JSON settings to leaf columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tokenloom.functions.text import coerce_text


def leaves(value: Column, schema: T.StructType) -> dict[str, tuple[Column, T.DataType]]:
    """Leaf name to its column; the parent name is left out and a later leaf of a name wins."""
    found: dict[str, tuple[Column, T.DataType]] = {}
    for field in schema.fields:
        inner = value[field.name]
        if isinstance(field.dataType, T.StructType):
            found.update(leaves(inner, field.dataType))
        else:
            found[field.name] = (inner, field.dataType)
    return found


def flatten_json(df: DataFrame, column: str, schema: T.StructType, coerce: bool = True) -> DataFrame:
    """Replace a JSON text column by one column per leaf.

    Text leaves become struct<flag, number, text> when `coerce` is set (see `coerce_text`).
    """
    parsed = df.withColumn("_parsed", F.from_json(column, schema))
    columns = [
        (coerce_text(c) if coerce and isinstance(kind, T.StringType) else c).alias(name)
        for name, (c, kind) in leaves(F.col("_parsed"), schema).items()
    ]
    return parsed.select(*[c for c in df.columns if c != column], *columns)
