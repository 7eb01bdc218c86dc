"""User functions over Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import regex
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tokenloom.functions.text import TOKEN_PATTERN


def map_batches(
    df: DataFrame,
    fn: Callable[..., pd.DataFrame],
    schema: T.StructType | str,
    **bound,
) -> DataFrame:
    """Apply `fn(batch, **bound)` to record batches; it may return fewer or more rows."""

    def run(batches):
        for batch in batches:
            yield fn(batch, **bound)

    return df.mapInPandas(run, schema)


def generate(
    padded: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Hand each padded batch as a whole to the user's inference function.

    Padding already placed the rows of a batch together, so no further exchange is made.
    """
    return padded.groupBy("batch_id").applyInPandas(fn, schema)


def generate_logged(padded: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """`item_id, response, batch_id, tokens, calls, seconds` of each row: what the function returns, and its run log.

    `fn` returns `item_id, response` and may report `tokens` and `calls` per row. Else a batch counts as one call and as
    rows times the width of its longest generation: of `output_ids` if it returns them, or of the responses' tokens.
    The seconds of a batch stand on its first row.
    """

    pattern = regex.compile(TOKEN_PATTERN)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        started = time.perf_counter()
        out = fn(batch).reset_index(drop=True)
        first = out.index == 0
        seconds = time.perf_counter() - started
        made = out["output_ids"].map(len) if "output_ids" in out else out["response"].fillna("").map(lambda x: len(pattern.findall(x)))
        return pd.DataFrame(
            {
                "item_id": out["item_id"],
                "response": out["response"],
                "batch_id": batch["batch_id"].iloc[0],
                "tokens": out["tokens"] if "tokens" in out else int(made.max()) if len(out) else 0,
                "calls": out["calls"] if "calls" in out else first.astype("int64"),
                "seconds": first * seconds,
            }
        )

    schema = T.StructType([padded.schema["item_id"], T.StructField("response", T.StringType()), padded.schema["batch_id"]])
    for name, kind in (("tokens", T.LongType()), ("calls", T.LongType()), ("seconds", T.DoubleType())):
        schema = schema.add(name, kind)
    return padded.groupBy("batch_id").applyInPandas(run, schema)


def generate_placed(
    padded: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    processes: int,
    barrier: bool = False,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Hand whole padded batches to an inference function that runs in `processes` tasks, one call per batch.

    With `barrier` the tasks start together and may talk to each other (`BarrierTaskContext`), as a model that is spread over
    them needs; `profile` says what each task's executor must have, such as a GPU. A batch stays in one task.
    """
    dealt = padded.repartition(processes, "batch_id").sortWithinPartitions("batch_id")

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            ids = rows.column("batch_id").to_pylist()
            at = 0
            while at < len(ids):
                end = at + 1
                while end < len(ids) and ids[end] == ids[at]:
                    end += 1
                if held and held[0].column("batch_id")[0].as_py() != ids[at]:
                    yield fn(pa.concat_tables(held).to_pandas())
                    held = []
                held.append(rows.slice(at, end - at))
                at = end
        if held:
            yield fn(pa.concat_tables(held).to_pandas())

    target = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def arrow(batches):
        kinds = to_arrow_schema(target)
        for made in run(batches):
            yield from pa.Table.from_pandas(made[target.names], schema=kinds, preserve_index=False).combine_chunks().to_batches()

    return dealt.mapInArrow(arrow, target, barrier=barrier, profile=profile)
