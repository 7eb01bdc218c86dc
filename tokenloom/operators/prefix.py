"""Running totals in levels: exact global prefix sums without a single-task window.

Rows are split into buckets that follow the row order. One aggregate (combined before its
shuffle) totals every bucket, a window over the few bucket rows gives each bucket its start,
and a window inside each bucket adds the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def bucket_starts(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[str],
    totals: Mapping[str, Column],
    coarser: Sequence[int] = (),
) -> DataFrame:
    """Per bucket and total: `<name>_before` (sum over earlier buckets) and `<name>_here`.

    Each width in `coarser` joins that many neighbours of the (single, whole-number) bucket column into
    one bucket of the next level. With none, one window per group runs over all of its buckets.
    """
    sums = df.groupBy(*group, *bucket).agg(*[F.sum(c).alias(f"{n}_here") for n, c in totals.items()])
    if coarser:
        name = f"_level{len(coarser)}"
        level = sums.withColumn(name, F.expr(f"`{bucket[0]}` div {coarser[0]}"))
        here = {f"{n}_through": F.col(f"{n}_here") for n in totals}
        sums = running_totals(level, group, [name], bucket, here, coarser=coarser[1:])
        before = {n: F.col(f"{n}_through") - F.col(f"{n}_here") for n in totals}
    else:
        earlier = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
        before = {n: F.coalesce(F.sum(f"{n}_here").over(earlier), F.lit(0)) for n in totals}
    return sums.select(
        *group,
        *bucket,
        *[c.alias(f"{n}_before") for n, c in before.items()],
        *[f"{n}_here" for n in totals],
    )


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str | Column],
    totals: Mapping[str, Column],
    keep_bounds: bool = False,
    below: int | None = None,
    coarser: Sequence[int] = (),
) -> DataFrame:
    """Add one inclusive running total per entry of `totals`.

    `bucket` must be monotone in `order`. The bucket table is joined on the bucket key, whose partitioning the window
    then shares; Spark broadcasts it when its measured size is small. `below` leaves out buckets where every total has
    reached that value before they start. `coarser` adds levels for buckets that may be many.
    """
    starts = bucket_starts(df, group, bucket, totals, coarser)
    if below is not None:
        starts = starts.where(F.least(*[F.col(f"{n}_before") for n in totals], F.lit(below)) < below)
    inside = (
        Window.partitionBy(*group, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    # Every total is computed from the row before its own name is added.
    joined = df.join(starts, [*group, *bucket])
    summed = joined.select(
        *df.columns,
        *[(F.col(f"{n}_before") + F.sum(c).over(inside)).alias(n) for n, c in totals.items()],
        *(
            [F.col(f"{n}_before") for n in totals]
            + [(F.col(f"{n}_before") + F.col(f"{n}_here")).alias(f"{n}_through") for n in totals]
            if keep_bounds
            else []
        ),
    )
    return summed


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str | Column],
    name: str = "ordinal",
    limit: int | None = None,
    coarser: Sequence[int] = (),
) -> DataFrame:
    """Add a dense 1-based ordinal per group, exact over all partitions.

    With a `limit` only rows up to that ordinal are returned, and buckets that start beyond it are
    neither shuffled nor sorted.
    """
    one = {name: F.lit(1).cast("bigint")}
    if limit is None:
        return running_totals(df, group, bucket, order, one, coarser=coarser)
    return running_totals(df, group, bucket, order, one, below=limit).where(F.col(name) <= limit)
