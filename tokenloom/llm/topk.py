"""Exact top-k inner products by columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERY_BLOCK, ROW_BLOCK, DIMENSIONS = 2048, 16384, 8


def quantize(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) per component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """True for a vector that is there and whose components are all finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def exact_type(rows: np.ndarray, queries: np.ndarray) -> type:
    """The fastest type in which every partial sum of products is an exact whole number."""
    most = rows.shape[1] * float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def search_block(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, step: int = DIMENSIONS):
    """For each query: positions of its k best rows in this block and their scores.

    Rows lie by dimension (vertical layout), widest dimensions first. After every `step` dimensions a row's
    score lies within partial +- |rest of row| * |rest of query| (Cauchy-Schwarz). Rows whose upper bound is
    below the k-th best lower bound cannot be among the best and are compacted away; ties survive.
    """
    kind = exact_type(rows, queries)
    order = np.argsort(-np.abs(rows).sum(axis=0, dtype=np.float64), kind="stable")
    columns = np.ascontiguousarray(rows[:, order].T.astype(kind))
    asked = queries[:, order].astype(kind)
    n, width = len(ids), len(order)
    cuts = list(range(step, width, step))
    rest = lambda m, axis: np.sqrt(np.cumsum((m.astype(np.float64) ** 2)[::-1] if axis == 0 else (m.astype(np.float64) ** 2)[:, ::-1], axis=axis))
    row_rest, query_rest = rest(columns, 0), rest(asked, 1)
    row_mass = {c: (row_rest[width - c - 1]).astype(np.float32) * np.float32(1.000001) for c in cuts}
    first = asked[:, : cuts[0] if cuts else width] @ columns[: cuts[0] if cuts else width]
    for q in range(len(asked)):
        partial = first[q]
        alive = None
        if n > k:
            for at, c in enumerate(cuts):
                mass = row_mass[c] if alive is None else row_mass[c][alive]
                slack = mass * np.float32(query_rest[q, width - c - 1] * 1.000001)
                lower = partial - slack
                bar = np.partition(lower, len(lower) - k - 1)[len(lower) - k - 1] if len(lower) > k else -np.inf
                keep = np.flatnonzero(partial + slack >= bar - 1)
                if len(keep) < 0.7 * len(partial):
                    alive = keep if alive is None else alive[keep]
                    partial = partial[keep]
                end = cuts[at + 1] if at + 1 < len(cuts) else width
                block = columns[c:end] if alive is None else columns[c:end, alive]
                partial = partial + asked[q, c:end] @ block
        else:
            partial = asked[q] @ columns
        alive = np.arange(n) if alive is None else alive
        own = ids[alive] == query_ids[q]
        if own.any():
            alive, partial = alive[~own], partial[~own]
        if len(partial) > k:
            bar = np.partition(partial, len(partial) - k)[len(partial) - k]
            near = np.flatnonzero(partial >= bar)
            alive, partial = alive[near], partial[near]
        best = np.lexsort((ids[alive], -partial))[:k]
        yield alive[best], partial[best]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """Each query's k highest inner products with `rows` (all, if fewer), ties to the smaller id.

    Both tables hold (id long, vector array<long>). Rows and queries are dealt into blocks of bounded size; every
    pair of blocks is one bounded task that returns k rows a query at most, and those are ranked per query.
    A row with the query's own id is no candidate; repeated rows are candidates each; a repeated query counts
    once, and of several vectors of one id each is searched with, their results ranked together; a null id takes no part. Vectors of unequal width meet as if filled up with zeros. Empty tables give
    no rows.
    """
    rows = rows.where("id is not null and vector is not null")
    queries = queries.where("id is not null and vector is not null").dropDuplicates(["id", "vector"])
    row_blocks = max(1, -(-rows.count() // row_block))
    query_blocks = max(1, -(-queries.count() // query_block))
    # Rows of one id, even equal ones, are dealt to several blocks.
    number = lambda n: F.pmod(F.xxhash64("id", "vector", F.spark_partition_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pairs = rows.select(number(row_blocks).alias("r"), every(query_blocks).alias("q"), F.lit(False).alias("asks"), "id", "vector").unionByName(
        queries.select(every(row_blocks).alias("r"), number(query_blocks).alias("q"), F.lit(True).alias("asks"), "id", "vector")
    )

    def meet(table: pa.Table) -> pa.Table:
        vectors = table.column("vector").combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        matrix = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), dtype=np.int64)
        matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy()
        out: list[np.ndarray] = [np.zeros((3, 0), dtype=np.int64)]
        if asks.any() and not asks.all():
            own = ids[~asks]
            found = search_block(matrix[~asks], own, matrix[asks], ids[asks], k)
            for query, (at, score) in zip(ids[asks], found, strict=True):
                out.append(np.stack([np.full(len(at), query), own[at], score.astype(np.int64)]))
        joined = np.concatenate(out, axis=1)
        return pa.table({"query_id": joined[0], "vec_id": joined[1], "score": joined[2]})

    found = pairs.groupBy("r", "q").applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_query(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Top k of the query set `vec_id` divisible by `every` against all rows."""
    vectors = embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), quantize(F.col("embedding")).alias("vector"))
    return top_k(vectors, vectors.where(F.col("id") % every == 0), k)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as c
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, r.vec_id as vec_id,
    cast(coalesce(list_sum(list_transform(range(1, least(len(q.c), len(r.c)) + 1), lambda i: q.c[i] * r.c[i])), 0) as bigint) as score
  from v q join v r on q.vec_id % 20 = 0 and q.vec_id <> r.vec_id
), t as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from t where rank <= 20
"""
