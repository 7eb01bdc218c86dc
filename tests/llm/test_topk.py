import math
import random

import pytest

from tokenloom.llm import topk


def brute(rows, every, k=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in reversed(good) if i % every == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2048, 16384), (7, 50)])
def test_matches_brute_force(spark, blocks, monkeypatch):
    rng = random.Random(3)
    same = [rng.gauss(0, 0.2) for _ in range(20)]
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(20)]) for i in range(300)]
    rows += [(300 + i, same) for i in range(60)] + [(400, None), (401, []), (420, [1.0, None]), (440, [float("nan")] * 20), (None, same), (460, [float("inf")] * 20), (480, [0.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    values = topk.quantize
    vectors = df.where(topk.usable(df.embedding)).select(df.vec_id.alias("id"), values(df.embedding).alias("vector"))
    got = topk.top_k(vectors, vectors.where("id % 20 = 0"), 20, *blocks)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)


def test_few_rows_repeats_and_large_values(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.top_k_query(spark.createDataFrame([], schema)).collect() == []
    assert topk.top_k_query(spark.createDataFrame([(0, [1.0])], schema)).collect() == []
    rows = [(0, [1.0, -2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [-1.0, 0.0])]
    got = [tuple(r) for r in topk.top_k_query(spark.createDataFrame(rows, schema)).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 4096), (0, 2, 1, 4096), (0, 3, 2, -4096)]
    big = [(0, [1e6, 1.0]), (1, [1e6, 0.0]), (2, [1e6, 1.0])]
    got = [(r.vec_id, r.score) for r in topk.top_k_query(spark.createDataFrame(big, schema)).orderBy("rank").collect()]
    assert got == [(2, 64_000_000**2 + 64 * 64), (1, 64_000_000**2)]


def test_each_vector_of_a_query_id_is_searched_with(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])]
    got = [tuple(r) for r in topk.top_k_query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 3 * 4096), (0, 2, 1, 2 * 4096), (0, 3, 1, 0), (0, 4, 2, 0)]
