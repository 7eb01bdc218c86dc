import itertools
import math
import random

import numpy as np
import pytest

from tokenloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"


def brute(rows):
    good = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, v, y, *_ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, q in good:
        if i % 50:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, c)), j, z) for j, z, c in good if j != i)
        for p, j in [(-s, j) for s, j, z in scores if z == y][:5]:
            hard = [(-s, n) for s, n, z in scores if z != y and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(i, j, rank + 1, n, p, s) for rank, (s, n) in enumerate(hard)]
    return sorted(out)


def test_curve_visits_every_cell_by_steps_to_neighbours():
    for axes, bits in ((2, 3), (3, 2), (4, 2), (1, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        place = negatives.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_are_met():
    rng = np.random.default_rng(1)
    rows, anchors = rng.integers(-50, 50, (30, 6)), rng.integers(-50, 50, (8, 6))
    least, most = negatives.bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = anchors @ rows.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, 0]).all()
    least, most = negatives.bounds(anchors, rows, rows)
    assert (least == scores).all() and (most == scores).all()


@pytest.mark.parametrize("sizes", [(1024, 256, 256), (16, 3, 2)])
def test_matches_brute_force(spark, sizes, monkeypatch):
    for name, size in zip(("BLOCK", "ANCHORS", "ZONES"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, size)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(10)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in centres[i % 10 if rng.random() < 0.8 else 3]], i % 10, "x") for i in range(400)]
    same = [round(x, 1) for x in centres[2]]
    rows += [(400 + i, same, i % 3, "x") for i in range(120)]
    rows += [(600, None, 1, "x"), (650, [1.0, None], 2, "x"), (700, [float("nan")] * 12, 1, "x"), (750, same, None, "x"), (None, same, 1, "x"), (800, [0.5, 0.25], 2, "x"), (850, [], 1, "x"), (900, [0.0] * 12, 4, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = negatives.hard_negative_query(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_zones_keep_far_blocks_unread(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 50)
    rng = random.Random(2)
    rows = [(i, i % 4, [int(rng.gauss(1000 * (i % 4 == k), 20)) for k in range(4)]) for i in range(1, 2000)]
    blocks = negatives.candidate_blocks(spark.createDataFrame(rows, "id long, label int, vector array<long>"))
    anchors = negatives.anchors_of(blocks, 50, 5)
    picked = negatives.chosen(anchors, blocks, True).selectExpr("sum(size(anchors))").first()[0]
    assert picked < 0.5 * anchors.count() * blocks.count()
    assert blocks.selectExpr("sum(size(ids))").first()[0] == len(rows)


def test_few_rows_and_tables(spark, sf_dir):
    assert negatives.hard_negative_query(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.hard_negative_query(spark.createDataFrame([(50, [1.0], 1, "x")], SCHEMA)).collect() == []
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = negatives.hard_negative_query(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assert sorted(map(tuple, got.collect())) == brute(rows)
