import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import quality
from tokenloom.llm.words import Powers, word_hashes


def test_word_hashes_are_those_of_single_words():
    texts = ["One two, ONE! ünïcode_1 x", None, "", "...", "two", "é😀 one"]
    powers = Powers()
    hashes, places = word_hashes(pa.array(texts), powers)
    assert np.diff(places).tolist() == [5, 0, 0, 0, 1, 2]
    lone = lambda w: word_hashes(pa.array([w]), powers)[0][0]
    words = ["one", "two", "one", "ünïcode_1", "x", "two", "é😀", "one"]
    assert hashes.tolist() == [lone(w) for w in words]
    assert len({int(lone(w)) for w in set(words)}) == 5


def test_scores_match_a_plain_sum(spark):
    model = quality.Model(np.random.default_rng(1).normal(size=1 << 10).astype(np.float32), np.array([-1.0, 0.5]))
    texts = ["good words here", "", None, "REPEAT repeat repeat %%% ###", "long " * 40000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, keep string")
    got = quality.score(df, model).collect()
    assert len(got) == 10 and set(got[0].asDict()) == {"doc_id", "text", "expected_grade", "tail_probability", "keep"}
    for r in got:
        found, _ = quality.features(pa.array([r.text], pa.string()), Powers(), 10)
        s = sum(float(model.weights[i]) for i in found)
        tails = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        assert r.tail_probability == pytest.approx(tails[1], abs=1e-6) and r.expected_grade == pytest.approx(sum(tails), abs=1e-6)
        assert r.keep == (r.tail_probability >= 0.5)


def test_thresholds_are_ordered_and_grades_told_apart():
    rng, texts, grades = np.random.default_rng(2), [], []
    for i in range(900):
        g = i % 3
        texts.append(" ".join(rng.choice(["the", "of", "and", "to"], 30).tolist() + [["vile", "dull", "fine"][g]] * 2))
        grades.append(g)
    found, offsets = quality.features(pa.array(texts), Powers(), 14)
    model = quality.fit(found, offsets, grades, bits=14)
    assert model.thresholds[0] < model.thresholds[1]
    tails = model.tails(model.scores(found, offsets))
    assert (np.round(tails.sum(axis=1)) == grades).mean() > 0.95


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    graded = quality.grades(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    train, held = graded.where(F.xxhash64("doc_id") % 4 != 0), graded.where(F.xxhash64("doc_id") % 4 == 0)
    model = quality.train(docs, train)
    got = quality.score(docs.join(held, "doc_id"), model).select("grade", "keep").toArrow()
    good, kept = pc.equal(got["grade"], 2).to_numpy(), got["keep"].to_numpy()
    assert kept[good].mean() > 0.99 and (~kept[~good]).mean() > 0.75


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in quality.grades(labels).collect()] == [(1, 1)]
    assert len(quality.quality_query(docs, labels).collect()) == 2
    assert len(quality.quality_query(docs, labels.limit(0)).collect()) == 2
    assert quality.quality_query(docs.limit(0), labels).collect() == []


def test_repeated_ids_stay_within_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "dull dull")] * 300 + [(1, "other")] + [(i, f"fine word{i}") for i in range(2, 30)], "doc_id long, text string")
    graded = spark.createDataFrame([(i, 2 if i > 1 else 0) for i in range(1, 30)], "doc_id long, grade int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda found, offsets, grades, **_: seen.append((len(offsets) - 1, list(grades))) or quality.Model(np.zeros(4), np.zeros(2)))
    quality.train(docs, graded)
    assert seen == [(29, [0] + [2] * 28)]


def test_fit_follows_a_plain_loop(monkeypatch):
    """One batch a pass: slopes by differences of the summed log-likelihood, then the same steps, weight by weight."""
    rng = np.random.default_rng(4)
    rows = [rng.choice(16, 5, replace=False) for _ in range(40)]
    grades = rng.integers(0, 3, 40)
    offsets = np.arange(41) * 5
    model = quality.fit(np.concatenate(rows).astype(np.uint32), offsets, grades, bits=4, passes=3)
    share = [min(max(float((grades > k).mean()), 0.01), 0.99) for k in range(2)]
    cuts = [-math.log(s / (1 - s)) for s in share]
    weights, seen, cut_seen = [0.0] * 16, [1e-8] * 16, [1e-8] * 2

    def loss(weights, cuts):
        logistic = lambda x: 1 / (1 + math.exp(-min(max(x, -50), 50)))
        out = 0.0
        for row, g in zip(rows, grades, strict=True):
            score = sum(weights[i] for i in row)
            edges = [-math.inf, *cuts, math.inf]
            high = 1.0 if g == 2 else logistic(edges[g + 1] - score)
            low = 0.0 if g == 0 else logistic(edges[g] - score)
            out -= math.log(high - low)
        return out / len(rows)

    for _ in range(3):
        e = 1e-6
        moved = lambda x, i, d: [v + d * (j == i) for j, v in enumerate(x)]
        slope = [(loss(moved(weights, i, e), cuts) - loss(moved(weights, i, -e), cuts)) / (2 * e) for i in range(16)]
        by_cut = [(loss(weights, moved(cuts, k, e)) - loss(weights, moved(cuts, k, -e))) / (2 * e) for k in range(2)]
        for i, g in enumerate(slope):
            seen[i] += g * g
            pace = 0.3 / math.sqrt(seen[i])
            w = weights[i] - pace * g
            weights[i] = math.copysign(max(abs(w) - pace * 6e-4, 0), w)
        for k, g in enumerate(by_cut):
            cut_seen[k] += g * g
            cuts[k] -= 0.3 * g / math.sqrt(cut_seen[k])
        cuts[1] = max(cuts[1], cuts[0] + 1e-3)
    assert np.abs(model.weights - weights).max() < 1e-3 and np.abs(model.thresholds - cuts).max() < 1e-3
