import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import neardup
from tokenloom.llm.words import Powers


def words(text):
    return re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (text or "").lower())


def brute(rows, idf):
    """{doc_id: class} with all pairs compared by plain loops; shingles as tuples, weights from the operator's table."""
    sets, owner = {}, {}
    for doc, text in rows:
        w = words(text)
        key = tuple(w) if w else ("", text or "")
        owner[doc] = key
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        sets[key] = {g: n * idf(g) for g, n in grams.items()}
    keys = list(sets)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            common = sum(min(w, y[g]) for g, w in x.items() if g in y)
            total = sum(x.values()) + sum(y.values()) - common
            if total and common / total >= neardup.LEAST:
                parent[root(a)] = root(b)
    least = {}
    for doc, key in owner.items():
        r = root(key)
        least[r] = min(doc, least.get(r, doc))
    return {doc: least[root(key)] for doc, key in owner.items()}


def hashed_idf(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    frequencies, texts = neardup.document_frequencies(df)
    table = neardup.idf_weights(frequencies, texts)

    def idf(gram):
        hashes, _, _, _ = neardup.shingles(pa.array([" ".join(gram)]), Powers())
        return int(table[int(hashes[0]) >> (64 - neardup.FEATURE_BITS)])

    return idf


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_classes_match_brute_force(spark, sf_dir):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    passage = prose(60)
    for size, edits in ((30, 3), (80, 6), (400, 20), (5, 1), (1500, 60)):
        texts += variants(rng, prose(size), 25, edits)
    texts += [prose(40) + " " + passage for _ in range(40)]
    texts += ["", None, "!!!", "???", "One two", "one, TWO!", "one two three", "a b c d e", "A b. c d e", "word " * 3000, "word " * 2900, prose(25000)]
    rows = list(enumerate(texts))
    want = brute(rows, hashed_idf(spark, rows))
    got = neardup.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id: r.class_id for r in got} == want and len(got) == len(rows)
    assert sorted(r.class_id for r in got if r.keep) == sorted(set(want.values()))
    assert all(r.doc_id == r.class_id for r in got if r.keep)


def test_sample_agreement_is_the_weighted_jaccard():
    rng = np.random.default_rng(9)
    sampler = neardup.Sampler()
    sampler.times = rng.integers(0, 1 << 31, 4000, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
    sampler.plus = rng.integers(0, 1 << 32, 4000, dtype=np.uint32)[:, None]
    sampler.salt = neardup.mix(np.arange(4000).astype(np.uint64))
    neardup.SAMPLES, kept = 4000, neardup.SAMPLES
    try:
        hashes = np.sort(neardup.mix(np.arange(1, 400).astype(np.uint64)))
        a, b = np.sort(rng.choice(399, 300, False)), np.sort(rng.choice(399, 250, False))
        idf = rng.integers(64, 81, 399).astype(np.uint8)
        counts_a, counts_b = rng.integers(1, 4, 300), rng.integers(1, 3, 250)
        x, y = sampler.samples(hashes[a], idf[a], counts_a, 64), sampler.samples(hashes[b], idf[b], counts_b)
        exact = neardup.weighted_jaccard((hashes[a], idf[a] * counts_a), (hashes[b], idf[b] * counts_b))
        assert abs((x == y).mean() - exact) < 0.04
    finally:
        neardup.SAMPLES = kept


def test_idf_counts_every_text(spark):
    rows = [(i, f"a b c d {i % 3}") for i in range(30)]
    frequencies, texts = neardup.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert texts == 30 and sorted(frequencies[frequencies > 0]) == [10, 10, 10]
    weights = neardup.idf_weights(np.array([1, 30, 0]), 30)
    assert weights.tolist() == [80, 64, 80] and math.isclose(80 / 64, 1.25)


def test_edges(spark):
    schema = "doc_id long, text string, class_id string, bands int"
    rows = [(1, "x y z", "q", 1), (1, "x y z", "q", 1), (None, "x y z", None, None), (None, "other", None, None), (None, None, None, None)]
    got = neardup.classify(spark.createDataFrame(rows, schema)).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "bands", "class_id", "keep"}
    assert sorted((str(r.class_id), r.keep) for r in got) == [("1", False), ("1", False), ("1", True), ("None", True), ("None", True)]
    assert neardup.classify(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("blocks,split", [(4, 16), (4, 1)])
def test_small_blocks_change_nothing(spark, blocks, split, monkeypatch):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    rows = list(enumerate(variants(rng, base, 60, 5)))
    want = brute(rows, hashed_idf(spark, rows))
    monkeypatch.setattr(neardup, "BLOCK", blocks)
    monkeypatch.setattr(neardup, "MEMBERS", blocks)
    monkeypatch.setattr(neardup, "SPLIT", split)
    got = neardup.classify(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").where(F.col("doc_id") >= 0).collect()
    assert {r.doc_id: r.class_id for r in got} == want


@pytest.mark.parametrize("split", [16, 1])
def test_links_do_not_depend_on_the_size_of_a_bucket(spark, split, monkeypatch):
    """Two copies with a changed word share one band only; in a bucket of one block or of many they are linked."""
    monkeypatch.setattr(neardup, "BLOCK", 16 if split == 16 else 3)
    monkeypatch.setattr(neardup, "SPLIT", split)
    rng = np.random.default_rng(5)
    draws = rng.integers(0, 1 << 32, (14, neardup.SAMPLES), dtype=np.uint32)
    draws[:, : neardup.ROWS] = 7  # all of one bucket
    draws[9] = draws[3]
    draws[9, neardup.ROWS :: neardup.ROWS] += 1  # every other band differs in one sample
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(f"t{k}x{i}" for i in range(40)) for k in range(14)]
    texts[3], texts[9] = " ".join(words), " ".join([*words[:-1], "end"])
    assert (draws[3] == draws[9]).mean() >= neardup.LIKELY
    marks = spark.createDataFrame([(k, 0, 99) for k in range(14)], "row long, i int, band long")
    stars = spark.createDataFrame([(99, 0)], "band long, star long")
    labels = spark.createDataFrame([], "row long, label long")
    bands = [[99, *(1000 * (k + 1) + i for i in range(1, neardup.BANDS))] for k in range(14)]
    drawn = spark.createDataFrame([(k, bands[k], draws[k].tobytes()) for k in range(14)], "row long, bands array<long>, samples binary")
    bodies = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    idf = spark.sparkContext.broadcast(np.full(1 << neardup.FEATURE_BITS, neardup.UNIT, dtype=np.uint8))
    got = neardup.second_links(marks, stars, labels, drawn, bodies, idf).collect()
    assert [sorted((r.a, r.b)) for r in got] == [[3, 9]]


@pytest.mark.parametrize("size", [3, 40])
def test_links_do_not_depend_on_equal_samples(spark, size):
    """Two texts at 0.8 or more of which few samples agree are linked beside others of their bucket as in one of their own."""
    rng = np.random.default_rng(6)
    draws = rng.integers(0, 1 << 32, (size, neardup.SAMPLES), dtype=np.uint32)
    draws[:, : neardup.ROWS] = 7  # all of one bucket
    assert (draws[1] == draws[2]).mean() < neardup.LIKELY
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(f"t{k}x{i}" for i in range(400)) for k in range(size)]
    texts[1], texts[2] = " ".join(words), " ".join([*words[:-20], *(f"e{i}" for i in range(20))])
    marks = spark.createDataFrame([(k, 0, 99) for k in range(size)], "row long, i int, band long")
    stars = spark.createDataFrame([(99, 0)], "band long, star long")
    labels = spark.createDataFrame([], "row long, label long")
    drawn = spark.createDataFrame([(k, draws[k].tobytes()) for k in range(size)], "row long, samples binary")
    bodies = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    idf = spark.sparkContext.broadcast(np.full(1 << neardup.FEATURE_BITS, neardup.UNIT, dtype=np.uint8))
    got = neardup.second_links(marks, stars, labels, drawn, bodies, idf).collect()
    assert [sorted((r.a, r.b)) for r in got] == [[1, 2]]


def test_outlines_rule_out_no_pair(spark):
    """The bound of two outlines is never below the similarity, also with repeated words and long texts."""
    rng = np.random.default_rng(8)
    texts = []
    for n in (1, 5, 6, 40, 400, 5000):
        text = [f"v{i}" for i in rng.integers(0, max(n // 3, 2), n)]
        texts += [" ".join(text), " ".join([*text[: n - n // 10], *(f"x{i}" for i in range(n // 10))]), " ".join(text * 3), " ".join(text[::-1])]
    table = np.full(1 << neardup.FEATURE_BITS, neardup.UNIT + 3, dtype=np.uint8)
    idf = spark.sparkContext.broadcast(table)
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").select("row", neardup.outlines(idf)("text").alias("o")).orderBy("row").collect()
    sums = [np.frombuffer(r.o, dtype=np.float32).astype(float) for r in rows]
    sets = [(h, w * c) for h, w, c, _, _ in neardup.Weigher(table).sets(pa.array(texts))]
    for i in range(len(texts)):
        for j in range(i):
            common = np.minimum(sums[i], sums[j]).sum()
            assert common / (sums[i].sum() + sums[j].sum() - common) >= neardup.weighted_jaccard(sets[i], sets[j]) - neardup.SLACK
