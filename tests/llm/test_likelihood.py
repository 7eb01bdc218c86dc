import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm import likelihood as lm
from tokenloom.llm.words import Powers, word_hashes


def words_of(text):
    return re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (text or "").lower())


def hashes_of(words):
    return word_hashes(pa.array([" ".join(words)]), Powers())[0]


def brute(text, model, counts):
    """Sum of log P(word | both sides), one word at a time with plain softmaxes; `counts` are those of the corpus."""
    known, flat, _ = model
    v = lm.views(flat.astype(np.float64), known.classes, known.members)
    words = words_of(text)
    ranked = sorted(counts, key=lambda w: (-counts[w], int(hashes_of([w]).view(np.int64)[0])))
    own = {w: i for i, w in enumerate(ranked[: known.own])}
    shared = lambda w: known.own + int(hashes_of([w]).view(np.int64)[0]) % known.shared
    running = Counter()
    for w, n in counts.items():
        if w not in own:
            running[shared(w)] += n
    ids = [own[w] if w in own else shared(w) for w in words]
    total = 0.0
    for i, (w, own_id) in enumerate(zip(words, ids, strict=True)):
        x = v["bias"].copy()
        for k, o in enumerate(lm.WINDOW):
            x += v["inputs"][k][ids[i + o] if 0 <= i + o < len(ids) else known.size]
        x = np.tanh(x)
        a = x @ v["classes"] + v["class_bias"]
        c, m = own_id % known.classes, own_id // known.classes
        b = x @ v["words"][c] + v["word_bias"][c]
        total += a[c] - math.log(np.exp(a).sum()) + b[m] - math.log(np.exp(b).sum())
        if w not in own:
            total += math.log(counts.get(w, 1) / (running[own_id] + 1))
    return len(ids), total


TEXTS = ["One, two three. ONE!", "", None, "...", "x", "é ü 😀 word", " ".join(f"w{i % 97}" for i in range(3000)), " ".join(f"v{i * i % 41}" for i in range(500))]


@pytest.mark.parametrize("table", [1 << 16, 20])
def test_trained_scores_match_brute_force(spark, monkeypatch, table):
    monkeypatch.setattr(lm, "TABLE", table)
    monkeypatch.setattr(lm, "FEWEST", 40)
    monkeypatch.setattr(lm, "GROUP", 1000)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_words int").repartition(3)
    model = lm.train(df.select("doc_id", "text"))
    assert (model[2].count() == 0) == (table > 20)
    counts = Counter(w for t in TEXTS * 2 for w in words_of(t))
    got = lm.score(df, model).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        n, total = brute(r.text, model, counts)
        assert r.n_words == n and r.log_likelihood == pytest.approx(total, rel=1e-4, abs=1e-4)
        assert (r.mean_log_likelihood is None) == (n == 0)


def test_training_matches_a_plain_loop(spark, monkeypatch):
    """One group, in the order of text hashes: softmax slopes word by word, Adagrad batch by batch."""
    monkeypatch.setattr(lm, "BATCH", 16)
    monkeypatch.setattr(lm, "FEWEST", 5)
    monkeypatch.setattr(lm, "OTHER", 3)
    texts = [" ".join(f"w{i * k % 7}" for i in range(30)) for k in (1, 2, 3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    known, flat, _ = lm.train(df)
    counts = Counter(w for t in texts for w in t.split())
    order = [r.text for r in df.selectExpr("text", "xxhash64(text) h").orderBy("h").collect()]
    by_id = np.concatenate([known.counts, known.totals])
    want = lm.start(by_id, known.classes).astype(np.float64)
    v, seen = lm.views(want, known.classes, known.members), lm.views(np.full(len(want), 1e-6), known.classes, known.members)
    assert sum(counts.values()) == by_id.sum()
    places = []
    for t in order:
        ids = [int(x) for x in known.look(hashes_of(t.split()))[0]]
        places += [([ids[i + o] if 0 <= i + o < len(ids) else known.size for o in lm.WINDOW], w) for i, w in enumerate(ids)]
    for at in range(0, len(places), 16):
        some = places[at : at + 16]
        grad = lm.views(np.zeros(len(want)), known.classes, known.members)
        for around, w in some:
            x = np.tanh(v["bias"] + sum(v["inputs"][k][j] for k, j in enumerate(around)))
            c, m = w % known.classes, w // known.classes
            p = np.exp(x @ v["classes"] + v["class_bias"])
            q = np.exp(x @ v["words"][c] + v["word_bias"][c])
            p, q = p / p.sum(), q / q.sum()
            p[c], q[m] = p[c] - 1, q[m] - 1
            grad["classes"] += np.outer(x, p)
            grad["class_bias"] += p
            grad["words"][c] += np.outer(x, q)
            grad["word_bias"][c] += q
            back = (v["classes"] @ p + v["words"][c] @ q) * (1 - x * x)
            grad["bias"] += back
            for k, j in enumerate(around):
                grad["inputs"][k][j] += back
        for name in v:
            g = grad[name] / len(some)
            seen[name] += g * g
            v[name] -= lm.RATE * g / np.sqrt(seen[name])
    assert np.abs(flat - want).max() < 2e-3


def test_class_probabilities_sum_to_one(spark):
    known, flat, _ = lm.train(spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(2000)))], "doc_id long, text string"))
    v = lm.views(flat, known.classes, known.members)
    padded = np.full(known.size * 5, known.size, dtype=np.uint16)
    places = np.arange(known.size) * 5 + 2
    padded[places] = np.arange(known.size)
    padded[places - 1], padded[places + 2] = 7, 9
    assert np.exp(lm.forward(v, padded, places)).sum() == pytest.approx(1, abs=1e-4)


def test_results_do_not_depend_on_tasks(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 300)
    rows = [(i, " ".join(f"w{(i * j) % 53}" for j in range(60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (lm.train(df.repartition(n))[1] for n in (1, 7))
    assert np.abs(one - two).max() < 1e-6


def test_training_tells_order_from_disorder(spark):
    rng = np.random.default_rng(2)
    line = "the cat sat on the mat and the dog ran to the red barn "
    train = [(i, line * 30) for i in range(200)]
    model = lm.train(spark.createDataFrame(train, "doc_id long, text string").repartition(3), rounds=4)
    words = (line * 20).split()
    mixed = [" ".join(rng.permutation(words)) for _ in range(5)]
    rows = spark.createDataFrame([(0, line * 20), *[(i + 1, t) for i, t in enumerate(mixed)]], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_likelihood for r in lm.score(rows, model).collect()}
    assert got[0] > max(got[i] for i in range(1, 6)) + 1


def test_empty_table(spark):
    assert lm.likelihood_query(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    lone = lm.likelihood_query(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert lone.n_words == 0 and lone.log_likelihood == 0.0


def test_counts_vocabulary_and_classes_follow_the_corpus(spark, monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(1, 3001, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lm, "HELD", 500)
    counts = lm.count_words(df)
    plain = Counter(w for t in texts for w in t.split())
    assert sorted(r.n for r in counts.collect()) == sorted(plain.values())
    want = sum(len(t.split()) for t in texts)
    assert counts.agg({"n": "sum"}).first()[0] == want
    known, by_id, rest, running = lm.lexicon(counts)
    assert running == want and known.own == lm.own_ids(want) == 960
    assert known.classes == pytest.approx(known.size**0.5, abs=1)
    assert by_id.sum() == want and len(by_id) == known.size and rest.count() == 0
    assert lm.own_ids(1 << 24) == 960 and lm.own_ids(1 << 32) == 3840
    monkeypatch.setattr(lm, "TABLE", 100)
    assert lm.lexicon(counts)[2].count() == sum(n > 1 for n in plain.values()) - 1060


@pytest.mark.parametrize("table", [1 << 18, 0])
def test_rare_words_differ_by_their_counts(spark, monkeypatch, table):
    monkeypatch.setattr(lm, "FEWEST", 1)
    monkeypatch.setattr(lm, "OTHER", 1)
    monkeypatch.setattr(lm, "TABLE", table)
    train = [(0, "the the " * 50 + "often " * 30 + "twice twice once")]
    df = spark.createDataFrame(train, "doc_id long, text string")
    model = lm.train(df)
    assert (model[2].count() == 0) == (table > 0)
    asked = ["often", "twice", "once", "unseen", "the", "often twice"]
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(2)
    got = {r.text: r.log_likelihood for r in lm.score(rows, model).collect()}
    # One id is shared here, or a few: words on one id differ by the logarithm of their counts alone.
    known, total = model[0], {}
    hashes, _ = word_hashes(pa.array(["often twice once unseen"]), Powers())
    ids, _ = known.look(hashes)
    v = lm.views(model[1], known.classes, known.members)
    for w, i, n in zip(["often", "twice", "once", "unseen"], ids, [30, 2, 1, 1], strict=True):
        padded = np.array([known.size] * 5, dtype=known.ids.dtype)
        padded[2] = i
        alone = lm.forward(v, padded, np.array([2]))[0]
        assert got[w] == pytest.approx(alone + math.log(n / (known.totals[i - known.own] + 1)), rel=1e-4), w
        total[i] = total.get(i, 0) + (n if w != "unseen" else 0)
    assert all(known.totals[i - known.own] == n for i, n in total.items())
