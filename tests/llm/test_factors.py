import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm import factors
from tokenloom.llm.words import Powers, word_hashes

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows):
    """By (id, text): n_words, n_removed, kept words."""
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    # Texts of one id follow each other in an order of their own; tests with such ids compare sets.
    seen, out = set(), {}
    for known, i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone.update(range(s, s + 20))
            seen.add(window)
        kept = " ".join(w for n, w in enumerate(words) if n not in gone)
        out[i if known else None, t] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(rng):
    word = lambda: rng.choice(["a", "bé", "the", "of", "x1", "Ω"]) if rng.random() < 0.2 else "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    passage, line = [word() for _ in range(60)], [word() for _ in range(9)]
    texts = []
    for i in range(150):
        body = [word() for _ in range(rng.choice([0, 5, 19, 20, 21, 200]))]
        if i % 3 == 0:
            at = rng.randint(0, len(body))
            part = passage[rng.randint(0, 10) : rng.randint(30, 60)]
            body = body[:at] + part + body[at:]
        if i % 2:
            body = line + body + line
        if i % 10 == 9 and texts:
            body = texts[rng.randrange(len(texts))].split()
            for _ in range(rng.randint(0, 3)):
                if body:
                    body[rng.randrange(len(body))] = word()
        texts.append(rng.choice([" ", "  ", "\n", "\t", "\x0b"]).join(body))
    texts += ["same " * 400, "same " * 30 + "other", "p q " * 100, "nbsp stays one " * 30, "", " \n ", None]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("limits", [{}, {"MANY": 3, "HOT_BITS": 12}, {"BLOCK_WORDS": 300, "TOGETHER": 50, "PIECE": 7}])
def test_matches_brute_force(spark, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(factors, name, value)
    rows = corpus(random.Random(7))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(6)
    want = brute(rows)
    got = factors.repeat_digest(df)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    text = dict(rows)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == {i: want[i, t or ""] for i, t in text.items()}
    full = factors.drop_repeats(df)
    assert full.columns == ["doc_id", "text", "n_words", "n_removed"]


def test_factors_point_to_earlier_equal_words(spark):
    rows = corpus(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    words = {i: (t or "").split() if " " not in (t or "") else re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in rows}
    found = factors.factor_documents(df).collect()
    assert found
    covered = set()
    for f in found:
        assert (f.from_doc, f.from_start) < (f.doc, f.start)
        assert words[f.doc][f.start : f.start + f.n + 19] == words[f.from_doc][f.from_start : f.from_start + f.n + 19]
        own = {(f.doc, s) for s in range(f.start, f.start + f.n)}
        assert not covered & own
        covered |= own


def test_repeated_and_missing_ids(spark):
    rng = random.Random(9)
    long = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(50))
    other = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(50))
    rows = [(None, long), (None, other), (None, None), (1, long), (1, long), (2, other + " " + long), (2, "short")]
    got = factors.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == sorted([(0, 50, 0), (0, 50, 0), (0, 0, 0), (1, 50, 50), (1, 50, 50), (2, 100, 100), (2, 1, 0)])
    assert factors.repeat_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pieces_tile_the_windows():
    rng = random.Random(1)
    texts = pa.array([" ".join(rng.choices("abcdefghijk", k=n)) for n in (0, 19, 20, 500, 21)])
    for hot in (np.zeros(0, np.uint64), None):
        plain = factors.Cut(texts, Powers(), np.zeros(0, np.uint64))
        cut = plain if hot is not None else factors.Cut(texts, Powers(), np.unique(plain.key)[::2])
        tiles = [(r, s + j) for r, s, n in zip(cut.row, cut.start, cut.n) for j in range(n)]
        assert tiles == [(2, 0), *[(3, s) for s in range(481)], (4, 0), (4, 1)]
        assert len(cut.windows) == len(tiles)
        assert len(word_hashes(texts, Powers(), kinds=factors.NOT_SPACE, lower=False)[0]) == cut.n_words


def test_sf_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    assert {r.doc_id: tuple(r)[1:] for r in factors.repeat_digest(df).collect()} == {i: want[i, t or ""] for i, t in rows}
