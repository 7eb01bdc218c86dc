import random
import zlib
from collections import defaultdict

import numpy as np

from tokenloom.llm import packs


def test_windows_are_full_and_hold_every_token_once():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.choice([1, 2, 255, 256, 257, 2048, rng.randint(1, 300), rng.randint(1, 6000)]) for _ in range(rng.randint(0, 50))]
        out, sizes = packs.place(lengths)
        documents, windows = defaultdict(list), defaultdict(list)
        for d, s, n, w, o in out:
            documents[d].append((s, n))
            windows[w].append((o, n))
        for d, n in enumerate(lengths):
            at = 0
            for s, m in sorted(documents[d]):
                assert s == at and m > 0
                at += m
            assert at == n
        for w, size in enumerate(sizes):
            assert sum(m for _, m in windows[w]) == size <= 2048 and size & (size - 1) == 0
            assert [o for o, _ in sorted(windows[w])] == np.cumsum([0, *[m for _, m in sorted(windows[w])]])[:-1].tolist()


def test_steps_are_even_in_cost():
    rng = random.Random(2)
    out, sizes = packs.place([rng.randint(1, 3000) for _ in range(600)])
    steps, cost = packs.step_groups(out, sizes), defaultdict(int)
    window_cost = defaultdict(int)
    for _, _, n, w, _ in out:
        window_cost[w] += n * n
    for w, s in enumerate(steps):
        if sizes[w] == 2048:
            cost[s] += window_cost[w]
    full = [c for s, c in cost.items() if steps.count(s) == packs.STEP]
    assert max(full) < 1.35 * min(full)


def test_pieces_are_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packs.public_path("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = ["", None, "Don't <|endoftext|> x", "İstanbul É ≮", "a  b\n c", "x" * 9000, "日本 12ab34", "A'B'S 's!'s"]
    texts += ["".join(rng.choice("abS eE\n\tthi ng.,'s0 9éÜ  —<|>́ıİK") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, "null id"), (3, texts[3])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, ids string")
    parts = defaultdict(list)
    for r in packs.pack_digest(df.repartition(4)).collect():
        parts[r.doc_id].append(r)
    for d, t in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(parts[d], key=lambda r: r.start)
        assert {r.doc_tokens for r in own} == {len(ids)}
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in own) == len(ids) * (2 if d == 3 else 1)
    assert packs.pack_digest(df.limit(0)).collect() == []


def test_letters_that_decompose_are_the_library_s_ids(monkeypatch):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packs.public_path("word_bpe_49k.json"))
    words = ["plain", " \u0938\u095c\u0915", " \u095b", "\u09dc", " \ufb2a", " \u0130x", " word"]

    def check():
        store = packs.Pieces(coder, np.uint16)
        for p, k in zip(words, store.slots(words), strict=True):
            assert store.ids[store.starts[k] :][: store.sizes[k]].tolist() == coder.encode(p, add_special_tokens=False).ids, p

    check()
    # Also where the rule is wrong about a piece.
    monkeypatch.setattr(packs, "only_letters", lambda p: True)
    check()


def test_a_decomposed_letter_does_not_fail_the_job(spark):
    rows = spark.createDataFrame([(1, "a \u0938\u095c\u0915 b"), (2, "plain words")], "doc_id long, text string")
    assert {r.doc_id for r in packs.pack_digest(rows).collect()} == {1, 2}


def test_equal_rows_are_spread_over_groups(spark, monkeypatch):
    """A row that makes up most of the table, in id and text, is packed in several bounded groups."""
    monkeypatch.setattr(packs, "GROUP_BYTES", 500)
    rows = [(None, "the same words in every row")] * 300 + [(i, f"row {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = packs.pack_documents(df).collect()
    hot = [r for r in got if r.doc_id is None]
    assert sum(r.length for r in hot) == 300 * hot[0].doc_tokens
    assert len({r.sequence_id >> 32 for r in hot}) > 3
