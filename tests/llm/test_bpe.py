import hashlib
import random

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tokenloom.llm import bpe

ODD = ["", "  a  b\n\n c", "x <|endoftext|>  y  <|endoftext|>", "a  <|endoftext|>", "a b  c", "　 a\t\tb \n", "don't it's  'll", "日本語 テキスト  12345 ", "aaaaaaaaaaaaaaaaaaa bbb    ", "\n\n\n", "😀😀 a 😀", "-" * 300, " " * 300 + "x", "\r\n a\r\n", "ab" * 20000]


@pytest.fixture(scope="module")
def tools():
    path = bpe.public_path("byte_bpe_50k.json")
    return bpe.Automaton(open(path).read()), Tokenizer.from_file(path)


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("ab e\n\tthi ng.,'s0 9éü  —") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    return ODD + made + pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()


def test_equals_the_library_both_ways(tools):
    auto, coder = tools
    for text in texts():
        ids = coder.encode(text, add_special_tokens=False).ids
        assert auto.encode(text) == ids
        assert auto.decode(ids) == coder.decode(ids, skip_special_tokens=False)


def test_accepts_exactly_correct_pairs(tools):
    """A state reads a token just where the two of them are the tokenization of their text."""
    auto, coder = tools
    rng = random.Random(5)
    words = [i for i, t in enumerate(auto.label[:50000]) if t.isascii() and t.strip().isalpha() and not t.endswith(b" ")]
    for _ in range(3000):
        u, v = rng.choice(words), rng.choice(words)
        if auto.label[v].startswith(b" "):
            continue
        got = coder.encode((auto.label[u] + auto.label[v]).decode(), add_special_tokens=False).ids
        assert auto.reads(u, v) == (got == [u, v])


def test_small_vocabulary_by_hand():
    symbols = {b: c for c, b in bpe.byte_symbols().items()}
    vocab = {symbols[b]: b for b in range(256)} | {"aa": 256, "aaa": 257}
    import json

    spec = {"model": {"vocab": vocab, "merges": [["a", "a"], ["aa", "a"]]}, "added_tokens": []}
    auto = bpe.Automaton(json.dumps(spec))
    assert [auto.encode_word(b"a" * n) for n in (2, 3, 4, 5)] == [[256], [257], [256, 256], [256, 257]]


def test_query_over_rows(spark, tools):
    _, coder = tools
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id"), (1, "again"), (99999, None)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(map(str, map(tuple, bpe.encode_digest(df.repartition(3)).collect())))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids
        want.append(str((d, len(ids), sha(",".join(map(str, ids))), sha(coder.decode(ids, skip_special_tokens=False)))))
    assert got == sorted(want)
    coded = bpe.encode_documents(df.where("doc_id < 50"))
    assert all(r.decoded == (r.text or "") for r in bpe.decode_documents(coded).collect())
    assert bpe.encode_digest(df.limit(0)).collect() == []
