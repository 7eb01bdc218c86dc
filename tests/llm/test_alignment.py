import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tokenloom.llm import alignment, bpe

TEXTS = [
    "The quick brown fox jumps over the lazy dog.",
    "The quick brown fox jumps over the lazy dog.",
    "naïve café — 東京都 😀😀 नमस्ते",
    "  two  spaces\tand\r\nlines\n\n\n end ",
    "<|endoftext|> <s> </s> <0x0A> <unk>",
    "a▁b keeps no bytes",
    "x" * 3000 + " " * 700 + "^" * 2000,
    "",
    None,
    "\0zero\x7f",
    "the the the the end",
    " ".join(f"word{i % 37} tokenisation {i}" for i in range(800)),
]


def brute(texts):
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    symbols = bpe.byte_symbols()
    rows = []
    for text in texts:
        a, b, groups = [], [], []
        if text:
            a = [(i, bytes(symbols[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
            pieces = [(i, b_lib.id_to_piece(i)) for i in b_lib.encode(text)]
            b = [(i, bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a, b = [], []
        at_a = at_b = i = j = 0
        left, right = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                left.append(a[i][0])
                at_a, i = at_a + len(a[i][1]), i + 1
            else:
                right.append(b[j][0])
                at_b, j = at_b + len(b[j][1]), j + 1
            if at_a == at_b:
                groups.append((left, right))
                left, right = [], []
        rows.append((len(a), len(b), groups))
    held = Counter()
    links = []
    for _, _, groups in rows:
        own = Counter((x, y) for left, right in groups for x in left for y in right)
        links.append(own)
        held.update(own.keys())
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (n_a, n_b, groups), own in zip(rows, links, strict=True):
        told = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append(
            (n_a, n_b, len(groups), sum(own.values()), sum(n for p, n in own.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in own.items()), hashlib.sha256(told.encode()).hexdigest() if told else "")
        )
    return out


@pytest.mark.parametrize("most", [1 << 18, 40, 0])
def test_matches_plain_loops(spark, most, monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", 64)
    rows = [(None if i == 3 else i, t, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    got = alignment.alignment_digest(df, most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for c, t in got.dtypes if c != "groups_sha256"} == {"bigint"}
    key = lambda r: (r[0] is None, r[0] or 0)
    want = [(i, *w) for (i, _, _), w in zip(rows, brute(TEXTS), strict=True)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_groups_and_empty_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.aligned for r in alignment.align_documents(df).collect()}
    for i, (_, _, n, *_) in enumerate(brute(TEXTS)):
        groups = got[i]
        assert len(groups) == n
        if n:
            assert groups[0].start == 0 and groups[-1].end == len(TEXTS[i].encode()) + 1
            assert all(x.end == y.start for x, y in zip(groups, groups[1:]))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_digest(empty).collect() == []
    assert alignment.align_documents(empty).collect() == []


def test_sf_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = df.orderBy("doc_id").select("doc_id", "text").collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows]), strict=True)]
    assert sorted(map(tuple, alignment.alignment_digest(df, most=500).collect())) == want


def test_runs_beyond_the_fast_matcher():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        both = alignment.Tokenizers(a.read(), b.read())
    text = " " * 1_200_000 + "a"
    (a,), (b,) = both.encode([text])
    assert sum(both.sizes_a[a]) == sum(both.sizes_b[b]) == len(text) + 1
