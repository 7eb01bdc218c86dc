from collections import defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm.test_neardup import brute as near_classes, hashed_idf
from tests.llm.test_secrets import base
from tokenloom.llm import packs, quality
from tokenloom.llm.words import Powers


def test_stages_match_plain_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.withColumns({"keep": docs.n_chars, "spans": docs.text})
    labels = quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r for r in docs.collect()}

    first = corpus_pipeline.keep_good(spark, extra, sf_dir)
    assert first.columns == docs.columns
    model = quality.train(docs, labels)
    good = set()
    for i, r in texts.items():
        found, _ = quality.features(pa.array([r.text]), Powers())
        s = sum(float(model.weights[k]) for k in found)
        if 1 / (1 + np.exp(model.thresholds[-1] - s)) >= 0.5:
            good.add(i)
    assert {r.doc_id for r in first.collect()} == good and len(good) > 0.5 * len(texts)

    second = corpus_pipeline.keep_one_of_each(spark, first, sf_dir)
    rows = [(i, texts[i].text) for i in sorted(good)]
    classes = near_classes(rows, hashed_idf(spark, rows))
    assert {r.doc_id for r in second.collect()} == set(classes.values()) and second.columns == docs.columns

    third = corpus_pipeline.remove_secrets(spark, second, sf_dir)
    assert third.columns == docs.columns
    clean = {r.doc_id: r for r in third.collect()}
    assert set(clean) == set(classes.values())
    for i, r in clean.items():
        assert not base(r.text)
        assert r.n_chars == (texts[i].n_chars if r.text == texts[i].text else len(r.text))
        assert ("credential]" in r.text) == (r.text != texts[i].text)

    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packs.public_path("word_bpe_49k.json"))
    parts, windows = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.pack(spark, third, sf_dir).collect():
        parts[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, r in clean.items():
        ids = [x for _, p in sorted(parts[i]) for x in p]
        assert ids == coder.encode(r.text, add_special_tokens=False).ids + [1]
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_gives_the_stages_in_turn(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "secret_scan", "packing"]
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_tables(spark, sf_dir):
    """No rows, null and repeated rows, and extra columns named like those that stages work out."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep string, spans string, class_id long, g int"
    odd = [(None, None, None, None, None, "k", "s", 1, 2), (1, "", "en", "a", 0, "k", "s", 1, 2), (2, None, "en", "a", 0, None, None, None, None)]
    odd += [(3, "plain words that say nothing in particular about anyone " * 3, "en", "a", 168, "k", "s", 1, 2)] * 2
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            got = docs.collect()
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] or name == "packing"
            assert bool(got) == bool(rows), name
            if name == "minhash_near_dedup":
                assert len([r for r in got if r.doc_id == 3]) == 1 and len(got) == len({(r.text or "") for r in got}) or not rows
