"""Sources, record preparation, vocabularies, settings."""

import json
import re
import zlib

import pytest
from pyspark.sql import Observation, functions as F, types as T

from tokenloom.functions.ids import completion, labels_for, positions
from tokenloom.functions.text import coerce_text
from tokenloom.operators import hooks, prepare, settings, vocab
from tokenloom.sources import records

RAW = "id bigint, instruction string, input string, output string"


def words(text):
    return re.findall(r"\w+|[^\w\s]", text)


def test_read_nested_jsonl(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    lines = [{"instruction": "é", "input": None, "output": "x"}, {"instruction": "two"}]
    (tmp_path / "a" / "b" / "one.jsonl").write_text("\n".join(json.dumps(x) for x in lines), encoding="utf-8")
    (tmp_path / "top.jsonl").write_text(json.dumps({"instruction": "", "input": "in", "output": "out"}))
    (tmp_path / "a" / "skip.txt").write_text(json.dumps({"instruction": "no"}))
    deep = records.read_records(spark, str(tmp_path))
    assert {(r.instruction, r.input, r.output) for r in deep.collect()} == {
        ("é", None, "x"), ("two", None, None), ("", "in", "out")
    }
    assert len({r.id for r in deep.collect()}) == 3
    assert [r.output for r in records.read_records(spark, str(tmp_path), recursive=False).collect()] == ["out"]
    assert records.read_records(spark, str(tmp_path / "top.jsonl"), recursive=False).count() == 1


def test_tokenized_sink_keeps_text_readable(spark, tmp_path):
    rows = spark.createDataFrame([(1, [5, 6], 1, 2)], "id bigint, input_ids array<bigint>, prompt_length int, token_count int")
    records.write_tokenized(rows, str(tmp_path / "new" / "out"))
    back = records.read_records(spark, str(tmp_path), records.TOKENIZED_SCHEMA, glob="*.json")
    assert [(r.input_ids, r.prompt_length) for r in back.collect()] == [([5, 6], 1)]
    samples = spark.createDataFrame([("one", "ü")], "task string, response string")
    records.write_samples(samples, str(tmp_path / "utf"))
    assert ["ü" in p.read_text(encoding="utf-8") for p in tmp_path.glob("utf/task=one/*.json")] == [True]


def test_tokenize_edges(spark):
    full = "a b c d e f"  # six tokens and the end id make seven
    rows = [
        (1, full, None, None), (2, "a", " b", " c"), (3, None, None, None), (4, "", "", ""),
        (5, full + " g", None, None), (6, "ab", None, "cd"),
    ]
    out = {r.id: r for r in prepare.tokenize(spark.createDataFrame(rows, RAW), max_length=8).collect()}
    assert set(out) == {1, 2, 3, 4, 6}, "a record that fills max_length exactly is dropped"
    assert out[1].token_count == 7 and out[1].prompt_length == 6
    assert out[2].input_ids[-1] == 126081 and out[2].prompt_length == 2
    assert out[3].input_ids == [126081] == out[4].input_ids and out[3].prompt_length == 0
    # No separator: "ab" + "cd" is one token, although the prompt alone is one token as well.
    assert out[6].token_count == 2 and out[6].prompt_length == 1
    assert out[2].input_ids[:3] == [1 + zlib.crc32(w.encode()) % 120000 for w in "abc"]


def test_tokenize_with_vocabulary(spark):
    rows = spark.createDataFrame([(1, "a b", None, " a c"), (2, "a a a a a a", None, ""), (3, None, None, None)], RAW)
    words = vocab.build_vocab(spark.createDataFrame([("a a b",)], "text string"))
    out = {r.id: (r.input_ids, r.prompt_length) for r in prepare.tokenize_with_vocab(rows, words, 7).collect()}
    assert out == {1: ([1, 2, 1, 0, 126081], 2), 3: ([126081], 0)}


def test_tokenize_encodes_once(spark):
    rows = spark.createDataFrame([(1, "a b", None, "c")], RAW).repartition(2)
    plan = prepare.tokenize(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("crc32") == 1


def test_observed_totals(spark):
    seen = Observation("totals")
    rows = spark.createDataFrame([(i, "a b", None, "c") for i in range(10)], RAW)
    prepare.tokenize(rows, observation=seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"records": 10, "tokens": 30}
    totals = prepare.token_totals(prepare.tokenize(rows)).collect()[0]
    assert (totals.records, totals.total_tokens) == (10, 30)


def test_labels_and_completion(spark):
    rows = spark.createDataFrame(
        [(1, [7, 8, 9], 2), (2, [7, 8, 9], 9), (3, [], 4), (4, [7], 0)], "id bigint, ids array<bigint>, p int"
    )
    got = {
        r.id: (r.l, r.c)
        for r in rows.select(
            "id", labels_for(F.col("ids"), F.col("p")).alias("l"), completion(F.col("ids"), F.col("p")).alias("c")
        ).collect()
    }
    assert got == {1: ([-100, -100, 9], [9]), 2: ([-100] * 3, []), 3: ([], []), 4: ([7], [7])}
    assert rows.select(positions(F.col("ids"), lambda x: x > 7).alias("x")).collect()[0].x == [1, 2]


def test_vocab(spark):
    texts = ["b a a ,", "c b a", "", "zz ,", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    ranks = {r.token: (r.n, r.token_id) for r in vocab.build_vocab(docs).collect()}
    assert ranks == {"a": (3, 1), ",": (2, 2), "b": (2, 3), "c": (1, 4), "zz": (1, 5)}
    top = vocab.build_vocab(docs, max_vocab=3)
    assert {r.token for r in top.collect()} == {"a", ",", "b"}
    coded = vocab.vocab_encode(docs, "text", top)
    ids = {r.id: r.input_ids for r in coded.collect()}
    assert ids == {0: [3, 1, 1, 2], 1: [0, 3, 1], 2: [], 3: [0, 2], 4: []}
    marked = coded.withColumn("input_ids", F.concat("input_ids", F.array(F.lit(126081).cast("bigint"))))
    kept = vocab.decode(marked, top, special={126081: "<end>"})
    skipped = vocab.decode(marked, top, special={126081: "<end>"}, skip_special=True)
    assert {r.id: r.text for r in kept.collect()} == {
        0: "b a a , <end>", 1: "<unk> b a <end>", 2: "<end>", 3: "<unk> , <end>", 4: "<end>"
    }
    assert {r.id: r.text for r in skipped.collect()}[1] == "<unk> b a"


def test_vocab_many_counts(spark):
    """Levels with one count each and levels of powers of two keep the order of a plain sort."""
    docs = spark.range(400).select("id", F.expr("repeat(concat('w', id % 211, ' '), cast(id % 170 as int))").alias("text"))
    counts = {}
    for r in docs.collect():
        for w in words(r.text):
            counts[w] = counts.get(w, 0) + 1
    want = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    for limit in (len(want), 50):
        got = vocab.build_vocab(docs, max_vocab=limit).orderBy("token_id").collect()
        assert [r.token for r in got] == want[:limit]


def test_encoding_exchanges_nothing(spark, tmp_path):
    spark.range(100).select("id", F.lit("a b a").alias("text")).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    words = vocab.build_vocab(docs)
    coded = vocab.vocab_encode(docs, "text", words)
    for table in (coded, vocab.decode(coded, words)):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    assert {r.text for r in vocab.decode(coded, words).collect()} == {"a b a"}


@pytest.mark.parametrize(
    "text,flag,number,kept",
    [
        ("True", True, None, None), ("FALSE", False, None, None), ("1e-3", None, 0.001, None),
        ("2.5", None, 2.5, None), ("1E5", None, None, "1E5"), ("12", None, None, "12"), ("tree", None, None, "tree"),
        ("v.1", None, None, "v.1"), ("1_0.5", None, 10.5, None), (".5", None, 0.5, None), ("e", None, None, "e"),
        ("1.", None, 1.0, None), ("1.5d", None, None, "1.5d"), (None, None, None, None),
    ],
)
def test_coerce_text(spark, text, flag, number, kept):
    row = spark.createDataFrame([(text,)], "x string").select(coerce_text(F.col("x")).alias("c")).collect()[0].c
    assert (row.flag, row.number, row.text) == (flag, number, kept)


def test_flatten_json(spark):
    schema = T.StructType.fromDDL("a struct<k: bigint, b: struct<name: string>>, k bigint, on string")
    df = spark.createDataFrame([(1, '{"a": {"k": 1, "b": {"name": "x"}}, "k": 2, "on": "true"}')], "id int, props string")
    row = settings.flatten_json(df, "props", schema).collect()[0].asDict(recursive=True)
    assert row["k"] == 2 and row["name"]["text"] == "x" and row["on"]["flag"] is True
    assert set(row) == {"id", "k", "name", "on"}


def test_map_batches_drops_rows(spark):
    df = spark.range(20)
    out = hooks.map_batches(df, lambda b, least: b[b.id >= least], "id bigint", least=15)
    assert out.count() == 5


def test_vocabulary_is_never_cut(spark):
    docs = spark.createDataFrame([(1, "a a b c")], "id bigint, text string")
    words = vocab.build_vocab(docs)
    with pytest.raises(ValueError, match="max_vocab"):
        vocab.vocab_encode(docs, "text", words, max_vocab=2)
    with pytest.raises(ValueError, match="max_vocab"):
        vocab.decode(docs.selectExpr("id", "array(1L) AS input_ids"), words, max_vocab=2)
    known = spark.createDataFrame([("a", 1)], "token string, token_id bigint")
    assert vocab.vocab_encode(docs, "text", known).first().input_ids == [1, 1, 0, 0]


def test_ranking_needs_no_single_task_over_tokens(spark):
    """Only the counts per level meet in one task; tokens and their beginnings are numbered by key."""
    words = " ".join(chr(97 + i % 26) + chr(97 + i // 26) + "x" * (i % 3) for i in range(600))
    docs = spark.createDataFrame([(words + " a b é 中",)], "text string")
    got = [(r.n, r.token) for r in vocab.build_vocab(docs).orderBy("token_id").collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1].encode())) and len(got) == len(set(words.split())) + 4


def test_single_file_of_any_name(spark, tmp_path):
    line = '{"instruction": "a", "output": "b"}\n'
    (tmp_path / "data.ndjson").write_text(line * 3)
    assert records.read_records(spark, str(tmp_path / "data.ndjson")).count() == 3
    folder = tmp_path / "x.json"
    folder.mkdir()
    (folder / "1.jsonl").write_text(line)
    (folder / "2.txt").write_text("no record\n")
    assert records.read_records(spark, str(folder)).count() == 1


def test_broken_lines_are_errors(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction": "a"}\n{"instruction": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        records.read_records(spark, str(tmp_path)).collect()
    assert records.read_records(spark, str(tmp_path), mode="DROPMALFORMED").count() == 1


def test_record_ids_follow_content(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join('{"instruction": "q%d"}\n' % (i % 40) for i in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("64m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append(sorted((r.id, r.instruction) for r in records.read_records(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] and len({i for i, _ in seen[0]}) == 400


def test_training_with_other_tokenizers(spark):
    import functools

    from tokenloom.plans.training import training_blocks

    raw = spark.createDataFrame([(i, "a b ", None, "c d e") for i in range(8)], "id bigint, instruction string, input string, output string")
    words = spark.createDataFrame([(w, i + 1) for i, w in enumerate("abcde")], "token string, token_id bigint")
    by_vocab = functools.partial(prepare.tokenize_with_vocab, vocab=words)
    by_batch = functools.partial(prepare.tokenize_with, encode=lambda texts: [[ord(c) - 96 for c in t if c != " "] for t in texts])
    for make in (lambda df, n: by_vocab(df, max_length=n), lambda df, n: by_batch(df, max_length=n)):
        blocks = training_blocks(raw, 6, 1, tokenizer=make).orderBy("chunk_id").collect()
        assert len(blocks) == 8
        for r in blocks:
            assert len(r.input_ids) == 6 and set(r.input_ids) <= {1, 2, 3, 4, 5, 126081, 126336}
    got = by_batch(raw).first()
    assert got.input_ids == [1, 2, 3, 4, 5, 126081] and got.prompt_length == 2


def test_stage_folder_on_a_cluster_must_be_named():
    from types import SimpleNamespace

    from tokenloom.sources.workspace import new_folder

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        new_folder(session, "x")


def test_epochs_follow_from_steps(spark):
    from tokenloom.plans.training import training_blocks

    raw = spark.createDataFrame([(i, "a b ", None, "c d e") for i in range(8)], "id bigint, instruction string, input string, output string")
    blocks = training_blocks(raw, 6, 2, max_steps=10)
    assert blocks.agg(F.max("epoch")).first()[0] == 2  # 48 tokens an epoch, 120 are needed


def test_two_system_messages_make_no_second_record(spark, tmp_path):
    from tokenloom.sources.views import instruction_records

    rows = [(1, 0, "system", "a"), (1, 1, "system", "b"), (1, 2, "user", "q"), (1, 3, "assistant", "r")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in instruction_records(spark, str(tmp_path)).collect()] == [(103, "q", "b", "r")]
