"""Sources, sinks, record preparation and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tokenloom.constants import MAX_LENGTH
from tokenloom.functions.ids import labels_for, completion
from tokenloom.functions.text import HashEncoder, clean
from tokenloom.operators import hooks, prepare, settings, vocab
from tokenloom.operators.packing import record_defaults
from tokenloom.queries.common import (
    BLOCK, CRC, F1, F1_TEXT, F3, PATTERN, VOCAB, digest, select, sql_digest, sql_encode, sql_tokens, widen,
)
from tokenloom.sources import records, views
from tokenloom.sources.workspace import new_folder, stage

ID_SCHEMA = T.StructType([T.StructField("id", T.LongType()), *records.RAW_SCHEMA.fields])
RAW_SQL = select(F1, "SELECT id, instruction, input, output FROM f1")


def scan_jsonl_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "nested")
    raw = views.instruction_records(spark, sf_dir)
    raw.withColumn("part", F.col("id") % 4).write.partitionBy("part").json(f"{folder}/deep")
    return records.read_records(spark, folder, ID_SCHEMA, glob="*.json")


def scan_jsonl_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "flat")
    raw = views.instruction_records(spark, sf_dir)
    raw.write.json(folder)
    raw.write.json(f"{folder}/below")
    return records.read_records(spark, folder, ID_SCHEMA, recursive=False, glob="*.json")


def sink_tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokenized")
    tokens = _tokenized(spark, sf_dir)
    records.write_tokenized(tokens, f"{folder}/out/jsonl")
    schema = T.StructType([T.StructField("id", T.LongType()), *records.TOKENIZED_SCHEMA.fields])
    back = records.read_records(spark, folder, schema, glob="*.json")
    return widen(back.select("id", digest("input_ids").alias("ids"), "prompt_length"))


def _tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.tokenize(views.instruction_records(spark, sf_dir), max_length=MAX_LENGTH)


F1_ENC = f"{CRC}, {F1}, {F1_TEXT}, {sql_encode('enc', 'f1_text', 'id', 'body')}"
def sql_tokenized(most: int) -> str:
    return f"""{F1_ENC},
tokenized AS (
  SELECT id, whole AS input_ids, least(len(regexp_extract_all(prompt, '{PATTERN}')), {most}) AS prompt_length,
    len(whole) AS token_count
  FROM (SELECT id, list_append(ids, 126081)[1:{most}] AS whole FROM enc) JOIN f1_text USING (id)
  WHERE len(whole) < {most})"""


F1_TOKENIZED, F1_SHORT = sql_tokenized(MAX_LENGTH), sql_tokenized(BLOCK)


def clean_fields(spark, sf_dir):
    raw = views.instruction_records(spark, sf_dir)
    return raw.select("id", *[clean(c).alias(c) for c in ("instruction", "input", "output")])


def compose_text(spark, sf_dir):
    return prepare.compose(views.instruction_records(spark, sf_dir)).select("id", "text", "prompt")


def token_encode(spark, sf_dir):
    raw = prepare.compose(views.instruction_records(spark, sf_dir), end_text="")
    ids = prepare.encode_record(HashEncoder(), F.col("text"), 126081, BLOCK)
    return raw.select("id", ids.alias("x")).select(
        "id", F.size("x").cast("bigint").alias("n"), digest("x").alias("ids")
    )


def prompt_length(spark, sf_dir):
    raw = prepare.compose(views.instruction_records(spark, sf_dir))
    n = F.least(HashEncoder().count(F.col("prompt")), F.lit(BLOCK))
    return raw.select("id", n.cast("bigint").alias("prompt_length"))


def token_count(spark, sf_dir):
    return widen(_tokenized(spark, sf_dir).select("id", "token_count"))


def drop_raw_columns(spark, sf_dir):
    done = _tokenized(spark, sf_dir).drop("token_count")
    return widen(done.withColumn("input_ids", digest("input_ids")))


def record_defaults_q(spark, sf_dir):
    rows = record_defaults(views.tokenized(spark, sf_dir))
    return widen(
        rows.select("id", F.size("input_ids").alias("n"), digest("input_ids").alias("ids"), "prompt_length")
    )


def build_labels(spark, sf_dir):
    rows = record_defaults(views.tokenized(spark, sf_dir))
    return rows.select("id", labels_for(F.col("input_ids"), F.col("prompt_length")).alias("labels")).select(
        "id", F.size("labels").cast("bigint").alias("n"), digest("labels").alias("labels")
    )


def completion_slice(spark, sf_dir):
    rows = record_defaults(views.tokenized(spark, sf_dir))
    return rows.select("id", completion(F.col("input_ids"), F.col("prompt_length")).alias("c")).select(
        "id", F.size("c").cast("bigint").alias("n"), digest("c").alias("ids")
    )


SETTINGS = T.StructType(
    [
        T.StructField("k", T.LongType()),
        T.StructField(
            "train",
            T.StructType(
                [
                    T.StructField("rate", T.StringType()),
                    T.StructField("flag", T.StringType()),
                    T.StructField("inner", T.StructType([T.StructField("k", T.LongType())])),
                ]
            ),
        ),
        T.StructField("name", T.StringType()),
    ]
)


def flatten_json(spark, sf_dir):
    """Props nested deeper and joined by text settings; the inner `k` comes later and wins."""
    events = views.table(spark, sf_dir, "events")
    nested = F.concat(
        F.lit('{"k": -1, "train": {"rate": "'),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.col("user_id").cast("string"), F.lit("e-3")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.col("user_id").cast("string"), F.lit(".5")))
        .otherwise(F.concat(F.lit("v."), F.col("user_id").cast("string"))),
        F.lit('", "flag": "'),
        F.when(F.col("user_id") % 2 == 0, F.lit("True")).otherwise(F.lit("FALSE")),
        F.lit('", "inner": '),
        F.col("props"),
        F.lit('}, "name": "'),
        F.col("event_type"),
        F.lit('"}'),
    )
    flat = settings.flatten_json(events.select("event_id", nested.alias("props")), "props", SETTINGS)
    return flat.select(
        "event_id",
        "k",
        F.col("flag.flag").alias("flag"),
        F.col("rate.number").alias("rate"),
        F.col("rate.text").alias("rate_text"),
        F.col("name.text").alias("name"),
    )


FLATTEN_SQL = """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 2 = 0 AS flag,
  CASE event_id % 3 WHEN 0 THEN CAST(user_id || 'e-3' AS DOUBLE) WHEN 1 THEN user_id + 0.5::DOUBLE END AS rate,
  CASE WHEN event_id % 3 = 2 THEN 'v.' || user_id END AS rate_text, event_type AS name
FROM events
"""


def drop_overlong(spark, sf_dir):
    return prepare.tokenize(views.instruction_records(spark, sf_dir), max_length=BLOCK).select("id")


def total_tokens(spark, sf_dir):
    return prepare.token_totals(_tokenized(spark, sf_dir))


def record_count(spark, sf_dir):
    return views.instruction_records(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"))


def global_batch_size(spark, sf_dir):
    return widen(prepare.global_batch(_tokenized(spark, sf_dir), 2, 4, 8, MAX_LENGTH))


def build_vocab(spark, sf_dir):
    return vocab.build_vocab(views.documents(spark, sf_dir))


VOCAB_SQL = f"""{sql_tokens('tok', 'documents', 'doc_id', 'text')},
vocab AS (
  SELECT token, n, token_id FROM (
    SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS token_id FROM (
      SELECT token, count(*) AS n FROM tok GROUP BY token))
  WHERE token_id <= {VOCAB})"""


def encode_with_vocab(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    coded = vocab.vocab_encode(docs, "text", stage(build_vocab(spark, sf_dir), "vocab"))
    return coded.select("id", F.size("input_ids").cast("bigint").alias("n"), digest("input_ids").alias("ids"))


def hash_encode(spark, sf_dir):
    coded = views.documents(spark, sf_dir).select("id", HashEncoder().encode(F.col("text")).alias("x"))
    return coded.select("id", F.size("x").cast("bigint").alias("n"), digest("x").alias("ids"))


def decode_tokens(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    words = stage(vocab.build_vocab(docs), "vocab")
    coded = vocab.vocab_encode(docs, "text", words)
    ended = coded.withColumn("input_ids", F.concat("input_ids", F.array(F.when(F.col("id") % 2 == 0, 126081).otherwise(126348).cast("bigint"))))
    text = vocab.decode(
        ended, words, special={126081: "<|endoftext|>", 126348: "<|eot_id|>"}, skip_special=False
    )
    return text.select("id", F.md5("text").alias("text_md5"))


def map_batches(spark, sf_dir):
    def shorten(batch, least):
        kept = batch[batch["text"].str.len() >= least]
        return kept.assign(n=kept["text"].str.len().astype("int64"))[["id", "n"]]

    return hooks.map_batches(views.documents(spark, sf_dir), shorten, "id bigint, n bigint", least=500)


QUERIES = {
    "scan_jsonl_recursive": (scan_jsonl_recursive, RAW_SQL),
    "scan_jsonl_path": (scan_jsonl_path, RAW_SQL),
    "sink_tokenized": (
        sink_tokenized,
        select(F1_TOKENIZED, f"SELECT id, {sql_digest('input_ids')} AS ids, prompt_length FROM tokenized"),
    ),
    "clean_fields": (
        clean_fields,
        select(F1, "SELECT id, coalesce(instruction, '') AS instruction, coalesce(input, '') AS input, "
                   "coalesce(output, '') AS output FROM f1"),
    ),
    "compose_text": (
        compose_text,
        select(f"{F1}, {F1_TEXT}", "SELECT id, body || '<|endoftext|>' AS text, prompt FROM f1_text"),
    ),
    "token_encode": (
        token_encode,
        select(
            F1_ENC,
            f"SELECT id, len(x) AS n, {sql_digest('x')} AS ids "
            f"FROM (SELECT id, list_append(ids, 126081)[1:{BLOCK}] AS x FROM enc)",
        ),
    ),
    "prompt_length": (
        prompt_length,
        select(
            f"{F1}, {F1_TEXT}",
            f"SELECT id, least(len(regexp_extract_all(prompt, '{PATTERN}')), {BLOCK}) AS prompt_length FROM f1_text",
        ),
    ),
    "token_count": (token_count, select(F1_TOKENIZED, "SELECT id, token_count FROM tokenized")),
    "drop_raw_columns": (
        drop_raw_columns,
        select(F1_TOKENIZED, f"SELECT id, {sql_digest('input_ids')} AS input_ids, prompt_length FROM tokenized"),
    ),
    "record_defaults": (
        record_defaults_q,
        select(F3, f"SELECT id, len(input_ids) AS n, {sql_digest('input_ids')} AS ids, prompt_length FROM f3_clean"),
    ),
    "build_labels": (
        build_labels,
        select(
            F3,
            f"SELECT id, len(l) AS n, {sql_digest('l')} AS labels FROM (SELECT id, list_transform(input_ids, "
            "lambda x, i: CASE WHEN i <= prompt_length THEN -100 ELSE x END) AS l FROM f3_clean)",
        ),
    ),
    "completion_slice": (
        completion_slice,
        select(
            F3,
            f"SELECT id, len(c) AS n, {sql_digest('c')} AS ids "
            "FROM (SELECT id, list_slice(input_ids, prompt_length + 1, len(input_ids)) AS c FROM f3_clean)",
        ),
    ),
    "flatten_json": (flatten_json, FLATTEN_SQL),
    "drop_overlong": (drop_overlong, select(F1_SHORT, "SELECT id FROM tokenized")),
    "total_tokens": (
        total_tokens,
        select(
            F1_TOKENIZED,
            "SELECT count(*) AS records, sum(token_count)::BIGINT AS total_tokens, "
            "round(sum(token_count) / 1e9, 6) AS billions FROM tokenized",
        ),
    ),
    "record_count": (record_count, select(F1, "SELECT count(*) AS records FROM f1")),
    "global_batch_size": (
        global_batch_size,
        select(
            F1_TOKENIZED,
            f"SELECT 64::BIGINT AS global_batch_size, {64 * MAX_LENGTH}::BIGINT AS tokens_per_step, "
            f"(sum(token_count) // {64 * MAX_LENGTH})::BIGINT AS steps_per_epoch, "
            "sum(token_count)::BIGINT AS total_tokens FROM tokenized",
        ),
    ),
    "build_vocab": (build_vocab, select(VOCAB_SQL, "SELECT token, n, token_id FROM vocab")),
    "encode_with_vocab": (
        encode_with_vocab,
        select(
            f"{VOCAB_SQL}, coded AS (SELECT doc_id, list(coalesce(token_id, 0) ORDER BY pos) AS ids "
            "FROM tok LEFT JOIN vocab USING (token) GROUP BY doc_id)",
            f"SELECT doc_id AS id, coalesce(len(ids), 0) AS n, {sql_digest('ids')} AS ids "
            "FROM documents LEFT JOIN coded USING (doc_id)",
        ),
    ),
    "hash_encode": (
        hash_encode,
        select(
            f"{CRC}, {sql_encode('enc', 'documents', 'doc_id', 'text')}",
            f"SELECT doc_id AS id, len(ids) AS n, {sql_digest('ids')} AS ids FROM enc",
        ),
    ),
    "decode_tokens": (
        decode_tokens,
        select(
            f"{VOCAB_SQL}, words AS (SELECT doc_id, string_agg(CASE WHEN token_id IS NULL THEN '<unk>' ELSE token END, "
            "' ' ORDER BY pos) AS t FROM tok LEFT JOIN vocab USING (token) GROUP BY doc_id)",
            "SELECT doc_id AS id, md5(concat_ws(' ', t, CASE WHEN doc_id % 2 = 0 THEN '<|endoftext|>' "
            "ELSE '<|eot_id|>' END)) AS text_md5 FROM documents LEFT JOIN words USING (doc_id)",
        ),
    ),
    "map_batches": (
        map_batches,
        "SELECT doc_id AS id, length(text) AS n FROM documents WHERE length(text) >= 500",
    ),
}
