"""Evaluation requests, prompts, token batches, responses and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.operators import metrics, prompts
from tokenloom.operators.order import number_batches
from tokenloom.operators.packing import record_defaults
from tokenloom.plans import evaluation as plan
from tokenloom.queries.common import CRC, F3, SEED, digest, select, sql_digest, sql_encode, widen
from tokenloom.sources import requests, views
from tokenloom.sources.records import write_samples
from tokenloom.sources.workspace import new_folder

ROWS = 4
PROMPT = 48
SHOTS = 3
BOS = "<|startoftext|>"
UNTIL = ("\n", ".", "")


def requests_table(spark, sf_dir):
    return requests.request_table(views.eval_items(spark, sf_dir))


def sink_eval_samples(spark, sf_dir):
    folder = new_folder(spark, "samples")
    samples = views.answers(spark, sf_dir).withColumn("task", requests.task_name(F.col("item_id")))
    write_samples(samples, folder)
    return spark.read.schema("item_id bigint, response string, task string").json(folder)


def eval_run_matrix(spark, sf_dir):
    items = views.answers(spark, sf_dir).withColumn("task", requests.task_name(F.col("item_id")))
    return widen(requests.run_matrix(items))


def chat_template(spark, sf_dir):
    chat = views.chat(spark, sf_dir)
    asked = prompts.render_chat(chat, add_generation_prompt=True).withColumn("mode", F.lit("ask"))
    continued = prompts.render_chat(chat, add_generation_prompt=False, drop_system=True).withColumn(
        "mode", F.lit("continue")
    )
    return asked.unionByName(continued)


def drop_role(spark, sf_dir):
    return prompts.drop_role(views.chat(spark, sf_dir)).select("conv_id", "turn", "role")


def add_bos(spark, sf_dir):
    return prompts.add_bos(views.eval_items(spark, sf_dir), BOS, "context")


def few_shot_context(spark, sf_dir):
    """Exemplars are the first answers given in conversations; items are all answers' questions."""
    raw = views.instruction_records(spark, sf_dir)
    items = raw.select(F.col("id").alias("item_id"), F.col("instruction").alias("context"))
    pool = raw.select(
        F.col("id").alias("exemplar_id"), F.concat("instruction", F.lit(" => "), "output").alias("example")
    )
    out = prompts.few_shot(items, pool, SHOTS, SEED)
    return out.select("item_id", F.length("context").cast("bigint").alias("n"), F.md5("context").alias("context_md5"))


def _padded(spark, sf_dir):
    items = views.answers(spark, sf_dir).withColumnRenamed("response", "context")
    return plan.padded_batches(items, ROWS, bos=BOS)


def fixed_batches(spark, sf_dir):
    items = views.answers(spark, sf_dir).select("item_id")
    short = number_batches(items, ROWS).select("item_id", "batch_id", F.lit("kept").alias("last"))
    whole = number_batches(items, ROWS, keep_short=False).select("item_id", "batch_id", F.lit("dropped").alias("last"))
    return short.unionByName(whole)


def left_truncate(spark, sf_dir):
    out = prompts.left_truncate(record_defaults(views.tokenized(spark, sf_dir)), PROMPT)
    return widen(out.select("id", F.size("input_ids").alias("n"), digest("input_ids").alias("ids")))


def left_pad_batch(spark, sf_dir):
    out = _padded(spark, sf_dir)
    return out.select(
        "item_id", "batch_id", digest("input_ids").alias("ids"), digest("attention_mask").alias("mask")
    )


def non_pad_mask(spark, sf_dir):
    out = _padded(spark, sf_dir).drop("attention_mask")
    return prompts.pad_mask(out).select("item_id", digest("attention_mask").alias("mask"))


def split_until(spark, sf_dir):
    out = views.answers(spark, sf_dir).select("item_id", prompts.split_until(F.col("response")).alias("terms"))
    return out.select(
        "item_id", F.size("terms").cast("bigint").alias("n"), F.md5(F.array_join("terms", "|")).alias("terms")
    )


def cut_at_stop(spark, sf_dir):
    rows = views.answers(spark, sf_dir)
    cut = prompts.cut_at_stop(rows, F.array(*map(F.lit, UNTIL)), "<|endoftext|>").withColumn("mode", F.lit("cut"))
    kept = prompts.cut_at_stop(rows, F.array(*map(F.lit, UNTIL)), "<|endoftext|>", escape_until=True).withColumn("mode", F.lit("kept"))
    return cut.unionByName(kept)


def cut_at_eos_ids(spark, sf_dir):
    rows = record_defaults(views.tokenized(spark, sf_dir))
    out = prompts.cut_at_eos(rows, 64, 1024)
    return widen(
        out.select("id", "blocks_used", F.size("kept_ids").alias("n"), digest("kept_ids").alias("ids"), "content_length")
    )


def response_join(spark, sf_dir):
    items = views.eval_items(spark, sf_dir)
    return prompts.join_responses(items, views.numbered_answers(spark, sf_dir))


def generate_hook(spark, sf_dir):
    """An echo function in place of a model: each response tells its row's width and ids."""

    def echo(batch):
        width = batch["input_ids"].str.len().max()
        text = [f"{width} {sum(i)}.{len(batch)}" for i in batch["input_ids"]]
        return batch[["item_id"]].assign(response=text, tokens=width)

    items = views.answers(spark, sf_dir).withColumn("until", F.array(*map(F.lit, UNTIL)))
    asked = requests.request_table(items, context="response", settings=["until"])
    samples, _ = plan.evaluate(asked, echo, ROWS, bos=BOS)
    return samples


def batch_tokens(spark, sf_dir):
    return widen(metrics.batch_tokens(_padded(spark, sf_dir)))


def throughput(spark, sf_dir):
    out = metrics.throughput(views.run_log(spark, sf_dir))
    return widen(out.select("tokens", *[F.round(c, 4).alias(c) for c in ("per_rank_second", "per_wall_second")]))


def tokens_per_inference(spark, sf_dir):
    out = metrics.tokens_per_call(views.run_log(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def mean_work_length(spark, sf_dir):
    out = metrics.mean_work_length(views.run_log(spark, sf_dir))
    return out.select(F.round("mean_length", 6).alias("mean_length"))


ANSWERS = """
answers AS (
  SELECT k AS item_id, CASE k % 3 WHEN 0 THEN '.' || text WHEN 1 THEN replace(text, ' ', '<|endoftext|>') ELSE text END AS response
  FROM (SELECT conv_id * 100 + turn AS k, text FROM conversations WHERE role = 'assistant'))
"""

PADDED = f"""
{CRC}, {ANSWERS},
prompted AS (SELECT item_id, '{BOS}' || response AS context FROM answers),
{sql_encode("enc", "prompted", "item_id", "context")},
padded AS (
  SELECT item_id, batch_id, len(ids) AS n, max(len(ids)) OVER (PARTITION BY batch_id) AS width, ids FROM (
    SELECT item_id, ids, (row_number() OVER (ORDER BY item_id) - 1) // {ROWS} AS batch_id FROM enc)),
filled AS (
  SELECT item_id, batch_id, width,
    list_concat(list_transform(range(width - n), lambda i: 0::BIGINT), ids) AS ids,
    list_concat(list_transform(range(width - n), lambda i: 0), list_transform(range(n), lambda i: 1)) AS mask FROM padded)
"""

LOG = """
log AS (
  SELECT user_id % 8 AS rank, event_id // 16 AS batch_id, floor(value)::BIGINT + 1 AS tokens,
    1 + event_id % 5 AS calls, value / 100 AS seconds FROM events)
"""

RUN_SETTINGS = """
(VALUES ('gsm8k', 4, 64, 1024, true), ('gpqa_main_generative_n_shot', 5, 64, 1024, false),
 ('mmlu_generative', 5, 1, 1, true), ('humaneval_instruct', 0, 64, 1024, true), ('mbpp', 3, 64, 1024, true),
 ('bbh', 3, 64, 1024, true), ('minerva_math', 4, 64, 1024, true), ('mmlu_pro', 0, 64, 1024, true))
 t(task, num_fewshot, block_length, max_gen_length, chat)
"""
TASK_LIST = (
    "['gsm8k', 'gpqa_main_generative_n_shot', 'mmlu_generative', 'humaneval_instruct', 'mbpp', 'bbh', "
    "'minerva_math', 'mmlu_pro'][item_id % 8 + 1]"
)

HEAD = "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || trim(text)"

QUERIES = {
    "requests_table": (requests_table, "SELECT item_id, text FROM benchmark"),
    "sink_eval_samples": (
        sink_eval_samples, select(ANSWERS, f"SELECT item_id, response, {TASK_LIST} AS task FROM answers")
    ),
    "eval_run_matrix": (
        eval_run_matrix,
        select(
            ANSWERS,
            f"""
SELECT task, items, num_fewshot::BIGINT AS num_fewshot, block_length::BIGINT AS block_length,
  max_gen_length::BIGINT AS max_gen_length, 0.9::DOUBLE AS confidence_threshold, template_run,
  template_run AND chat AS apply_chat_template
FROM {RUN_SETTINGS} JOIN (SELECT {TASK_LIST} AS task, count(*) AS items FROM answers GROUP BY 1) USING (task),
  (VALUES (true), (false)) m(template_run)""",
        ),
    ),
    "chat_template": (
        chat_template,
        f"""
SELECT conv_id, string_agg({HEAD}, '<|eot_id|>' ORDER BY turn)
  || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt, 'ask' AS mode
FROM conversations GROUP BY conv_id
UNION ALL
SELECT conv_id, string_agg({HEAD}, '<|eot_id|>' ORDER BY turn), 'continue'
FROM conversations WHERE role <> 'system' GROUP BY conv_id""",
    ),
    "drop_role": (drop_role, "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'"),
    "add_bos": (add_bos, f"SELECT item_id, '{BOS}' || text AS context FROM benchmark"),
    "few_shot_context": (
        few_shot_context,
        f"""
WITH raw AS (
  SELECT id, instruction, output FROM (
    SELECT conv_id * 100 + turn AS id, role, text AS output,
      lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS instruction FROM conversations)
  WHERE role = 'assistant'),
pool AS (
  SELECT id AS exemplar_id, instruction || ' => ' || output AS example,
    row_number() OVER (ORDER BY md5('{SEED}:' || id)) - 1 AS slot, count(*) OVER () AS total FROM raw),
shots AS (
  SELECT r.id AS item_id, shot, shot * total // {SHOTS} AS low, (shot + 1) * total // {SHOTS} - shot * total // {SHOTS} AS width,
    ('0x' || substr(md5('{SEED}:' || r.id || ':' || shot), 1, 8))::BIGINT AS word, own.slot AS own_slot
  FROM raw r JOIN pool own ON own.exemplar_id = r.id, (SELECT unnest(range({SHOTS})) AS shot)),
slots AS (
  SELECT item_id, shot, low + CASE WHEN low + word % width = own_slot THEN (word % width + 1) % width
    ELSE word % width END AS slot FROM shots WHERE width > 0),
contexts AS (
  SELECT item_id, string_agg(example || chr(10) || chr(10), '' ORDER BY shot) AS head
  FROM slots JOIN pool USING (slot) GROUP BY item_id)
SELECT id AS item_id, length(coalesce(head, '') || instruction) AS n, md5(coalesce(head, '') || instruction) AS context_md5
FROM raw LEFT JOIN contexts ON item_id = id""",
    ),
    "fixed_batches": (
        fixed_batches,
        select(
            f"{ANSWERS}, n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS c FROM answers)",
            f"SELECT item_id, i // {ROWS} AS batch_id, 'kept' AS last FROM n UNION ALL "
            f"SELECT item_id, i // {ROWS}, 'dropped' FROM n WHERE i < c - c % {ROWS}",
        ),
    ),
    "left_truncate": (
        left_truncate,
        select(
            F3,
            f"SELECT id, least(len(input_ids), {PROMPT}) AS n, {sql_digest(f'input_ids[-{PROMPT}:]')} AS ids "
            "FROM f3_clean",
        ),
    ),
    "left_pad_batch": (
        left_pad_batch,
        select(PADDED, f"SELECT item_id, batch_id, {sql_digest('ids')} AS ids, {sql_digest('mask')} AS mask FROM filled"),
    ),
    "non_pad_mask": (non_pad_mask, select(PADDED, f"SELECT item_id, {sql_digest('mask')} AS mask FROM filled")),
    "split_until": (
        split_until,
        select(
            ANSWERS,
            "SELECT item_id, len(string_split(response, ' ')) AS n, md5(replace(response, ' ', '|')) AS terms FROM answers",
        ),
    ),
    "cut_at_stop": (
        cut_at_stop,
        select(
            ANSWERS,
            "SELECT item_id, split_part(split_part(split_part(split_part(response, '<|endoftext|>', 1), chr(10), 1), "
            "'.', 1), '<|eot_id|>', 1) AS response, 'cut' AS mode FROM answers "
            "UNION ALL SELECT item_id, response, 'kept' FROM answers",
        ),
    ),
    "cut_at_eos_ids": (
        cut_at_eos_ids,
        select(
            F3,
            f"""
SELECT id, blocks_used, len(input_ids[:least(blocks_used * 64, 1024)]) AS n,
  {sql_digest('input_ids[:least(blocks_used * 64, 1024)]')} AS ids, content_length
FROM (
  SELECT id, input_ids, ceil(CASE WHEN hit IS NULL THEN least(len(input_ids), 1024) ELSE hit END / 64.0)::BIGINT AS blocks_used,
    CASE WHEN hit IS NULL THEN least(len(input_ids), 1024) ELSE hit - 1 END AS content_length
  FROM (SELECT id, input_ids, list_min(list_filter(list_transform(input_ids[:1024],
      lambda x, i: CASE WHEN x IN (126081, 126348) THEN i END), lambda x: x IS NOT NULL)) AS hit
    FROM f3_clean))""",
        ),
    ),
    "response_join": (
        response_join,
        select(
            ANSWERS,
            "SELECT b.item_id, b.text AS context, a.response FROM benchmark b LEFT JOIN ("
            "SELECT row_number() OVER (ORDER BY item_id) - 1 AS item_id, response FROM answers) a USING (item_id)",
        ),
    ),
    "generate_hook": (
        generate_hook,
        select(PADDED, "SELECT item_id, width || ' ' || list_sum(ids)::BIGINT AS response FROM filled"),
    ),
    "batch_tokens": (
        batch_tokens,
        select(PADDED, "SELECT batch_id, sum(width)::BIGINT AS tokens FROM filled GROUP BY batch_id"),
    ),
    "throughput": (
        throughput,
        select(
            LOG,
            "SELECT sum(t)::BIGINT AS tokens, round(sum(t) / sum(s), 4) AS per_rank_second, "
            "round(sum(t) / max(s), 4) AS per_wall_second "
            "FROM (SELECT rank, sum(tokens) AS t, sum(seconds) AS s FROM log GROUP BY rank)",
        ),
    ),
    "tokens_per_inference": (
        tokens_per_inference,
        select(
            LOG,
            "SELECT round(avg(m), 6) AS rank_mean, round(sum(t) / sum(c), 6) AS weighted_mean FROM ("
            "SELECT rank, avg(t / c) AS m, sum(t) AS t, sum(c) AS c FROM ("
            "SELECT rank, batch_id, sum(tokens) AS t, sum(calls) AS c FROM log GROUP BY ALL) GROUP BY rank)",
        ),
    ),
    "mean_work_length": (
        mean_work_length, select(LOG, "SELECT round(sum(tokens) / sum(calls), 6) AS mean_length FROM log")
    ),
}
