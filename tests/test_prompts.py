"""Prompt assembly, token batches, responses."""

from pyspark.sql import functions as F

from tokenloom.operators import prompts
from tokenloom.plans.evaluation import padded_batches, responses
from tokenloom.sources import requests

TEMPLATE = prompts.ChatTemplate("<", ">", ";", "bot")


def test_chat(spark):
    rows = [(1, 2, "user", "more"), (1, 0, "system", "be"), (1, 1, "user", " hi "), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    full = {r.conv_id: r.prompt for r in prompts.render_chat(df, TEMPLATE).collect()}
    assert full == {1: "<system>be;<user>hi;<user>more;<bot>", 2: "<user>;<bot>"}
    bare = prompts.render_chat(df, TEMPLATE, add_generation_prompt=False, drop_system=True)
    assert {r.conv_id: r.prompt for r in bare.collect()} == {1: "<user>hi;<user>more", 2: "<user>"}


def test_few_shot_draws(spark):
    items = spark.range(40).select(F.col("id").alias("item_id"), F.concat(F.lit("Q"), "id").alias("context"))
    pool = spark.range(30).select(F.col("id").alias("exemplar_id"), F.concat(F.lit("E"), "id").alias("example"))
    for k in (1, 4):
        for r in prompts.few_shot(items, pool, k, seed=3).collect():
            parts = r.context.split("\n\n")
            assert parts[-1] == f"Q{r.item_id}" and len(parts) == k + 1
            assert len(set(parts)) == k + 1 and f"E{r.item_id}" not in parts
    small = prompts.few_shot(items, pool.limit(2), 5).collect()
    assert len(small) == 40 and all(len(r.context.split("\n\n")) == 3 for r in small)
    empty = prompts.few_shot(items, pool.limit(0), 2).collect()
    assert {r.context for r in empty} == {f"Q{i}" for i in range(40)}
    seeds = [
        {(r.item_id, r.context) for r in prompts.few_shot(items, pool, 2, seed=s).collect()} for s in (1, 1, 2)
    ]
    assert seeds[0] == seeds[1] != seeds[2]


def test_few_shot_meets_no_pool(spark):
    items = spark.range(40).select(F.col("id").alias("item_id"), F.lit("q").alias("context"))
    pool = spark.range(30).select(F.col("id").alias("exemplar_id"), F.lit("e").alias("example"))
    plan = prompts.few_shot(items, pool, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_cut_at_stop(spark):
    cases = ["a.b", ".x", "one\ntwo.", "x<|eot_id|>y", "x<|end|>.y", "", "plain", None]
    df = spark.createDataFrame(list(enumerate(cases)), "item_id bigint, response string")
    until = F.array(F.lit("\n"), F.lit("."), F.lit(""))
    got = [r.response for r in prompts.cut_at_stop(df, until, "<|end|>").orderBy("item_id").collect()]
    assert got == ["a", "", "one", "x", "x", "", "plain", None]
    assert prompts.cut_at_stop(df, until, "<|end|>", escape_until=True).orderBy("item_id").collect()[0].response == "a.b"
    split = spark.range(1).select(prompts.split_until(F.lit("a b  c")).alias("s")).collect()[0].s
    assert split == ["a", "b", "", "c"]


def test_cut_at_eos(spark):
    rows = [(1, [1, 2, 3, 4, 126081, 5, 6, 7]), (2, [1, 2, 3]), (3, list(range(20))), (4, []), (5, [126348]),
            (6, [1] * 12 + [126081])]
    df = spark.createDataFrame(rows, "id bigint, input_ids array<bigint>")
    got = {r.id: (r.blocks_used, len(r.kept_ids), r.content_length) for r in prompts.cut_at_eos(df, 4, 13).collect()}
    assert got == {1: (2, 8, 4), 2: (1, 3, 3), 3: (3, 12, 12), 4: (0, 0, 0), 5: (1, 1, 0), 6: (3, 12, 12)}


def test_padding_and_generation(spark):
    items = spark.createDataFrame(
        [(i, " ".join("abcdefgh"[: 1 + i % 8])) for i in range(10)], "item_id bigint, context string"
    )
    padded = padded_batches(items, 4, 5)
    rows = {r.item_id: r for r in padded.collect()}
    for batch in range(3):
        inside = [r for r in rows.values() if r.batch_id == batch]
        width = max(min(5, 1 + r.item_id % 8) for r in inside)
        for r in inside:
            real = min(5, 1 + r.item_id % 8)
            assert len(r.input_ids) == width == len(r.attention_mask)
            assert r.attention_mask == [0] * (width - real) + [1] * real
            assert r.input_ids[: width - real] == [0] * (width - real)
    assert prompts.pad_mask(padded.drop("attention_mask")).where("item_id = 0").collect()[0].attention_mask == rows[0].attention_mask

    def count_rows(batch):
        return batch[["item_id"]].assign(response=f"{len(batch)}.rest")

    out = responses(padded, count_rows, F.array(F.lit(".")))
    assert sorted((r.item_id, r.response) for r in out.collect()) == [(i, "4" if i < 8 else "2") for i in range(10)]


def test_run_matrix(spark):
    items = spark.range(20).withColumn("task", requests.task_name(F.col("id")))
    runs = requests.run_matrix(items).collect()
    assert len(runs) == 16 and sum(r.items for r in runs) == 40
    assert {(r.task, r.num_fewshot) for r in runs} == {(t[0], t[1]) for t in requests.TASKS}
    assert not any(r.apply_chat_template for r in runs if r.task.startswith("gpqa"))


def test_nothing_vanishes_without_role_or_task(spark):
    chat = spark.createDataFrame([(1, 0, None, "hello"), (1, 1, "system", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert "hello" in prompts.render_chat(chat).first().prompt
    assert prompts.drop_role(chat).count() == 1
    items = spark.createDataFrame([("gsm8k", 1), ("arc", 2), ("arc", 3)], "task string, item_id bigint")
    got = [(r.task, r.items, r.num_fewshot) for r in requests.run_matrix(items, templates=(True,)).collect()]
    assert sorted(got, key=str) == [("arc", 2, None), ("gsm8k", 1, 4)]


def test_evaluation_from_requests_to_samples_and_log(spark):
    from tokenloom.operators.metrics import throughput
    from tokenloom.plans.evaluation import evaluate

    rows = [(i, "ask " * (i + 1), ["#"] if i % 2 else ["!"]) for i in range(10)]
    items = spark.createDataFrame(rows, "item_id bigint, context string, until array<string>")
    asked = requests.request_table(items, settings=["until"])

    def echo(batch):
        return batch[["item_id"]].assign(response=[f"{len(i)}!x#y" for i in batch["input_ids"]], tokens=3)

    samples, log = evaluate(asked, echo, 4, world_size=2)
    width = [4, 4, 4, 4, 8, 8, 8, 8, 10, 10]
    assert {r.item_id: r.response for r in samples.collect()} == {i: f"{w}!x" if i % 2 else str(w) for i, w in enumerate(width)}
    assert sorted((r.rank, r.batch_id, r.tokens, r.calls) for r in log.collect()) == [(0, 0, 12, 1), (0, 2, 6, 1), (1, 1, 12, 1)]
    assert throughput(log).first().tokens == 30
    joined, _ = evaluate(asked.withColumn("until", F.lit("x #")), echo, 4)
    assert {r.response for r in joined.collect()} == {f"{w}!" for w in width}
