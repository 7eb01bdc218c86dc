"""Inference hooks: placed in barrier tasks, run logs, prompts with exemplars, chat and a tokenizer of the user's own."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import hooks, metrics, prepare, prompts, vocab
from tokenloom.plans import evaluation

PADDED = "item_id bigint, batch_id bigint, input_ids array<bigint>"


def padded(spark, n=23, size=4):
    return spark.createDataFrame([(i, i // size, [i] * 5) for i in range(n)], PADDED).repartition(5)


@pytest.mark.parametrize("barrier", [False, True])
def test_placed_inference_gets_whole_batches_in_so_many_tasks(spark, barrier):
    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        from pyspark import BarrierTaskContext, TaskContext

        context = BarrierTaskContext.get() if barrier else TaskContext.get()
        peers = len(context.getTaskInfos()) if barrier else -1
        return pd.DataFrame({"item_id": batch["item_id"], "rows": len(batch), "batch": batch["batch_id"].iloc[0], "task": context.partitionId(), "peers": peers})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # batches lie across Arrow batches
    try:
        out = hooks.generate_placed(padded(spark), fn, "item_id bigint, rows bigint, batch bigint, task int, peers int", 3, barrier)
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r.item_id for r in got) == list(range(23))
    assert all(r.batch == r.item_id // 4 and r.rows == (3 if r.batch == 5 else 4) for r in got)
    assert {r.task for r in got} <= {0, 1, 2} and {r.peers for r in got} == {3 if barrier else -1}
    assert len({(r.batch, r.task) for r in got}) == 6
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == plan.count("REPARTITION_BY_NUM") == 1


def test_resource_profile_reaches_the_stage(spark):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(1)).build
    out = hooks.generate_placed(padded(spark), lambda b: b[["item_id"]], "item_id bigint", 2, profile=profile)
    node = out._jdf.queryExecution().executedPlan()
    text = node.toString()
    assert "MapInArrow" in text
    found = []

    def walk(plan):
        if "MapInArrow" in plan.nodeName():
            found.append(plan.profile().get().id())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))
        if "Adaptive" in plan.nodeName():
            walk(plan.inputPlan())

    walk(node)
    assert found and set(found) == {profile.id}


def test_log_counts_rows_times_width_by_default(spark):
    by_ids = hooks.generate_logged(padded(spark), lambda b: b[["item_id"]].assign(response="x", output_ids=[[1] * (i % 7) for i in b["item_id"]]))
    want = {b: sum(1 for i in range(23) if i // 4 == b) * max(i % 7 for i in range(23) if i // 4 == b) for b in range(6)}
    assert {r.batch_id: r.t for r in by_ids.groupBy("batch_id").agg(F.sum("tokens").alias("t")).collect()} == want
    by_text = hooks.generate_logged(padded(spark), lambda b: b[["item_id"]].assign(response=["a, b" * (i % 3) if i else None for i in b["item_id"]]))
    assert {r.batch_id: r.t for r in by_text.groupBy("batch_id").agg(F.sum("tokens").alias("t")).collect()}[1] == 4 * 5
    told = hooks.generate_logged(padded(spark), lambda b: b[["item_id"]].assign(response="", tokens=2, calls=1))
    assert told.agg(F.sum("tokens"), F.sum("calls")).first()[:] == (46, 23)


def test_prompts_are_put_together_and_the_log_feeds_throughput(spark):
    asked = spark.createDataFrame([(i, f" q{i} ", "STOP") for i in range(9)] + [(9, None, None)], "item_id bigint, text string, until string")
    pool = spark.createDataFrame([(100 + i, f"e{i}") for i in range(6)], "exemplar_id bigint, example string")
    template = prompts.ChatTemplate("<", ">", ";", "bot")
    made = evaluation.assemble(asked, pool, 2, template)
    for r in made.where("item_id < 9").collect():
        assert r.context.startswith("<user>e") and r.context.endswith(f" q{r.item_id};<bot>") and r.context.count("\n\n") == 2
    assert evaluation.assemble(asked).where("item_id = 3").first().context == " q3 "

    def letters(texts):
        return [[ord(c) for c in t] for t in texts]

    def echo(batch):
        text = ["".join(chr(x) for x in ids if x) + "STOP rest" for ids in batch["input_ids"]]
        return batch[["item_id"]].assign(response=text)

    samples, log = evaluation.evaluate(asked, echo, 4, bos="^", world_size=2, tokenizer=letters, exemplars=pool, shots=1, template=template)
    got = {r.item_id: r.response for r in samples.collect()}
    assert all(got[i].startswith("^<user>e") and got[i].endswith(f"q{i};<bot>") for i in range(9))
    assert "rest" in got[9] and len(got) == 10
    assert {(r.rank, r.batch_id) for r in log.collect()} == {(0, 0), (1, 1), (0, 2)}
    speed = metrics.throughput(log).first()
    assert speed.tokens > 0 and speed.per_wall_second >= speed.per_rank_second > 0


def test_prompt_lengths_are_those_of_the_vocabulary(spark):
    raw = spark.createDataFrame([(1, "a b", None, "c"), (2, None, None, "d"), (3, "", "x!", "")], "id bigint, instruction string, input string, output string")
    words = vocab.build_vocab(raw.selectExpr("concat_ws(' ', instruction, input, output) text"))
    got = {r.id: (len(r.input_ids), r.prompt_length) for r in prepare.tokenize_with_vocab(raw, words).collect()}
    own = vocab.vocab_encode(prepare.compose(raw, "").select("id", "prompt"), "prompt", words)
    assert {i: p for i, (_, p) in got.items()} == {r.id: len(r.input_ids) for r in own.collect()}
