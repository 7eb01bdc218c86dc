"""Evaluation requests and the table of evaluation runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The evaluation tasks with their few-shot count, block length, generation length
# and whether the templated run renders them as chat.
TASKS = (
    ("gsm8k", 4, 64, 1024, True),
    ("gpqa_main_generative_n_shot", 5, 64, 1024, False),
    ("mmlu_generative", 5, 1, 1, True),
    ("humaneval_instruct", 0, 64, 1024, True),
    ("mbpp", 3, 64, 1024, True),
    ("bbh", 3, 64, 1024, True),
    ("minerva_math", 4, 64, 1024, True),
    ("mmlu_pro", 0, 64, 1024, True),
)


def request_table(
    df: DataFrame, item: str = "item_id", context: str = "context", settings: Sequence[str] = ()
) -> DataFrame:
    """One row per request: its id, the context text and its own generation settings (`until`, a length, ...)."""
    return df.select(F.col(item).alias("item_id"), F.col(context).alias("text"), *settings)


def task_name(item: Column, tasks: Sequence[tuple] = TASKS) -> Column:
    """Deal items to tasks by id."""
    names = F.array(*[F.lit(t[0]) for t in tasks])
    return F.get(names, F.pmod(item, F.lit(len(tasks))).cast("int"))


def run_matrix(
    items: DataFrame,
    tasks: Sequence[tuple] = TASKS,
    templates: Sequence[bool] = (True, False),
    threshold: float = 0.9,
) -> DataFrame:
    """Runs per task and setting with the number of items each covers; `items` has a `task` column.

    The settings ride along as a constant array per task, so no join is made. Items of a task without settings
    keep one row with null settings.
    """
    settings = F.create_map(
        *[
            value
            for name, shots, block, length, chat in tasks
            for value in (
                F.lit(name),
                F.array(
                    *[
                        F.struct(
                            F.lit(shots).alias("num_fewshot"),
                            F.lit(block).alias("block_length"),
                            F.lit(length).alias("max_gen_length"),
                            F.lit(threshold).alias("confidence_threshold"),
                            F.lit(with_template).alias("template_run"),
                            F.lit(with_template and chat).alias("apply_chat_template"),
                        )
                        for with_template in templates
                    ]
                ),
            )
        ]
    )
    counted = items.groupBy("task").agg(F.count("*").alias("items"))
    return counted.select("task", "items", F.inline_outer(settings[F.col("task")]))
