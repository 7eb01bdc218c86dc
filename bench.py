"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose data and cores. Every
query's whole result is computed and thrown away (`noop` sink), once to warm up and once timed.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from tokenloom.operators import noising, order, packing, prepare, select, vocab
    from tokenloom.plans.training import training_blocks
    from tokenloom.queries import REGISTRY
    from tokenloom.sources import views
    from tokenloom.sources.workspace import stage

    raw = views.document_records(spark, SF_DIR)
    # Packing and noising are timed over a stage table of tokens, as in the baseline's probes.
    records = stage(packing.with_token_count(views.tokenized(spark, SF_DIR)), "tokenized")
    ordered = order.assign_shards(order.order_epochs(records), 1)
    blocks = stage(packing.pack(ordered, 256, 1), "blocks")
    tokens = records.agg(F.sum("n_tokens")).collect()[0][0]
    docs = views.documents(spark, SF_DIR)

    def registered(name):
        return lambda: REGISTRY[name][0](spark, SF_DIR)

    runs = {
        "tokenize_hash": lambda: prepare.tokenize(raw),
        "build_vocab": lambda: vocab.build_vocab(docs),
        "encode_with_vocab": registered("encode_with_vocab"),
        "pack_batches_256": lambda: packing.pack(ordered, 256, 4),
        "pack_batches_8192": lambda: packing.pack(ordered, 8192, 2),
        "batch_counts": lambda: packing.batch_counts(ordered, 256, 4),
        "noise_blocks": lambda: noising.noise(blocks),
        "training_blocks": lambda: training_blocks(raw, 256, 4),
        "training_blocks_2_epochs_4_shards": lambda: training_blocks(raw, 256, 4, epochs=2, world_size=4),
        "left_pad_batch": registered("left_pad_batch"),
        "chat_template": registered("chat_template"),
        "few_shot_context": registered("few_shot_context"),
        "threshold_or_top1": lambda: select.pick_threshold(select.confidence(views.scores(spark, SF_DIR))),
        "stability": registered("stability"),
        "flatten_json": registered("flatten_json"),
    }
    chosen = sys.argv[1:] or list(runs)
    seconds = {}
    for name in chosen:
        for _ in range(2):
            started = time.time()
            runs[name]().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "document_tokens": tokens,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
