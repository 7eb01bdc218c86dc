"""The entry points, started from another folder as a fresh process."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
blocks = entry.entry(spark)
rows = blocks.collect()
assert rows and all(len(r.input_ids) == 256 == len(r.labels) for r in rows), len(rows)
assert {{(r.epoch, r.shard) for r in rows}} == {{(e, s) for e in (0, 1) for s in (0, 1)}}
assert entry.queries()["encode_with_vocab"](spark, "/root/testdata/sf0.001").count() == 200
from tokenloom.queries import REGISTRY
assert set(REGISTRY) <= set(entry.oracle_sql()) <= set(entry.queries())
print("fine", len(rows))
"""


def test_entry_from_elsewhere(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "fine" in done.stdout, done.stderr[-2000:]
