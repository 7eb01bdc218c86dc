"""All queries of this folder and the pipeline, started from another folder, with every column computed."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
assert len(names) == 14, names
for name in names:
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert rows, name
print("fine", len(names))
"""


def test_queries_run_where_the_package_is_not_installed(tmp_path):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert "fine 14" in done.stdout, done.stderr[-3000:]
