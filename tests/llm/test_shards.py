import zlib
from collections import Counter

from pyspark.sql import functions as F

from tokenloom.llm import shards


def plain(key, n):
    """The published algorithm, one key at a time."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_matches_plain_loop_and_moves_only_to_the_new_shard(spark):
    rows = [(i, f"text é {i % 7}" * (i % 5)) for i in range(9000)] + [(None, None), (None, ""), (5, "again"), (5, "again"), (-7, "x" * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.xxhash64("doc_id"))
    keys = {r.doc_id: r.key for r in df.select("doc_id", "key").collect()}
    got = shards.shard_digest(df.repartition(5)).collect()
    assert len(got) == len(rows)
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), plain(keys[d], 24), plain(keys[d], 25)) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 24) for r in got) and {r.law for r in got} == {"key"}
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) < 1.3 * len(rows) / 24


def test_buckets_keep_slots_dense_and_edges(spark, monkeypatch):
    monkeypatch.setattr(shards, "ROWS_PER_BUCKET", 3)
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("slot"))
    got = shards.assign_shards(df, 4).collect()
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert shards.shard_digest(df.limit(0)).collect() == []


def test_written_shards(spark, tmp_path):
    df = spark.range(300).withColumnRenamed("id", "doc_id")
    shards.write_shards(df, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300
    assert back.where(F.col("shard") != shards.shard_of(F.xxhash64("doc_id"), 6)).count() == 0
