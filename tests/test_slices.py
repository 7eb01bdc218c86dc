"""Per-token work runs on slices of Arrow batches."""

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.operators import noising, vocab


@pytest.fixture
def taken(spark, monkeypatch):
    """Functions given to mapInArrow."""
    frame = type(spark.range(1))
    found, real = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, fn, *a, **k: (found.append(fn), real(self, fn, *a, **k))[1])
    return found


def lists(rng, rows, most):
    ends = np.concatenate([[0], np.cumsum(rng.integers(0, most, rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rng.integers(1, 50, ends[-1])))


def most_elements(batches, column):
    return max(len(b.column(column).flatten()) for b in batches)


def test_noise(spark, taken):
    one = spark.createDataFrame([(0, 0, 0, [1], [1])], "epoch int, shard int, chunk_id long, input_ids array<long>, labels array<long>")
    assert noising.noise(one).count() == 1
    ids = lists(np.random.default_rng(1), 3000, 500)
    rows = len(ids)
    whole = pa.RecordBatch.from_arrays([pa.array(range(rows)), ids, ids, pa.array([0.5] * rows), pa.array(range(rows))], ["chunk_id", "input_ids", "labels", "t", "_word"])
    got = list(taken[0](iter([whole])))
    assert len(got) > 1 and most_elements(got, "input_ids") <= 1 << 18
    together = pa.Table.from_batches(got).combine_chunks()
    want = pa.Table.from_batches([noising.mask_record_batch(whole, noising.MASK_ID, noising.EOS_IDS)])
    assert together.to_pylist() == want.to_pylist()


def test_vocabulary(spark, taken):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b ü")], "id long, text string")
    words = vocab.build_vocab(docs)
    taken.clear()
    coded = vocab.vocab_encode(docs, "text", words)
    assert {r.text for r in vocab.decode(coded, words).collect()} == {"a b c", "b ü"}
    for fn, column, out, kind in ((taken[0], "_tokens", "input_ids", pa.string()), (taken[1], "_ids", "text", pa.int64())):
        x = lists(np.random.default_rng(2), 2000, 600)
        x = pa.ListArray.from_arrays(x.offsets, x.values.cast(kind))
        got = list(fn(iter([pa.RecordBatch.from_arrays([pa.array(range(len(x))), x], ["id", column])])))
        assert len(got) > 1 and max(b.num_rows for b in got) < 2000
        assert [i for b in got for i in b.column("id").to_pylist()] == list(range(2000))
        if out == "input_ids":
            assert [len(v) for b in got for v in b.column(out).to_pylist()] == x.value_lengths().to_pylist()
