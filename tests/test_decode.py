"""The decode loop against a plain loop over each sequence."""

import math
import zlib

import pandas as pd
import pytest

from tokenloom.constants import MASK_ID
from tokenloom.operators import metrics
from tokenloom.operators.select import pick_high_or_topk
from tokenloom.plans.decode import decode_blocks, run_log

VOCAB, LENGTH, EOS = 12, 4, 11


def logits(seq, ids, pos):
    """A fixed function of the sequence and what is known so far."""
    known = ",".join(map(str, ids))
    return [(zlib.crc32(f"{seq}:{known}:{pos}:{v}".encode()) % 1000) / 120 - (1 if v == EOS else 0) for v in range(VOCAB)]


def model(batch: pd.DataFrame) -> pd.DataFrame:
    rows = [(s, p, logits(s, list(ids), p)) for s, ids, start in zip(batch["seq_id"], batch["ids"], batch["start"]) for p in range(start, len(ids))]
    return pd.DataFrame(rows, columns=["seq_id", "pos", "logits"])


def brute(seq, prompt, blocks, tau, edit=False):
    ids, calls, tokens = list(prompt) + [MASK_ID] * LENGTH, 0, 0

    def update(width):
        nonlocal tokens
        start, scores = len(ids) - width, {}
        for p in range(start, len(ids)):
            x = logits(seq, ids, p)
            top = max(x)
            scores[p] = (1 / sum(math.exp(v - top) for v in x), x.index(top), ids[p] == MASK_ID)
        hidden = {p: s for p, s in scores.items() if s[2]}
        picks = [p for p, s in hidden.items() if s[0] > tau]
        if hidden and not picks:
            picks = [max(hidden, key=lambda p: (hidden[p][0], -p))]
        if edit:
            picks += [p for p, s in scores.items() if not s[2] and s[0] > 0]
        for p in picks:
            ids[p] = scores[p][1]
        tokens += len(picks)

    update(LENGTH)
    for block in range(blocks):
        steps = 0
        while MASK_ID in ids[len(prompt) :]:
            update(LENGTH)
            calls, steps = calls + 1, steps + 1
            if steps >= LENGTH:
                break
        if EOS in ids[len(prompt) :] or block == blocks - 1:
            break
        ids += [MASK_ID] * LENGTH
        update(2 * LENGTH)
        calls += 1
    return ids[len(prompt) :], calls, tokens


@pytest.mark.parametrize("tau,edit", [(0.5, False), (0.3, True), (2.0, False)])
def test_equals_plain_loop(spark, tau, edit):
    prompts = [(i, [i % 5] * (i % 4)) for i in range(25)]
    df = spark.createDataFrame(prompts, "seq_id bigint, input_ids array<bigint>").repartition(3)
    got = decode_blocks(df, model, LENGTH, 3 * LENGTH + 1, tau, edit, eos_ids=(EOS,))
    want = {i: brute(i, p, 3, tau, edit) for i, p in prompts}
    assert {r.seq_id: (r.output_ids, r.calls, r.tokens) for r in got.collect()} == want
    assert len({len(x) for x, _, _ in want.values()}) > 1
    log = run_log(got)
    assert metrics.tokens_per_call(log).first().weighted_mean == pytest.approx(sum(t for *_, t in want.values()) / sum(c for _, c, _ in want.values()))


def test_other_rules_and_no_prompts(spark):
    schema = "seq_id bigint, input_ids array<bigint>"
    df = spark.createDataFrame([(1, [3]), (2, None)], schema)
    got = decode_blocks(df, model, LENGTH, 2 * LENGTH, eos_ids=(EOS,), pick=lambda scored: pick_high_or_topk(scored, 0.9, 2)).collect()
    assert sorted(r.seq_id for r in got) == [1, 2] and all(MASK_ID not in r.output_ids for r in got)
    assert decode_blocks(df.limit(0), model, LENGTH, LENGTH).collect() == []
