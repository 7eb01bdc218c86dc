import hashlib

import pytest

from tokenloom.llm import digests


def brute(rows):
    """(doc_id, text) in order to the query's rows, one triplet at a time."""

    def digest(data):
        found = [0] * 128
        for i in range(len(data) - 2):
            x = data[i] | data[i + 1] << 8 | data[i + 2] << 16
            found[(x * 0x9E3779B1 & 0xFFFFFFFF) >> 25] += 1
        q = [sorted(found)[i] for i in (31, 63, 95)]
        bits = "".join(format(sum(c > x for x in q), "02b") for c in found)
        import math

        size = min(255, int(8 * math.log2(len(data) + 1)))
        return f"{size:02x}{16 * q[0] // (q[2] + 1):x}{16 * q[1] // (q[2] + 1):x}{int(bits, 2):064x}"

    def near(a, b):
        step = lambda x, y: 6 if abs(x - y) == 3 else abs(x - y)
        two = lambda s: [int(s[4:], 16) >> i & 3 for i in range(0, 256, 2)]
        score = min(64, abs(int(a[:2], 16) - int(b[:2], 16)))
        score += 4 * sum(abs(int(a[i], 16) - int(b[i], 16)) for i in (2, 3))
        return 1 - (score + sum(map(step, two(a), two(b)))) / 952

    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = (text[: len(text) - half] + after[:half]).encode()
        own, other = digest(text.encode()), digest(changed)
        out.append((doc, len(text), hashlib.sha256(changed).hexdigest(), own, other, near(own, other), near(own, digest(after.encode()))))
    return out


def test_matches_brute_force_at_any_number_of_partitions(spark):
    rows = [(i * 7 % 401, f"text {i % 5} " * (i % 9) + "é😀" * (i % 3)) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "ab"), (1003, "long " * 60000), (2**40, "abc")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string")
    want = brute(sorted(rows, key=lambda r: r[0]))
    for n in (1, 3, 8):
        got = digests.digest_documents(df.repartition(n)).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_null_ids_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    assert digests.digest_documents(spark.createDataFrame([], schema)).collect() == []
    lone = digests.digest_documents(spark.createDataFrame([(5, "abcdef")], schema)).first()
    assert lone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and lone.near_next == 1.0
    rows = [(None, "a b c"), (None, "a b c"), (3, "same text"), (3, "same text"), (4, None)]
    got = digests.digest_documents(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "4", "None", "None"]
    assert len({r.fingerprint for r in got if r.doc_id == 3}) == 1


@pytest.mark.parametrize("text", [b"", b"ab", b"abc" * 100, bytes(range(256)) * 9000])
def test_pieces_do_not_matter(text, monkeypatch):
    whole = digests.fingerprint(text)
    monkeypatch.setattr(digests, "PIECE", 1000)
    assert digests.fingerprint(text) == whole and digests.difference(whole, whole) == 0


def test_large_ids_beside_missing_ones(spark):
    rows = [((1 << 62) + 3 * i, f"text {i} " * 4) for i in range(4000)] + [(None, f"none {i}") for i in range(40)] + [((1 << 63) - 1, "last"), (-(1 << 63), "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = digests.digest_documents(df).collect()
    assert len(got) == len(rows)
    known = [r for r in got if r.doc_id is not None]
    assert sorted(r.doc_id for r in known) == sorted(i for i, _ in rows if i is not None)
    want = {r[0]: r for r in brute(sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]))}
    assert all(tuple(r)[:4] == want[r.doc_id][:4] for r in known if r.doc_id < (1 << 63) - 1)
