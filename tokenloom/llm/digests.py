"""Quartile bucket digests of documents, and their likeness to the next and to an edited text."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

BUCKETS, PIECE = 128, 1 << 20
#: Bounds of the parts of the difference score: length, two quartile ratios, and 6 for each bucket.
LENGTH_MOST, RATIO_WEIGHT = 64, 4
WORST = LENGTH_MOST + 2 * 15 * RATIO_WEIGHT + 6 * BUCKETS
#: Two bits per bucket; a bucket that moves over the whole range counts double.
STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int64)
MOST_RANGES = 8192


def counts(data: bytes) -> np.ndarray:
    """How many byte triplets of the whole text hash to each bucket."""
    found = np.zeros(BUCKETS, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, max(len(raw) - 2, 0), PIECE):
        part = raw[at : at + PIECE + 2].astype(np.uint32)
        triplet = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        found += np.bincount((triplet * np.uint32(0x9E3779B1)) >> np.uint32(25), minlength=BUCKETS)
    return found


def fingerprint(data: bytes) -> str:
    """68 hex digits: length on a logarithmic scale (2), first and second quartile against the third (1 each),
    then the quartile of each bucket's count, two bits each. Fewer than three bytes leave all buckets at 0."""
    found = counts(data)
    q1, q2, q3 = (int(x) for x in np.sort(found)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    code = (found > q1).astype(np.uint8) + (found > q2) + (found > q3)
    body = code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]
    size = min(255, int(8 * math.log2(len(data) + 1)))
    return f"{size:02x}{16 * q1 // (q3 + 1):x}{16 * q2 // (q3 + 1):x}" + body.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Bounded difference score of two fingerprints, 0 (same digest) to WORST."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    score = min(LENGTH_MOST, abs(x[0] - y[0]))
    score += RATIO_WEIGHT * (abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15)))
    p, q = (np.frombuffer(z, dtype=np.uint8, offset=2) for z in (x, y))
    return score + int(sum(STEP[p >> s & 3, q >> s & 3].sum() for s in (0, 2, 4, 6)))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / WORST


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_ranges(documents: DataFrame, ranges: int) -> DataFrame:
    """(bucket, late, doc_id, h, text): documents in ranges of doc_id; the first of each range goes to the range
    before as well (late = 1), the first of all to the last one.

    Only ids and text hashes are read to set the ranges. What reaches the driver is a bounded number of range
    limits and first keys, whatever the input.
    """
    keys = documents.select("doc_id", F.xxhash64("text").alias("h"), "text")
    limits = keys.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    limits = np.array(sorted({min(int(x), (1 << 63) - 1) for x in limits}), dtype=np.int64)

    def range_of(ids: pa.Array) -> np.ndarray:
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        return np.where(known, 1 + np.searchsorted(limits, pc.fill_null(ids, 0).to_numpy(), side="right"), 0)

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        return pa.array(range_of(ids), pa.int32())

    first = keys.groupBy(bucket("doc_id").alias("bucket")).agg(F.min(F.struct("doc_id", "h")).alias("first")).collect()
    order = sorted(r.bucket for r in first)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    table = {r.bucket: (r.first.doc_id, r.first.h, before[r.bucket]) for r in first}

    @F.arrow_udf("int")
    def earlier(ids: pa.Array, h: pa.Array) -> pa.Array:
        """For rows that are the first of their range: the range before."""
        own, ids, h = range_of(ids), ids.to_pylist(), h.to_pylist()
        return pa.array([table[b][2] if table[b][:2] == (i, x) else None for b, i, x in zip(own.tolist(), ids, h, strict=True)], pa.int32())

    places = F.array(
        F.struct(bucket("doc_id").alias("bucket"), F.lit(0).alias("late")),
        F.struct(earlier("doc_id", "h").alias("bucket"), F.lit(1).alias("late")),
    )
    spread = keys.withColumn("p", F.explode(F.filter(places, lambda p: p.bucket.isNotNull())))
    return spread.select("p.bucket", "p.late", "doc_id", "h", "text")


def digest_batches(batches):
    """Sorted rows to the query's columns; a row waits for the next one of its range."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    waiting = None
    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("bucket", "late", "doc_id", "text")]
        for i in range(batch.num_rows):
            bucket, late, doc, text = (c[i].as_py() for c in columns)
            if late and (waiting is None or waiting[0] != bucket):
                continue  # a second copy of a late row
            text = text or ""
            own = fingerprint(text.encode())
            if waiting is not None:
                _, last_doc, last_text, last_own = waiting
                changed = edited(last_text, text).encode()
                other = fingerprint(changed)
                out.append((last_doc, len(last_text), hashlib.sha256(changed).hexdigest(), last_own, other, likeness(last_own, other), likeness(last_own, own)))
            waiting = None if late else (bucket, doc, text, own)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)


def digest_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, in one exchange of the texts.

    Documents follow each other by doc_id (null ids first), then by hash and text, so repeated rows follow each
    other. A null text is empty. A lone document follows itself. An empty table gives no rows. Workers stream
    sorted rows and hold two texts at a time, so a range of any size fits.
    """
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = in_ranges(documents, min(4 * partitions, MOST_RANGES))
    dealt = placed.repartition(partitions, "bucket").sortWithinPartitions("bucket", "late", "doc_id", "h", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(digest_batches, schema)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, count(*) OVER () AS n FROM documents),
e AS (
  SELECT a.r, a.doc_id, a.t, b.r AS after, left(a.t, length(a.t) - length(a.t) // 2) || left(b.t, length(a.t) // 2) AS changed
  FROM d a JOIN d b ON b.r = a.r % a.n + 1),
f AS (SELECT r, 0 AS k, t AS s FROM e UNION ALL SELECT r, 1, changed FROM e),
h AS (
  SELECT r, k, strlen(s) AS n, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::BIGINT) AS h FROM f),
v AS (SELECT r, k, unnest(h[: n - 2]) + unnest(h[2 : n - 1]) * 256 + unnest(h[3 :]) * 65536 AS v FROM h WHERE n > 2),
b AS (SELECT r, k, ((v * 2654435761) & 4294967295) >> 25 AS bucket, count(*) AS c FROM v GROUP BY ALL),
z AS (
  SELECT h.r, h.k, h.n, list(coalesce(b.c, 0) ORDER BY i.i) AS l
  FROM h CROSS JOIN (SELECT unnest(range(128)) AS i) i LEFT JOIN b ON b.r = h.r AND b.k = h.k AND b.bucket = i.i GROUP BY h.r, h.k, h.n),
q AS (SELECT *, list_sort(l)[32] AS q1, list_sort(l)[64] AS q2, list_sort(l)[96] AS q3 FROM z),
c AS (
  SELECT r, k, least(255, floor(8 * log2(n + 1))::BIGINT) AS size, 16 * q1 // (q3 + 1) AS x, 16 * q2 // (q3 + 1) AS y,
    list_transform(l, lambda a: (a > q1)::BIGINT + (a > q2)::BIGINT + (a > q3)::BIGINT) AS code
  FROM q),
p AS (
  SELECT *, format('{:02x}{:x}{:x}', size, x, y) || array_to_string(list_transform(range(32),
    lambda j: format('{:02x}', code[4 * j + 1] * 64 + code[4 * j + 2] * 16 + code[4 * j + 3] * 4 + code[4 * j + 4])), '') AS print
  FROM c),
m AS (
  SELECT e.doc_id, length(e.t) AS n_chars, sha256(e.changed) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint,
    least(64, abs(a.size - b.size)) + 4 * (abs(a.x - b.x) + abs(a.y - b.y)) + list_sum(list_transform(range(1, 129),
      lambda i: CASE abs(a.code[i] - b.code[i]) WHEN 3 THEN 6 ELSE abs(a.code[i] - b.code[i]) END)) AS to_edited,
    least(64, abs(a.size - o.size)) + 4 * (abs(a.x - o.x) + abs(a.y - o.y)) + list_sum(list_transform(range(1, 129),
      lambda i: CASE abs(a.code[i] - o.code[i]) WHEN 3 THEN 6 ELSE abs(a.code[i] - o.code[i]) END)) AS to_next
  FROM e JOIN p a ON a.r = e.r AND a.k = 0 JOIN p b ON b.r = e.r AND b.k = 1 JOIN p o ON o.r = e.after AND o.k = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, 1.0::DOUBLE - to_edited::DOUBLE / 952 AS near_edited,
  1.0::DOUBLE - to_next::DOUBLE / 952 AS near_next
FROM m
"""
