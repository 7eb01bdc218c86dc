"""Hard-negative mining over Hilbert-ordered candidate blocks whose zone maps tell which blocks a search must read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tokenloom.llm.topk import exact_type, quantize, usable
from tokenloom.sources.workspace import stage

#: Rows of a candidate block, anchors and zones that meet in one step; axes of the curve and bits of each.
BLOCK, ANCHORS, ZONES = 1024, 256, 256
AXES, BITS = 8, 7
NONE = -(1 << 62)
BLOCKS = "block long, width int, ids array<long>, labels array<int>, vectors array<long>, lows array<long>, highs array<long>, kinds array<int>"
ANCHOR = "key long, id long, label int, vector array<long>, lows array<long>, highs array<long>"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (n x axes, whole numbers of `bits` bits) on the Hilbert curve through all cells."""
    x = [c.astype(np.int64) for c in cells.T]
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        top, rest = 1 << bit, (1 << bit) - 1
        for i in range(axes):
            turn = (x[i] & top) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & rest)
            x[0] = np.where(turn, x[0] ^ rest, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, axes):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip = np.where(x[-1] & (1 << bit), flip ^ ((1 << bit) - 1), flip)
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | ((axis ^ flip) >> bit & 1)
    return place


def ragged(vectors: pa.ListArray) -> np.ndarray:
    """Vectors as rows of one matrix, filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (a, b))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exact."""
    a, b = widened(a, b)
    kind = exact_type(b, a)
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def bounds(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval arithmetic: the least and the highest inner product that a row within each zone can have."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, lows) + product(down, highs), product(up, highs) + product(down, lows)


def candidate_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of at most BLOCK rows (id, label, vector), neighbours on a Hilbert curve, one Parquet row each in a stage
    table. Beside its rows each block has its zone map: least and greatest value of every dimension, and its labels.

    The curve runs through the AXES dimensions that vary most, in 2^BITS steps each. Rows are dealt by ranges of
    (place, id), so many equal vectors fill several blocks.
    """
    spread = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.stddev_pop("x").alias("s"), F.avg("x").alias("m"))
    axes = [(r.at, r.m, r.s) for r in spread.where("s > 0").orderBy(F.desc("s"), "at").limit(AXES).collect()]

    @F.arrow_udf("bigint")
    def place(vectors: pa.Array) -> pa.Array:
        if not axes:
            return pa.array(np.zeros(len(vectors), dtype=np.int64))
        values, sizes = vectors.flatten().to_numpy(), np.diff(vectors.offsets.to_numpy())
        starts = np.cumsum(sizes) - sizes
        cells = np.empty((len(vectors), len(axes)), dtype=np.int64)
        for i, (at, mean, width) in enumerate(axes):
            x = np.where(sizes > at, values[np.minimum(starts + at, max(len(values) - 1, 0))], 0)
            cells[:, i] = np.clip(((x - mean) / width + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1)
        return pa.array(hilbert(cells, BITS))

    def build(batches):
        held, size, number = [], 0, 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            while size >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                yield packed(table.slice(0, BLOCK), number)
                number, size = number + 1, size - BLOCK
                held = table.slice(BLOCK).to_batches()
        if size:
            yield packed(pa.Table.from_batches(held).combine_chunks(), number)

    def packed(table: pa.Table, number: int) -> pa.RecordBatch:
        vectors = ragged(pa.concat_arrays(table.column("vector").chunks))
        labels = table.column("label").to_numpy()
        row = {
            "block": int(table.column("part")[0].as_py()) << 31 | number,
            "width": vectors.shape[1],
            "ids": table.column("id").to_numpy(),
            "labels": labels,
            "vectors": vectors.ravel(),
            "lows": vectors.min(axis=0),
            "highs": vectors.max(axis=0),
            "kinds": np.unique(labels),
        }
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row.values(), kinds, strict=True)], list(row))

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("place", place("vector"))
    tie = F.xxhash64("label", "vector")
    dealt = keyed.repartitionByRange(tasks, "place", "id", tie).sortWithinPartitions("place", "id", tie)
    return stage(dealt.select(F.spark_partition_id().alias("part"), "id", "label", "vector").mapInArrow(build, BLOCKS), "candidates")


def opened(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a block."""
    ids, labels = (batch.column(c)[row].values.to_numpy() for c in ("ids", "labels"))
    return ids, labels, batch.column("vectors")[row].values.to_numpy().reshape(len(ids), batch.column("width")[row].as_py())


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    near = np.arange(len(scores))
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def anchors_of(blocks: DataFrame, every: int, positives: int) -> DataFrame:
    """Rows whose id is divisible by `every`, with a key of their own. Their first search may stop below `lows`: the
    score of the last of `positives` rows of the same label found in the anchor's own block, if it holds as many."""

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, vectors = opened(batch, row)
                asks = np.flatnonzero(ids % every == 0)
                floors = []
                for at, scores in zip(asks, product(vectors[asks], vectors), strict=True):
                    same = np.flatnonzero((labels == labels[at]) & (ids != ids[at]))
                    best = first(scores[same], ids[same], positives)
                    floors.append([int(scores[same[best[-1]]])] if len(best) == positives else [NONE])
                keys = (batch.column("block")[row].as_py() << 10) + asks
                lists = pa.list_(pa.int64())
                columns = [pa.array(keys, pa.int64()), pa.array(ids[asks], pa.int64()), pa.array(labels[asks], pa.int32()), pa.array(list(vectors[asks]), lists), pa.array(floors, lists), pa.array([[-NONE]] * len(asks), lists)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "label", "vector", "lows", "highs"])

    return blocks.select("block", "width", "ids", "labels", "vectors").mapInArrow(work, ANCHOR)


def chosen(anchors: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """(block, anchors): for every block the anchors (ANCHORS at most a row) that must read it. An anchor asks for scores
    within its windows [lows[i], highs[i]]; a block is read if its bounds meet a window and it holds a wanted
    label (the anchor's own with `same`, another one without).

    Anchors and zones are dealt into bounded groups, every pair of which is one step: the queries meet all zones.
    """
    n_zones = max(1, -(-blocks.count() // ZONES))
    n_groups = max(1, -(-anchors.count() // ANCHORS))
    zones = blocks.select(F.pmod(F.xxhash64("block"), F.lit(n_zones)).alias("z"), F.struct("block", "lows", "highs", "kinds").alias("zone"))
    zones = zones.groupBy("z").agg(F.collect_list("zone").alias("zones"))
    row = F.struct("key", "id", "label", "vector", "lows", "highs")
    # Neighbours on the curve have neighbouring keys, so a group asks for much the same blocks.
    grouped = anchors.repartitionByRange(n_groups, "key").select(row.alias("a")).mapInArrow(_packs, "anchors array<struct<" + ANCHOR.replace(" ", ":").replace(",:", ",") + ">>")
    pairs = grouped.withColumn("z", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_zones - 1).cast("bigint")))).join(zones, "z")

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                asked, zones = batch.column("anchors")[row].values, batch.column("zones")[row].values
                least, most = bounds(ragged(asked.field("vector")), *(ragged(zones.field(f)) for f in ("lows", "highs")))
                labels = asked.field("label").to_numpy()
                wants = np.zeros(least.shape, dtype=bool)
                for z, kinds in enumerate(zones.field("kinds").to_pylist()):
                    wants[:, z] = np.isin(labels, kinds) if same else [kinds != [x] for x in labels]
                meets = np.zeros(least.shape, dtype=bool)
                for a, (lows, highs) in enumerate(zip(asked.field("lows").to_pylist(), asked.field("highs").to_pylist(), strict=True)):
                    for low, high in zip(lows, highs, strict=True):
                        meets[a] |= (most[a] >= low) & (least[a] <= high)
                meets &= wants
                used = np.flatnonzero(meets.any(axis=0))
                picks = [asked.take(pa.array(np.flatnonzero(meets[:, z]))) for z in used]
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in picks])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(picks) if picks else asked.slice(0, 0))
                yield pa.RecordBatch.from_arrays([pa.array(zones.field("block").to_numpy()[used], pa.int64()), lists], ["block", "anchors"])

    return pairs.select("anchors", "zones").mapInArrow(work, "block long, " + grouped.schema.simpleString()[7:-1].replace("anchors:", "anchors "))


def _packs(batches):
    for batch in batches:
        rows = batch.column("a")
        for at in range(0, len(rows), ANCHORS):
            some = rows.slice(at, ANCHORS)
            offsets = pa.array([0, len(some)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.concat_arrays([some]))], ["anchors"])


def searched(choice: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """(key, anchor_id, high, id, score): within each block that was chosen, the first k rows of every window. Only chosen
    blocks meet their anchors."""
    read = choice.join(blocks.select("block", "width", "ids", "labels", "vectors"), "block")

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, vectors = opened(batch, row)
                asked = batch.column("anchors")[row].values
                scores = product(ragged(asked.field("vector")), vectors)
                names = [asked.field(f).to_pylist() for f in ("key", "id", "label", "lows", "highs")]
                out = [np.zeros((5, 0), dtype=np.int64)]
                for own, (key, anchor, label, lows, highs) in zip(scores, zip(*names, strict=True), strict=True):
                    fits = (labels == label) if same else (labels != label)
                    near = np.flatnonzero(fits & (ids != anchor) & (own >= min(lows)) & (own <= max(highs)))
                    for low, high in zip(lows, highs, strict=True):
                        window = near[(own[near] >= low) & (own[near] <= high)]
                        best = window[first(own[window], ids[window], k)]
                        out.append(np.stack([np.full(len(best), key), np.full(len(best), anchor), np.full(len(best), high), ids[best], own[best]]))
                found = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["key", "anchor_id", "high", "id", "score"])

    found = read.select("anchors", "width", "ids", "labels", "vectors").mapInArrow(work, "key long, anchor_id long, high long, id long, score long")
    order = Window.partitionBy("key", "high").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """Hard negatives of every anchor: `anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    `rows` has id, label and vector (whole numbers). Anchors are the rows whose id is divisible by `every`. Of an
    anchor's positives, the first `positives` rows of another id and the same label by (score descending, id), each gets
    the first `negatives` rows of another label whose score lies between `least` and `most` percent of the positive's.

    Rows with a null in id, label or vector take no part. Repeated rows count each, also as anchors; rows of the
    anchor's id are neither. Vectors of unequal width meet as if filled up with zeros. Too few rows of either
    kind give what there is; empty tables give no rows.
    """
    blocks = candidate_blocks(rows.where("id is not null and label is not null and vector is not null").select("id", F.col("label").cast("int").alias("label"), "vector"))
    anchors = stage(anchors_of(blocks, every, positives), "anchors")
    found = searched(chosen(anchors, blocks, True), blocks, True, positives)
    near = stage(found.select("key", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # least * p <= 100 * n <= most * p, in whole numbers.
    low = F.expr(f"-((-positive_score * {least} - pmod(-positive_score * {least}, 100)) div 100)")
    high = F.expr(f"(positive_score * {most} - pmod(positive_score * {most}, 100)) div 100")
    # Scores that differ by one may have windows that end alike; the first rows from there serve them all.
    windows = near.select("key", low.alias("low"), high.alias("high")).where("low <= high").groupBy("key", "high").agg(F.min("low").alias("low"))
    asked = windows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("w"))
    asked = anchors.drop("lows", "highs").join(asked, "key").select("key", "id", "label", "vector", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    asked = stage(asked, "windows")
    hard = searched(chosen(asked, blocks, False), blocks, False, negatives)
    met = near.withColumn("high", high).withColumn("low", low).join(hard.select("key", "high", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["key", "high"])
    return met.where("negative_score >= low").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def moved(label: Column, vec_id: Column) -> Column:
    """The query's labels: where the id is divisible by 7, the next of ten."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def hard_negative_query(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.where(usable(F.col("embedding")) & F.col("label").isNotNull())
    return mine(rows.select(F.col("vec_id").alias("id"), moved(F.col("label"), F.col("vec_id")).alias("label"), quantize(F.col("embedding"), 256).alias("vector")))


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, r.vec_id as vec_id, a.label = r.label as same,
    cast(coalesce(list_sum(list_transform(range(1, least(len(a.c), len(r.c)) + 1), lambda i: a.c[i] * r.c[i])), 0) as bigint) as score
  from v a join v r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as int) as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same
  and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
"""
