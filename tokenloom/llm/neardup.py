"""Near-duplicate classes: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tokenloom.llm import folds
from tokenloom.llm.batches import slices
from tokenloom.llm.words import Powers, mix, word_hashes
from tokenloom.sources.workspace import discard, stage

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 22, 4
SAMPLES = BANDS * ROWS
#: Document frequencies are counted for 2^20 hashed features, whatever the corpus.
FEATURE_BITS = 20
#: Weights are whole numbers: UNIT for a shingle in all documents, UNIT + IDF_STEPS for one in a single document.
UNIT, IDF_STEPS = 64, 16
PROFILE_BITS = 18
#: Pairs that share a bucket and this many of their samples are compared at once, others if their outlines allow it.
LIKELY = 0.62
#: Sums of an outline. Floats of 32 bits round them; SLACK is far more than that.
OUTLINE, SLACK = 256, 1e-4
BLOCK, BLOCK_BYTES, MEMBERS, SPLIT = 512, 1 << 22, 256, 16
FACTORS = np.array([pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) for j in range(WORDS)], dtype=np.uint64)


def shingles(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles of WORDS words, their offsets, and two keys of each text's word sequence. A
    shorter text is one shingle of all its words; one without words has none, and keys of its characters."""
    words, places = word_hashes(texts, powers)
    n, counts = len(texts), np.diff(places)
    with np.errstate(over="ignore"):
        up, down = powers(len(words) + 1)
        keys = []
        for salt in (0, 0x5851F42D4C957F2D):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words ^ np.uint64(salt)) * up[: len(words)], dtype=np.uint64)])
            keys.append(mix((sums[places[1:]] - sums[places[:-1]]) * down[places[:-1]] + counts.astype(np.uint64)))
        total = max(len(words) - WORDS + 1, 0)
        joined = np.zeros(total, dtype=np.uint64)
        for j in range(WORDS):
            joined += words[j : j + total] * FACTORS[j]
        row = np.repeat(np.arange(n), counts)
        whole = row[:total] == row[WORDS - 1 :] if total else np.zeros(0, dtype=bool)
        hashes, owner = mix(joined[whole]), row[:total][whole]
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        if len(short):
            hashes, owner = np.concatenate([hashes, keys[0][short]]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            hashes, owner = hashes[order], owner[order]
    for i in np.flatnonzero(counts == 0):
        digest = hashlib.md5((texts[int(i)].as_py() or "").encode()).digest()
        keys[0][i], keys[1][i] = np.frombuffer(digest, dtype=np.uint64)
    return hashes, np.searchsorted(owner, np.arange(n + 1)), keys[0], keys[1]


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each hashed feature occurs, and the number of texts with words. All texts are counted;
    each task adds up its own and only 2^20 sums, compressed, leave it."""
    size = (1 << FEATURE_BITS) + 1

    def count(batches):
        powers, found, part = Powers(), np.zeros(size, dtype=np.int64), None
        shift = np.uint64(64 - FEATURE_BITS)
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for rows in slices(batch, "text"):
                hashes, offsets, _, _ = shingles(rows.column("text"), powers)
                sizes = np.diff(offsets)
                own = np.repeat(np.arange(len(sizes)), sizes) << FEATURE_BITS | (hashes >> shift).astype(np.int64)
                found += np.bincount(np.unique(own) & ((1 << FEATURE_BITS) - 1), minlength=size)
                found[-1] += int((sizes > 0).sum())
        if part is not None:
            yield folds.packed(part, found)

    sums = folds.total(folds.numbered(df, text).mapInArrow(count, folds.SCHEMA), np.int64, size)
    return sums[:-1], int(sums[-1])


def idf_weights(frequencies: np.ndarray, texts: int) -> np.ndarray:
    """UNIT + IDF_STEPS * log(texts / df) / log(texts), in whole numbers. The range is mild on purpose: in a large
    group of near copies the common shingles are frequent, and must still outweigh the few that differ."""
    if texts < 2:
        return np.full(len(frequencies), UNIT + IDF_STEPS, dtype=np.uint8)
    share = np.log(texts / np.clip(frequencies, 1, texts)) / math.log(texts)
    return (UNIT + np.round(IDF_STEPS * share)).astype(np.uint8)


class Weigher:
    """Weighted shingle sets of texts: sorted distinct hashes with tf * idf weights."""

    def __init__(self, idf: np.ndarray) -> None:
        self.idf, self.powers = idf, Powers()

    def sets(self, texts: pa.Array):
        hashes, offsets, k1, k2 = shingles(texts, self.powers)
        idf = self.idf[(hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)]
        for i in range(len(texts)):
            own, first, counts = np.unique(hashes[offsets[i] : offsets[i + 1]], return_index=True, return_counts=True)
            yield own, idf[offsets[i] : offsets[i + 1]][first], counts, k1[i], k2[i]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller weights over sum of larger ones; two empty sets are unlike (equal texts share a key anyhow)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), dtype=bool)
    common = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    total = int(a[1].sum()) + int(b[1].sum()) - common
    return common / total if total else 0.0


class Sampler:
    """Improved consistent weighted sampling. For each of SAMPLES hash functions a shingle of weight w draws
    r, c from Gamma(2, 1) and beta from U(0, 1), t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r; the
    sample is (shingle, t) of least a, so two sets agree with the probability of their weighted Jaccard.

    Equal sets, as of repeated rows, give equal samples. The draws are one of 2^18 profiles that the hash function picks for the shingle. For the weights of single
    occurrences ln a and t are tabulated once; other weights are worked out. Equal a go to the smaller hash.
    """

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        size = 1 << PROFILE_BITS
        self.r, c = rng.gamma(2.0, 1.0, size), rng.gamma(2.0, 1.0, size)
        self.beta, self.log_c = rng.random(size), np.log(c)
        self.a, self.t = np.empty((IDF_STEPS + 1, size), np.float32), np.empty((IDF_STEPS + 1, size), np.int16)
        for k in range(IDF_STEPS + 1):
            self.a[k], self.t[k] = self.draw(np.arange(size), np.float64(UNIT + k))
        self.a, self.t = self.a.reshape(-1), self.t.reshape(-1)
        self.times = (rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.plus = rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)[:, None]
        self.salt = mix(np.arange(1, SAMPLES + 1).astype(np.uint64))

    def draw(self, profile: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, beta, log_w = self.r[profile], self.beta[profile], np.log(weight)
        t = np.floor(log_w / r + beta)
        return (self.log_c[profile] - r * (t - beta) - r).astype(np.float32), np.clip(t, -30000, 30000).astype(np.int16)

    def samples(self, hashes: np.ndarray, idf: np.ndarray, counts: np.ndarray, step: int = 2048) -> np.ndarray:
        """SAMPLES values of 64 bits; equal values are equal samples."""
        best, found = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
        every = np.arange(SAMPLES)
        for at in range(0, len(hashes), step):
            own, many = hashes[at : at + step], np.flatnonzero(counts[at : at + step] > 1)
            profile = (self.times * (own >> np.uint64(32)).astype(np.uint32) + self.plus) >> np.uint32(32 - PROFILE_BITS)
            spot = profile + ((idf[at : at + step] - np.uint8(UNIT)).astype(np.uint32) << np.uint32(PROFILE_BITS))
            a = self.a[spot]
            if len(many):
                weight = (counts[at : at + step][many] * idf[at : at + step][many].astype(np.int64)).astype(np.float64)
                drawn, t_many = self.draw(profile[:, many], weight[None, :])
                a[:, many] = drawn
            first = np.argmin(a, axis=1)
            t = self.t[spot[every, first]].astype(np.int64)
            if len(many):
                where = np.searchsorted(many, first)
                hit = (where < len(many)) & (many[np.minimum(where, len(many) - 1)] == first)
                t[hit] = t_many[every[hit], where[hit]]
            low = a[every, first]
            better = low < best
            best = np.where(better, low, best)
            with np.errstate(over="ignore"):
                value = mix(own[first] + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ self.salt)
            found = np.where(better, value, found)
        return found


def bands(samples: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1).astype(np.uint64)
    for j in range(ROWS):
        key = mix(key ^ samples[j::ROWS][:BANDS])
    return key


def signatures(idf):
    """Function over texts to their keys, band hashes and samples (32 bits each)."""

    def sign(texts: pa.Array) -> pa.Array:
        weigher, sampler = Weigher(idf.value), Sampler()
        keys, marks, drawn = [], [], []
        for part in slices(pa.RecordBatch.from_arrays([texts.cast(pa.string())], ["text"]), "text"):
            for hashes, weight, counts, k1, k2 in weigher.sets(part.column("text")):
                keys.append(k1.tobytes() + k2.tobytes())
                if len(hashes):
                    samples = sampler.samples(hashes, weight, counts)
                    marks.append(bands(samples).view(np.int64))
                    drawn.append(samples.astype(np.uint32).tobytes())
                else:
                    marks.append(np.zeros(0, np.int64))
                    drawn.append(b"")
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *marks])))
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), lists, pa.array(drawn, pa.binary())], ["key", "bands", "samples"])

    return F.arrow_udf(sign, "struct<key:binary,bands:array<bigint>,samples:binary>")


def outlines(idf):
    """Function over texts to their outlines: the weights of a text's shingles, summed by OUTLINE hash values."""

    def draw(texts: pa.Array) -> pa.Array:
        weigher, found = Weigher(idf.value), []
        for part in slices(pa.RecordBatch.from_arrays([texts.cast(pa.string())], ["text"]), "text"):
            for hashes, weight, counts, _, _ in weigher.sets(part.column("text")):
                place = (hashes & np.uint64(OUTLINE - 1)).astype(np.int64)
                found.append(np.bincount(place, weights=weight * counts, minlength=OUTLINE).astype(np.float32).tobytes())
        return pa.array(found, pa.binary())

    return F.arrow_udf(draw, "binary")


def verify(pairs: DataFrame, texts: DataFrame, idf, least: float = LEAST) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of text numbers whose weighted Jaccard similarity reaches `least`.

    The texts of all b that meet one a are streamed past a's set. An a with many partners is dealt to pieces of
    about MEMBERS of them, each with a copy of a's text.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("piece", F.pmod(F.xxhash64("b"), "parts"))
    members = dealt.join(texts.withColumnRenamed("row", "b").hint("merge"), "b").select("a", "piece", F.lit(1).alias("late"), "b", "text")
    heads = parts.join(texts.withColumnRenamed("row", "a").hint("merge"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("piece"), F.lit(0).alias("late"), F.col("a").alias("b"), "text")

    def work(batches):
        weigher, head, own = Weigher(idf.value), None, None
        for batch in batches:
            out = []
            for part in slices(batch, "text"):
                keys = zip(*(part.column(c).to_pylist() for c in ("a", "piece", "late", "b")), strict=True)
                for (a, piece, late, b), (hashes, weight, counts, _, _) in zip(keys, weigher.sets(part.column("text")), strict=True):
                    found = hashes, weight * counts
                    if not late:
                        head, own = (a, piece), found
                    elif head == (a, piece) and (s := weighted_jaccard(own, found)) >= least:
                        out.append((a, b, s))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    together = members.unionByName(heads).repartition("a", "piece").sortWithinPartitions("a", "piece", "late", "b")
    return together.mapInArrow(work, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(row, label): the least row connected to each row of the edges (a, b), by alternating large and small stars.
    Minima are combined before each exchange, so no neighbourhood is gathered in one place."""
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        large = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        lower = stage(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage(small.union(lower.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(now, least, large, lower)
        now = after
    return now.select(F.col("u").alias("row"), F.col("v").alias("label"))


def agreeing(table: pa.Table, part: str, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, others, shares): for places x of the table, the places it may be a pair with: rows of the parts `lo` and `hi` of a
    bucket that are not yet connected, share this bucket's band as their first one, and can reach `least`.

    Two texts have at most the smaller of their outlines' sums in common, so no pair that reaches `least` is left out.
    `shares`, of equal samples, say which pairs are the likeliest.
    """
    row, label, at = (table.column(c).to_numpy() for c in ("row", "label", part))
    lo, hi, band = (table.column(c)[0].as_py() for c in ("lo", "hi", "i"))
    drawn = np.stack([np.frombuffer(x, dtype=np.uint32) for x in table.column("samples").to_pylist()])
    sums = np.stack([np.frombuffer(x, dtype=np.float32) for x in table.column("outline").to_pylist()])
    total = sums.sum(axis=1, dtype=np.float64)
    there = np.flatnonzero(at == hi)
    halves = drawn[there].view(np.uint64)
    for x in np.flatnonzero(at == lo):
        light, heavy = np.minimum(total[there], total[x]), np.maximum(total[there], total[x])
        fit = (label[there] != label[x]) & (light >= (least - SLACK) * heavy)
        near = np.flatnonzero(fit if lo != hi else fit & (row[there] > row[x]))
        if band and len(near):
            same = halves[near, : 2 * band] == drawn[x].view(np.uint64)[: 2 * band]
            near = near[~(same[:, ::2] & same[:, 1::2]).any(axis=1)]
        if not len(near):
            continue
        share = (drawn[there[near]] == drawn[x]).mean(axis=1)
        common = np.minimum(sums[there[near]], sums[x]).sum(axis=1)
        fit = (share >= LIKELY) | (common >= (least - SLACK) * (total[there[near]] + total[x] - common))
        if fit.any():
            yield x, there[near[fit]], share[fit]


def second_links(marks: DataFrame, stars: DataFrame, labels: DataFrame, drawn: DataFrame, bodies: DataFrame, idf, least: float = LEAST) -> DataFrame:
    """(a, b) of similar texts that share a bucket and are not yet connected, as a stage table.

    Pairs with a bucket's star are settled already. Buckets whose other members are of several components are cut
    into blocks of about BLOCK rows and BLOCK_BYTES of text, and these joined to tiles of SPLIT blocks. Every two tiles
    meet in one bounded task, with samples and outlines alone. A pair is looked at in the first bucket it shares only, if
    nothing has connected it yet and its outlines do not rule out `least`; texts then go to just those pairs of blocks in
    which they are part of such a pair, and are compared there, likeliest pairs first. Whatever a bucket's size, two texts
    of it that reach `least` are linked, as they would be in a bucket of their own: sizes of blocks and tiles decide where
    pairs are compared, not whether. Samples and outlines move once per tile, never per pair of texts.
    """
    rest = marks.join(stars.hint("merge"), "band").where("row <> star").join(labels.hint("merge"), "row", "left")
    rest = rest.select("band", "i", "row", F.coalesce("label", "row").alias("label")).join(bodies.select("row", F.octet_length("text").alias("size")).hint("merge"), "row")
    # Staged, so that the joins below stand on exchanges alone and a hot band can be split.
    rest = stage(rest.select("band", "i", "row", "label", "size"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("blocks")
    mixed = stage(rest.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), blocks).where("x <> y").select("band", "blocks"), "mixed")
    used = stage(rest.join(mixed.hint("merge"), "band"), "members")
    drafts = bodies.join(used.select("row").distinct().hint("merge"), "row").select("row", outlines(idf)("text").alias("outline"))
    drafts = stage(drafts.join(drawn.select("row", "samples").hint("merge"), "row"), "outlines")
    member = used.join(drafts, "row").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    tiled = member.withColumn("tile", F.expr(f"block div {SPLIT}")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(blocks - 1) div {SPLIT}"))))
    met = tiled.select("band", "i", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "block", "row", "label", "samples", "outline")

    def meeting(table: pa.Table) -> pa.Table:
        known, block = np.unique(table.column("block").to_numpy(), return_inverse=True)
        meets = np.zeros((len(block), len(known)), dtype=bool)
        for x, others, _ in agreeing(table, "tile", least):
            meets[x, block[others]] = meets[others, block[x]] = True
        at, other = np.nonzero(meets)
        own, other = known[block[at]], known[other]
        rows = table.select(["band", "i", "block", "row", "label", "samples", "outline"]).take(pa.array(at))
        return rows.append_column("lo", pa.array(np.minimum(own, other))).append_column("hi", pa.array(np.maximum(own, other)))

    near = met.groupBy("band", F.col("lo").alias("x"), F.col("hi").alias("y")).applyInArrow(meeting, "band long, i int, block long, row long, label long, samples binary, outline binary, lo long, hi long")

    def compare(table: pa.Table) -> pa.Table:
        row, label = (table.column(c).to_numpy() for c in ("row", "label"))
        found = [(-share, x, y) for x, others, shares in agreeing(table, "block", least) for y, share in zip(others, shares, strict=True)]
        weigher, sets, parent = Weigher(idf.value), {}, {}
        texts = table.column("text").combine_chunks()
        used = sorted({x for _, i, j in found for x in (i, j)})
        for at in range(0, len(used), 64):
            part = used[at : at + 64]
            for x, (hashes, weight, counts, _, _) in zip(part, weigher.sets(texts.take(pa.array(part))), strict=True):
                sets[x] = hashes, weight * counts

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for _, i, j in sorted(found):
            x, y = root(label[i]), root(label[j])
            if x != y and weighted_jaccard(sets[i], sets[j]) >= least:
                parent[max(x, y)] = min(x, y)
                out.append((row[i], row[j]))
        return pa.table({k: pa.array([x[n] for x in out], pa.int64()) for n, k in enumerate(("a", "b"))})

    found = stage(near.join(bodies.hint("merge"), "row").groupBy("band", "lo", "hi").applyInArrow(compare, "a long, b long"), "links")
    discard(rest, mixed, used, drafts)
    return found


def classify(df: DataFrame, text: str = "text", id_column: str = "doc_id", least: float = LEAST) -> DataFrame:
    """Every row of `df` with `class_id`, the least id of its class, and `keep`, true for one row of the class.

    A class is a connected component of texts whose weighted Jaccard similarity over TF-IDF shingles of five words
    reaches `least`; texts of one word sequence (case and punctuation aside) are one text from the start, so copies
    are never paired. Each band bucket first links its members to its first text (a star). Pairs in one bucket that
    are then still unconnected are verified unless a bound rules them out, so no link found by a band is lost; a
    pair at 0.8 shares no band once in 100,000. Null texts are empty; texts without words are alike only if equal;
    rows without an id come after others when `keep` is chosen, and a class of such rows has a null id. Empty tables
    give none. Columns `class_id` and `keep` are replaced.
    """
    spark = df.sparkSession
    rows = df.drop("class_id", "keep")
    frequencies, texts = document_frequencies(rows.select(F.col(text).alias("text")))
    idf = spark.sparkContext.broadcast(idf_weights(frequencies, texts))
    base = stage(rows.withColumn("_s", signatures(idf)(F.coalesce(F.col(text), F.lit("")))).withColumn("_row", F.monotonically_increasing_id()), "signed")
    first = stage(base.groupBy("_s.key").agg(F.min("_row").alias("row")), "texts")
    drawn = stage(base.join(first.select(F.col("row").alias("_row")), "_row").select(F.col("_row").alias("row"), "_s.bands", "_s.samples"), "samples")
    marks = drawn.select("row", F.posexplode("bands").alias("i", "band"))
    stars = stage(marks.groupBy("band").agg(F.min("row").alias("star"), F.count("*").alias("n")).where("n > 1").select("band", "star"), "stars")
    pairs = stage(marks.join(stars, "band").where("row <> star").select(F.col("star").alias("a"), F.col("row").alias("b")).distinct(), "pairs")
    # Joins that move texts are merge joins at every size: one plan, whose cost follows the input.
    wanted = pairs.select(F.col("a").alias("_row")).union(pairs.select(F.col("b").alias("_row"))).distinct()
    bodies = stage(base.select("_row", F.coalesce(F.col(text), F.lit("")).alias("text")).join(wanted.hint("merge"), "_row").withColumnRenamed("_row", "row"), "bodies")
    links = stage(verify(pairs, bodies, idf, least), "links")
    labels = components(links)
    found = second_links(marks, stars, labels, drawn, bodies, idf, least)
    final = components(labels.select(F.col("row").alias("a"), F.col("label").alias("b")).union(found.select("a", "b")))
    named = stage(first.join(final, "row", "left").select("key", F.coalesce("label", "row").alias("label")), "named")
    every = stage(base.select("_row", F.col("_s.key").alias("key"), F.col(id_column).alias("id")).join(named, "key").select("_row", "id", "label"), "labelled")
    order = F.struct(F.col("id").isNull(), "id", F.col("_row").alias("row"))
    classes = stage(every.groupBy("label").agg(F.min("id").alias("class_id"), F.min(order).alias("kept")).select("label", "class_id", F.col("kept.row").alias("kept")), "classes")
    told = stage(every.join(classes, "label").select("_row", "class_id", (F.col("_row") == F.col("kept")).alias("keep")), "told")
    discard(first, drawn, stars, pairs, bodies, links, labels, found, final, named, every, classes)
    return base.drop("_s").join(told.hint("merge"), "_row").drop("_row")


def near_duplicate_query(documents: DataFrame) -> DataFrame:
    return classify(documents.select("doc_id", "text")).select("doc_id", "class_id", "keep")
