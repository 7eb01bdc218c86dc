"""Ordinal quality classifier: a cumulative-link model over hashed text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tokenloom.llm.batches import SLICE_BYTES, flat, slices
from tokenloom.llm.words import Powers, mix, word_hashes

BITS, SAMPLE, TOP = 18, 20_000, 2
HEADS = (4, 6)
#: Shares above which a text shows a shape feature; each level passed is a feature of its own.
LEVELS = np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64])
#: Kinds of bytes whose shares are features: the ASCII signs, each its own kind, digits, capitals, white space.
KIND = np.full(256, -1, dtype=np.int64)
SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
KIND[SIGNS] = np.arange(len(SIGNS))
KIND[48:58], KIND[65:91], KIND[[9, 10, 13, 32]] = len(SIGNS), len(SIGNS) + 1, len(SIGNS) + 2
KINDS = len(SIGNS) + 3


def features(texts: pa.Array, powers: Powers, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, and their n + 1 offsets. Features are the words a text holds, their
    beginnings of HEADS bytes, and levels of the shares of signs, digits, capitals, white space, and of words that repeat the word before."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    words, places, *begun = word_hashes(texts, powers, HEADS)
    counts = np.diff(places)
    row = np.repeat(np.arange(n), counts)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    data, offsets = flat(texts)
    sizes = np.diff(offsets)
    kind = KIND[data]
    known = kind >= 0
    shares = np.bincount(np.repeat(np.arange(n), sizes)[known] * (KINDS + 1) + kind[known], minlength=n * (KINDS + 1)).reshape(n, KINDS + 1).astype(np.float64)
    shares[:, :KINDS] /= np.maximum(sizes, 1)[:, None]
    shares[:, KINDS] = np.bincount(row[same], minlength=n) / np.maximum(counts, 1)
    at, share, level = np.nonzero(shares[:, :, None] >= LEVELS)
    shape = mix((share * len(LEVELS) + level + 1).astype(np.uint64))
    shift = np.uint64(64 - bits)
    rows = np.concatenate([row, *[row[longer] for _, longer in begun], at]).astype(np.int64)
    keys = rows << bits | (np.concatenate([words, *[h for h, _ in begun], shape]) >> shift).astype(np.int64)
    keys = np.unique(keys)
    return (keys & ((1 << bits) - 1)).astype(np.uint32), np.searchsorted(keys >> bits, np.arange(n + 1))


@dataclass
class Model:
    """P(grade > k) = sigmoid(score - threshold[k]); one weight vector for all grades, thresholds in order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[found], dtype=np.float64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= top) per score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -50, 50)))


def fit(found: np.ndarray, offsets: np.ndarray, grades: np.ndarray, top: int = TOP, bits: int = BITS, passes: int = 20, rate: float = 0.3, lasso: float = 6e-4) -> Model:
    """Fit by proximal Adagrad on the log-likelihood of the grades, in a fixed order of batches. The lasso
    penalty leaves words that tell nothing at zero, so unknown words do not count against a text."""
    grades, n = np.asarray(grades), len(grades)
    share = [np.clip((grades > k).mean() if n else 0.5, 0.01, 0.99) for k in range(top)]
    thresholds = -np.log([s / (1 - s) for s in share])
    weights, seen = np.zeros(1 << bits), np.full(1 << bits, 1e-8)
    cut_seen = np.full(top, 1e-8)
    order = np.random.default_rng(11)
    for _ in range(passes if n else 0):
        for rows in np.array_split(order.permutation(n), max(1, n // 256)):
            counts = offsets[rows + 1] - offsets[rows]
            at = np.repeat(offsets[rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            own, columns = np.repeat(np.arange(len(rows)), counts), found[at]
            score = np.bincount(own, weights[columns], minlength=len(rows))
            g = grades[rows]
            sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
            cuts = np.concatenate([[-np.inf], thresholds, [np.inf]])
            # P(grade = g) = F(cut above) - F(cut below), F the logistic distribution around the score.
            high, low = sigmoid(cuts[g + 1] - score), sigmoid(cuts[g] - score)
            mass = np.maximum(high - low, 1e-12)
            slope_high, slope_low = high * (1 - high) / mass, low * (1 - low) / mass
            step = slope_high - slope_low  # of the negative log-likelihood, by score
            used, inverse = np.unique(columns, return_inverse=True)
            slope = np.bincount(inverse, step[own], minlength=len(used)) / len(rows)
            seen[used] += slope**2
            pace = rate / np.sqrt(seen[used])
            moved = weights[used] - pace * slope
            weights[used] = np.sign(moved) * np.maximum(np.abs(moved) - pace * lasso, 0)
            by_cut = np.array([np.sum(slope_low[g == k + 1]) - np.sum(slope_high[g == k]) for k in range(top)]) / len(rows)
            cut_seen += by_cut**2
            thresholds = np.maximum.accumulate(thresholds - rate * by_cut / np.sqrt(cut_seen) + 0.0)
            thresholds[1:] = np.maximum(thresholds[1:], thresholds[:-1] + 1e-3)
    return Model(weights.astype(np.float32), thresholds)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 2 for good and not toxic, one less for each fault; rows without a label count for nothing,
    and of several labels of one document the lowest holds."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    grade = (F.least(F.col("quality"), F.lit(1)) + 1 - F.least(F.col("toxic"), F.lit(1))).cast("int")
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(documents: DataFrame, graded: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on at most `sample` graded documents (a documented bound; by hash of the id). Their ids are broadcast to
    the documents, so no text is exchanged; the driver gets hashed features only. Of several rows of one id the one of
    the least features (by bytes) is used, so the bound holds for rows too. No grades: a model without weights."""
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")

    def read(batches):
        powers = Powers()
        for batch in batches:
            for part in slices(batch, "text"):
                found, offsets = features(part.column("text"), powers, bits)
                packed = pa.array([found[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), packed], ["doc_id", "grade", "found"])

    read_rows = rows.mapInArrow(read, "doc_id long, grade int, found binary")
    one_each = read_rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("found").alias("found"))
    got = one_each.toArrow().combine_chunks().sort_by("doc_id")
    each = [np.frombuffer(x, dtype=np.uint32) for x in got.column("found").to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    return fit(np.concatenate([np.zeros(0, np.uint32), *each]), offsets, got.column("grade").to_numpy(), bits=bits)


def score(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """Add `expected_grade`, `tail_probability` (of the top grade) and `keep` (the tail reaches `least`).

    Only texts go to Python, slice by slice; no exchange. A null text is an empty one, which has shape features only;
    repeated rows get equal scores; an empty table gives an empty one. Columns named like the added ones are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    bits = int(len(model.weights)).bit_length() - 1

    @F.arrow_udf("struct<expected_grade:double,tail_probability:double>")
    def rate(texts: pa.Array) -> pa.Array:
        model, powers, grade, tail = Model(*shared.value), Powers(), [np.zeros(0)], [np.zeros(0)]
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", SLICE_BYTES):
            tails = model.tails(model.scores(*features(part.column("text"), powers, bits)))
            grade.append(tails.sum(axis=1))
            tail.append(tails[:, -1])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(grade)), pa.array(np.concatenate(tail))], ["expected_grade", "tail_probability"])

    rated = df.drop("expected_grade", "tail_probability", "keep").withColumn("_rated", rate(F.col(text)))
    keep: Column = F.col("_rated.tail_probability") >= least
    return rated.select("*", "_rated.*", keep.alias("keep")).drop("_rated")


def quality_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(documents, grades(labels))
    return score(documents.select("doc_id", "text"), model).drop("text")
