"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tokenloom.llm import folds
from tokenloom.llm.batches import slices
from tokenloom.llm.words import Powers, word_hashes
from tokenloom.sources.workspace import stage

#: Ids of their own have the FEWEST most frequent words in a corpus of up to FIRST running words, and as many more as the
#: fourth root of its size tells beyond. One id in SHARE, OTHER at least, is shared by all rarer words; the TABLE most
#: frequent of these are broadcast with their counts.
FEWEST, FIRST, SHARE, OTHER, TABLE = 960, 1 << 24, 16, 64, 1 << 16
#: Distinct words that a task counts before it sends them on; running words of a training group, about.
HELD, GROUP = 1 << 20, 1 << 20
HIDDEN, WINDOW = 16, (-2, -1, 1, 2)
BATCH, RATE = 8192, 0.1


def shapes(classes: int, members: int) -> dict[str, tuple[int, ...]]:
    """Parameters by name, in the order in which they lie in one flat array."""
    return {
        "inputs": (len(WINDOW), classes * members + 1, HIDDEN),
        "bias": (HIDDEN,),
        "classes": (HIDDEN, classes),
        "class_bias": (classes,),
        "words": (classes, HIDDEN, members),
        "word_bias": (classes, members),
    }


def views(flat: np.ndarray, classes: int, members: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(classes, members).items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def merged(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(words), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word, by its hash of 64 bits, occurs in all texts. Counts are combined in a task
    before the exchange."""

    def count(batches):
        powers, words, counts, size = Powers(), [], [], 0
        send = lambda w, n: pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "n"])
        for batch in batches:
            for rows in slices(batch, "text"):
                found, n = np.unique(word_hashes(rows.column("text"), powers)[0], return_counts=True)
                words, counts, size = [*words, found], [*counts, n], size + len(found)
                if size > 2 * HELD:
                    found, n = merged(words, counts)
                    words, counts, size = [found], [n], len(found)
                    if size > HELD:
                        yield send(found, n)
                        words, counts, size = [], [], 0
        if size:
            yield send(*merged(words, counts))

    return df.select(F.col(text).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Ids of words by their hashes, and the share that a rare word has in the id it shares.

    `listed` words (hash, count) are the vocabulary and the more frequent of the rare ones; the first `own` by count
    have ids of their own. `totals` gives the running words of each shared id. A rare word of count n has the share
    n / (total + 1) of its id; a word that occurs once has as much as all unseen ones, so the shares of an id and
    that of the unseen words sum to one.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, own: int) -> None:
        # The shared ids fill the classes, about as many as each has members.
        least = own + max(OTHER, own // (SHARE - 1))
        self.own, self.classes = own, max(1, round(least**0.5))
        self.members = -(-least // self.classes)
        self.size, self.shared = self.classes * self.members, self.classes * self.members - own
        by_count = np.lexsort((hashes.view(np.int64), -counts))
        order = np.argsort(hashes[by_count])
        self.hashes, self.counts = hashes[by_count][order], counts[by_count[:own]]
        number = np.arange(len(hashes))[order]
        ids = np.where(number < own, number, own + self.hashes.view(np.int64) % self.shared)
        self.ids = ids.astype(np.uint16 if self.size < 1 << 16 else np.uint32)
        self.weight = np.where(number < own, 0.0, np.log(np.maximum(counts[by_count][order], 1))).astype(np.float64)
        self.totals = np.zeros(self.shared, dtype=np.int64)
        self.bits = max(4, (4 * len(hashes)).bit_length())
        self.first = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    @classmethod
    def of(cls, state: dict) -> Lexicon:
        """The lexicon again from its `vars`, the plain arrays and numbers that are broadcast."""
        found = cls.__new__(cls)
        found.__dict__.update(state)
        return found

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the listed ones, or -1."""
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, found = self.first[bucket], np.full(len(hashes), -1, dtype=np.int32)
        open_ = np.flatnonzero(at < self.first[bucket + 1])
        while len(open_):
            same = self.hashes[at[open_]] == hashes[open_]
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < self.first[bucket[open_] + 1]]
        return found

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and their places among the listed ones."""
        at = self.find(hashes)
        unlisted = np.flatnonzero(at < 0)
        ids = self.ids[at] if len(self.ids) else np.zeros(len(hashes), dtype=self.ids.dtype)
        ids[unlisted] = self.own + hashes[unlisted].view(np.int64) % self.shared
        return ids, at

    def shares(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log of the share of each word in its id; an unlisted word counts as one that occurs once."""
        out = np.zeros(len(ids))
        rare = np.flatnonzero(ids >= self.own)
        listed = rare[at[rare] >= 0]
        out[listed] = self.weight[at[listed]]
        out[rare] -= np.log1p(self.totals)[ids[rare].astype(np.int64) - self.own]
        return out


def own_ids(running: int) -> int:
    """How many words have ids of their own in a corpus of so many running words."""
    return int(FEWEST * max(1.0, running / FIRST) ** 0.25)


def lexicon(counts: DataFrame) -> tuple[Lexicon, np.ndarray, DataFrame, int]:
    """The lexicon of a corpus from its (word, n), counts by id, a table of the words that occur more than once but are not
    listed, and the number of running words. The driver gets the words with ids of their own and TABLE rare ones."""
    running = counts.agg(F.sum("n")).first()[0] or 0
    own = own_ids(running)
    some = counts.orderBy(F.desc("n"), "word").limit(own + TABLE).toArrow().combine_chunks()
    column = lambda name: np.concatenate([np.zeros(0, np.int64), *[c.to_numpy() for c in some.column(name).chunks]])
    words, n = column("word"), column("n")
    least = int(n.min(initial=1 << 62))
    after = int(words[n == least].max()) if len(words) else 0
    order = np.lexsort((words, -n))
    found = Lexicon(words[order].view(np.uint64), n[order], min(own, len(words)))
    for at, total in counts.groupBy(F.pmod("word", F.lit(found.shared))).agg(F.sum("n")).collect():
        found.totals[at] = total
    top = found.ids < found.own
    np.subtract.at(found.totals, found.hashes[top].view(np.int64) % found.shared, found.counts[found.ids[top]])
    rest = counts.where((F.col("n") > 1) & ((F.col("n") < least) | (F.col("n") == least) & (F.col("word") > after)))
    return found, np.concatenate([found.counts, found.totals]), rest, running


def start(counts: np.ndarray, classes: int) -> np.ndarray:
    """Small random weights, and biases that alone give each word its share of the corpus."""
    members = len(counts) // classes
    size = sum(int(np.prod(s)) for s in shapes(classes, members).values())
    flat = (np.random.default_rng(3).normal(size=size) * 0.1).astype(np.float32)
    v, table = views(flat, classes, members), (counts + 1.0).reshape(classes, members, order="F")
    v["bias"][:] = 0
    v["class_bias"][:] = np.log(table.sum(axis=1) / table.sum())
    v["word_bias"][:] = np.log(table / table.sum(axis=1, keepdims=True))
    return flat


def padding(words: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ids with padding around every text, and the places of the words in them."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    places = np.arange(len(words)) + 2 * (row + 1)
    padded = np.full(len(words) + 2 * len(offsets), pad, dtype=words.dtype)
    padded[places] = words
    return padded, places


def picked(x: np.ndarray, which: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """log softmax of each row at its own column; with `backward`, also softmax minus one there, in place of x."""
    rows = np.arange(len(x))
    x -= x.max(axis=1, keepdims=True)
    own = x[rows, which]
    np.exp(x, out=x)
    sums = x.sum(axis=1)
    if backward:
        x /= sums[:, None]
        x[rows, which] -= 1
    return own - np.log(sums), x if backward else None


def forward(v: dict, padded: np.ndarray, places: np.ndarray, backward: bool = False):
    """log P(word | both sides) at the places: a class is predicted from the hidden layer, then a word of that class.
    With `backward`, also the gradients of the negative sum: of whole parameters by name, of the words of the
    classes that occur (by class), of the hidden layer, and the ids around each place."""
    around = [padded[places + o] for o in WINDOW]
    hidden = v["inputs"][0].take(around[0], axis=0)
    for table, near in zip(v["inputs"][1:], around[1:], strict=True):
        hidden += table.take(near, axis=0)
    hidden += v["bias"]
    np.tanh(hidden, out=hidden)
    word = padded[places]
    classes = len(v["class_bias"])
    own, member = (word % classes).astype(np.uint8 if classes <= 256 else np.uint16), word // classes
    found, error = picked(hidden @ v["classes"] + v["class_bias"], own, backward)
    # Words of one class lie together, so each class is one product.
    order = np.argsort(own, kind="stable")
    some, which = hidden.take(order, axis=0), member.take(order)
    ends = np.cumsum(np.bincount(own, minlength=classes))
    inside = np.empty(len(places), dtype=hidden.dtype)
    slope = np.empty_like(hidden) if backward else None
    touched: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(classes):
        rows = slice(ends[k - 1] if k else 0, ends[k])
        if rows.start == rows.stop:
            continue
        inside[rows], wrong = picked(some[rows] @ v["words"][k] + v["word_bias"][k], which[rows], backward)
        if backward:
            touched[k] = some[rows].T @ wrong, wrong.sum(axis=0)
            np.matmul(wrong, v["words"][k].T, out=slope[rows])
    found[order] += inside
    if not backward:
        return found
    grads = {"classes": hidden.T @ error, "class_bias": error.sum(axis=0)}
    back = error @ v["classes"].T
    back[order] += slope
    back *= 1 - hidden * hidden
    grads["bias"] = back.sum(axis=0)
    return found, grads, touched, back, around


def step(v: dict, seen: dict, padded: np.ndarray, places: np.ndarray) -> None:
    """One Adagrad step on the mean loss of a batch of places. Only classes and input words that occur are updated."""
    _, grads, touched, slope, around = forward(v, padded, places, backward=True)
    n = np.float32(len(places))

    def move(values: np.ndarray, squares: np.ndarray, g: np.ndarray) -> None:
        g = g / n
        squares += g * g
        values -= RATE * g / np.sqrt(squares)

    for name, g in grads.items():
        move(v[name], seen[name], g)
    for k, (words, bias) in touched.items():
        move(v["words"][k], seen["words"][k], words)
        move(v["word_bias"][k], seen["word_bias"][k], bias)
    for o, near in enumerate(around):
        order = np.argsort(near, kind="stable")
        sorted_ids = near[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
        g = np.add.reduceat(slope.take(order, axis=0), first, axis=0) / n
        rows = sorted_ids[first]
        seen["inputs"][o][rows] += g * g
        v["inputs"][o][rows] -= RATE * g / np.sqrt(seen["inputs"][o][rows])


def train(df: DataFrame, text: str = "text", rounds: int = 1) -> tuple[Lexicon, np.ndarray, DataFrame]:
    """(lexicon, parameters, counts of words that it does not list) from all texts. Texts are dealt into groups of about
    GROUP words by a hash of their rows. In every round each group trains the shared parameters, in the order of
    hashes; the results are averaged by words seen. So neither files nor tasks decide a result. Only counts and
    parameters leave a task, which holds one copy of the parameters at a time."""
    known, counts, rest, running = lexicon(stage(count_words(df, text), "words"))
    flat = start(counts, known.classes)
    spark = df.sparkSession
    groups, tasks = max(1, -(-running // GROUP)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = df.select(F.pmod(F.xxhash64(*df.columns), F.lit(groups)).alias("part"), F.col(text).alias("text"))
    dealt = grouped.repartition(tasks, "part").sortWithinPartitions("part", F.xxhash64("text"), "text")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((vars(known), flat))

        def fit(batches, shared=shared):
            state, given = shared.value
            known, powers, now, words = Lexicon.of(state), Powers(), None, 0
            for batch in batches:
                parts = batch.column("part").to_numpy()
                cuts = np.flatnonzero(np.diff(parts)) + 1
                for low, high in zip([0, *cuts], [*cuts, len(parts)], strict=True):
                    if low == high:
                        continue
                    if parts[low] != now:
                        if words:
                            yield folds.packed(now, np.append(mine * np.float32(words), np.float32(words)))
                        now, words, mine = int(parts[low]), 0, given.copy()
                        v = views(mine, known.classes, known.members)
                        seen = {n: np.full(x.shape, 1e-6, np.float32) for n, x in v.items()}
                    for rows in slices(batch.slice(low, high - low), "text"):
                        hashes, offsets = word_hashes(rows.column("text"), powers)
                        padded, places = padding(known.look(hashes)[0], offsets, known.size)
                        for at in range(0, len(places), BATCH):
                            step(v, seen, padded, places[at : at + BATCH])
                        words += len(places)
            if words:
                yield folds.packed(now, np.append(mine * np.float32(words), np.float32(words)))

        sums = folds.total(dealt.mapInArrow(fit, folds.SCHEMA), np.float32, len(flat) + 1)
        flat = sums[:-1] / sums[-1] if sums[-1] else flat
    return known, flat, rest


def score(df: DataFrame, model: tuple, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Add `n_words`, `log_likelihood` (sum over all words of the whole text of log P(word | both sides)) and
    `mean_log_likelihood` (null without words) to the `columns` (all, if not given). P of a rare word is that of its
    shared id times its own share there. Only texts go to Python, slice by slice. Rare words that the lexicon does not
    list meet their counts by an exchange of (row, word).

    Null and empty texts have 0 words and a sum of 0; repeated rows get equal scores; an empty table gives an empty
    one. Columns named like the added ones are replaced.
    """
    known, flat, rest = model
    shared = df.sparkSession.sparkContext.broadcast((vars(known), flat))

    @F.arrow_udf("struct<n_words:bigint,log_likelihood:double,unlisted:array<bigint>>")
    def rate(texts: pa.Array) -> pa.Array:
        state, flat = shared.value
        known, powers = Lexicon.of(state), Powers()
        v = views(flat, known.classes, known.members)
        counts, sums, left, ends = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for rows in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            hashes, offsets = word_hashes(rows.column("text"), powers)
            words, at = known.look(hashes)
            padded, places = padding(words, offsets, known.size)
            found = [forward(v, padded, places[at_ : at_ + 8 * BATCH]) for at_ in range(0, len(places), 8 * BATCH)]
            each = np.concatenate([np.zeros(0), *found]) + known.shares(words, at)
            before = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
            counts.append(np.diff(offsets))
            sums.append(before[offsets[1:]] - before[offsets[:-1]])
            missing = np.flatnonzero(at < 0)
            ends.append(ends[-1][-1] + np.searchsorted(missing, offsets[1:]))
            left.append(hashes[missing].view(np.int64))
        unlisted = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(left)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.array(np.concatenate(sums)), unlisted], ["n_words", "log_likelihood", "unlisted"])

    names = [c for c in columns or df.columns if c not in ("n_words", "log_likelihood", "mean_log_likelihood")]
    rated = df.withColumn("_rated", rate(F.col(text))).select(*names, "_rated")
    rated = stage(rated.withColumn("_row", F.monotonically_increasing_id()), "rated")
    words = rated.select("_row", F.explode("_rated.unlisted").alias("word"))
    # Logarithms are summed as whole numbers, so the order of the rows does not matter.
    log = F.round(F.log("n") * F.lit(float(1 << 40))).cast("bigint")
    more = words.join(rest, "word").groupBy("_row").agg((F.sum(log) / F.lit(float(1 << 40))).alias("_more"))
    total = F.col("_rated.log_likelihood") + F.coalesce("_more", F.lit(0.0))
    done = rated.join(more, "_row", "left").select(*names, F.col("_rated.n_words").alias("n_words"), total.alias("log_likelihood"))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return done.withColumn("mean_log_likelihood", mean)


def likelihood_query(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "text")
    return score(rows, train(rows), columns=["doc_id"])
