"""Substring deduplication by relative Lempel-Ziv parsing: texts are factored against indexed reference blocks, and
factors of at least a window of words that occur earlier in the corpus are removed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tokenloom.llm.batches import slices
from tokenloom.llm.words import Powers, mix, word_hashes

#: Words of a window, and of the anchors by which blocks are indexed; windows of a piece at most.
WINDOW, ANCHOR, PIECE = 20, 5, 64
#: Words that a task indexes as one block before it sends them on; windows that it factors together.
BLOCK_WORDS, TOGETHER = 1 << 21, 1 << 20
#: Anchors of more pieces than a share of 2^-HOT_BITS of all, MANY at least, are dealt by window.
HOT_BITS, MANY = 18, 1024
#: Bytes kept of the hash of a window, beside the 8 bytes of its anchor.
KEPT = 6
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
PIECES = "key long, doc long, tie long, place long, windows binary, from_doc long, from_start long"
FACTORS = "doc long, tie long, start long, n int, from_doc long, from_start long"
NO_ID = -(1 << 63)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[: len(values) - (width - span)], values[width - span :])


class Cut:
    """The windows of a slice of texts, cut into pieces: runs of windows that share an anchor.

    The anchor of a window is the least hash of the runs of ANCHOR words in it, so equal windows have equal anchors, and
    an index by anchors finds every place that can hold a window. With `hot` anchors each window is a piece of its own
    and its own key.
    """

    def __init__(self, texts: pa.Array, powers: Powers, hot: np.ndarray) -> None:
        words, offsets = word_hashes(texts, powers, kinds=NOT_SPACE, lower=False)
        n = len(words)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.n_words, self.row = n, np.zeros(0, np.int64)
        self.start = self.n = self.row
        self.key = self.whole = self.windows = np.zeros(0, np.uint64)
        if n < WINDOW:
            return
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:n], dtype=np.uint64)])
            run = lambda size, salt: mix((sums[size:] - sums[:-size]) * down[: n - size + 1] + np.uint64(salt))
            windows, anchors = run(WINDOW, 1), least(run(ANCHOR, 2), WINDOW - ANCHOR + 1)
            valid = np.arange(n - WINDOW + 1) + WINDOW <= offsets[1:][self.rows[: n - WINDOW + 1]]
            at = np.arange(len(windows))
            begins = valid.copy()
            begins[1:] &= ~valid[:-1] | (anchors[1:] != anchors[:-1])
            run_start = np.maximum.accumulate(np.where(begins, at, 0))
            alone = np.isin(anchors, hot) if len(hot) else np.zeros(len(at), dtype=bool)
            begins = valid & (begins | ((at - run_start) % PIECE == 0) | alone)
            first = np.flatnonzero(begins)
            inside = np.cumsum(valid)
            self.n = np.diff(np.append(inside[first] - 1, inside[-1])) if len(first) else self.row
            self.row = self.rows[first]
            self.start = first - offsets[self.row]
            self.key = np.where(alone[first], mix(windows[first] + np.uint64(3)), anchors[first])
            self.whole = mix((sums[first + self.n + (WINDOW - 1)] - sums[first]) * down[first] + self.n.astype(np.uint64))
            self.windows = windows[valid]


def heavy(docs: DataFrame) -> np.ndarray:
    """Anchors whose pieces would be too many for one group. Each task names those that are frequent in its own texts; at
    most 2^HOT_BITS of them are more frequent than the limit, and only these reach the driver."""

    def count(batches):
        powers, found, total = Powers(), [], 0
        empty = np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                own = Cut(part.column("text"), powers, empty).key
                found.append(own)
                total += len(own)
                if total >= BLOCK_WORDS:
                    yield told(found, total)
                    found, total = [], 0
        if total:
            yield told(found, total)

    def told(found: list, total: int) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        often = n > max(8, total >> HOT_BITS)
        keys, n = np.append(keys[often].view(np.int64), 0), np.append(n[often], total)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64()), pa.array(np.arange(len(keys)) == len(keys) - 1)], ["key", "n", "all"])

    counts = docs.select("text").mapInArrow(count, "key long, n long, all boolean").groupBy("all", "key").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("all") | (F.col("n") > MANY)).orderBy(F.desc("all"), F.desc("n"), "key").limit(1 + (1 << HOT_BITS)).collect()
    limit = max(MANY, (rows[0].n if rows else 0) >> HOT_BITS)
    return np.array(sorted(r.key for r in rows[1:] if r.n > limit), dtype=np.int64).view(np.uint64)


def binary(windows: np.ndarray, n: np.ndarray) -> pa.Array:
    """The KEPT upper bytes of each window's hash, joined per piece."""
    data = np.ascontiguousarray((windows >> np.uint64(64 - 8 * KEPT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT])
    offsets = np.concatenate([[0], np.cumsum(n)]) * KEPT
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of all pieces, and how many each has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(-1, KEPT)
    wide = np.zeros((len(data), 8), dtype=np.uint8)
    wide[:, :KEPT] = data
    return wide.view("<u8").ravel().astype(np.uint64), np.diff(offsets) // KEPT


def index_block(hot):
    """Batches of (doc, tie, text) to pieces. Of equal pieces within a block the earliest is kept for the exchange; the
    others are factors already, so a passage that a third of all texts hold is sent once by each block."""

    def work(batches):
        powers, hot_keys, held, size = Powers(), hot.value, [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                cut = Cut(part.column("text"), powers, hot_keys)
                doc, tie = (part.column(c).to_numpy() for c in ("doc", "tie"))
                held.append((cut.key, cut.whole, doc[cut.row], tie[cut.row], cut.start, cut.n, cut.windows))
                size += cut.n_words
                if size >= BLOCK_WORDS:
                    yield from sent(held)
                    held, size = [], 0
        if held:
            yield from sent(held)

    def sent(held: list):
        key, whole, doc, tie, start, n, windows = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(key):
            return
        order = np.lexsort((start, tie, doc, whole))
        first = np.ones(len(order), dtype=bool)
        first[1:] = whole[order][1:] != whole[order][:-1]
        source = np.empty(len(order), dtype=np.int64)
        source[order] = order[np.flatnonzero(first)][np.cumsum(first) - 1]
        kept = source == np.arange(len(order))
        place = start << 7 | n
        far = np.flatnonzero(~kept)
        nothing = pa.nulls(int(kept.sum()), pa.int64())
        at = binary(windows[np.repeat(kept, n)], n[kept])
        names = [f.split(" ")[0] for f in PIECES.split(", ")]
        for low in range(0, len(at), 1 << 16):
            rows = np.flatnonzero(kept)[low : low + (1 << 16)]
            columns = [pa.array(x[rows]) for x in (key.view(np.int64), doc, tie, place)]
            yield pa.RecordBatch.from_arrays([*columns, at.slice(low, len(rows)), nothing.slice(low, len(rows)), nothing.slice(low, len(rows))], names)
        if len(far):
            columns = [whole[far].view(np.int64) + far, doc[far], tie[far], place[far]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(far), pa.binary()), pa.array(doc[source[far]]), pa.array(start[source[far]])], names)

    return work


def factor_blocks(batches):
    """Pieces by key, then in the order of the corpus, to factors. Each run of keys is a reference block: its windows are
    indexed, and every piece is factored against it greedily. A factor goes on while the next window follows in
    the reference too; at its end the next window is looked up anew."""
    held, size = [], 0
    for batch in batches:
        done = pc.is_null(batch.column("windows"))
        passed = batch.filter(done)
        if passed.num_rows:
            place = passed.column("place").to_numpy()
            yield factors_of(passed.column("doc"), passed.column("tie"), place >> 7, place & 127, passed.column("from_doc"), passed.column("from_start"))
        batch = batch.filter(pc.invert(done))
        while batch.num_rows:
            held, size = [*held, batch], size + batch.num_rows * 8
            batch = batch.slice(0, 0)
            if size >= TOGETHER:
                # The last key may go on in the next batch.
                rows = pa.Table.from_batches(held).combine_chunks()
                keys = rows.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield from factored(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = (len(keys) - cut) * 8 if cut else 0
    if held:
        yield from factored(pa.Table.from_batches(held).combine_chunks())


def factors_of(*columns) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2
    return pa.RecordBatch.from_arrays([x.cast(k) if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [f.split(" ")[0] for f in FACTORS.split(", ")])


def factored(rows: pa.Table):
    key, doc, tie, place = (rows.column(c).to_numpy() for c in ("key", "doc", "tie", "place"))
    windows, n = unpacked(pa.concat_arrays(rows.column("windows").chunks))
    piece = np.repeat(np.arange(len(n)), n)
    own = np.arange(len(piece))
    start = (place >> 7)[piece] + own - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        code = mix(key.view(np.uint64)[piece] + mix(windows))
    order = np.argsort(code, kind="stable")
    first = np.ones(len(order), dtype=bool)
    first[1:] = code[order][1:] != code[order][:-1]
    source = np.empty(len(order), dtype=np.int64)
    source[order] = order[np.flatnonzero(first)][np.cumsum(first) - 1]
    found = np.flatnonzero(source != own)
    if not len(found):
        return
    last = np.zeros(len(found), dtype=bool)
    last[1:] = (found[1:] == found[:-1] + 1) & (piece[found[1:]] == piece[found[:-1]])
    last[1:] &= (source[found[1:]] == source[found[:-1]] + 1) & (piece[source[found[1:]]] == piece[source[found[:-1]]])
    heads = np.flatnonzero(~last)
    head, sizes = found[heads], np.diff(np.append(heads, len(found)))
    yield factors_of(doc[piece[head]], tie[piece[head]], start[head], sizes, doc[piece[source[head]]], start[source[head]])


def identified(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns `_doc` and `_tie` that order the documents and tell them apart: a missing id comes first, and texts of
    one id follow each other by hash. Where no id has two texts, as usual, `_tie` is 0."""
    rows = df.withColumns({"_doc": F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), "_tie": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    shared = rows.groupBy("_doc").agg((F.min("_tie") != F.max("_tie")).alias("x")).where("x").limit(1).collect()
    return rows if shared else rows.withColumn("_tie", F.lit(0).cast("long"))


def factor_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc, tie, start, n, from_doc, from_start`: factors of the documents, as `identified` names them, that occur earlier
    in the corpus. The n windows of 20 words (characters other than ASCII white space) from word `start` on equal those
    of `from_doc` from word `from_start` on, an earlier document or an earlier place in the same one.

    Every window that occurs earlier lies in exactly one factor. Reference blocks are dealt by anchors, and a document is
    factored against all blocks that its anchors name; no other block can hold a window of it.
    """
    docs = df.select(F.col("_doc").alias("doc"), F.col("_tie").alias("tie"), F.col(text).alias("text")) if "_doc" in df.columns else identified(df, key, text).select(F.col("_doc").alias("doc"), F.col("_tie").alias("tie"), F.col(text).alias("text"))
    spark = df.sparkSession
    hot = spark.sparkContext.broadcast(heavy(docs))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = docs.mapInArrow(index_block(hot), PIECES).repartition(tasks, "key").sortWithinPartitions("key", "doc", "tie", "place")
    return pieces.mapInArrow(factor_blocks, FACTORS)


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns, with `text` cut down to the kept words, joined by one space, and `n_words` and `n_removed` added.

    A word goes if a window of 20 words over it also starts earlier: in a document of smaller id, or earlier in the same
    document. Windows are judged on the texts as given. Missing ids count as the smallest; texts of one id follow each
    other by hash, and rows equal in id and text are one document, so each gets the same result. Null and empty texts
    have no words. An empty table gives an empty one. Columns named like the added ones are replaced.
    """
    rows = identified(df.drop("n_words", "n_removed"), key, text)
    places = factor_documents(rows, key, text).groupBy("doc", "tie").agg(F.collect_list(F.col("start") * (2 * PIECE) + F.col("n")).alias("_places"))

    @F.arrow_udf("struct<text:string,n_words:bigint,n_removed:bigint>")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        kept, n_words, n_removed = [], [], []
        for text, spans in zip(texts, places, strict=True):
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            n_removed.append(0)
            if spans.is_valid:
                packed = spans.values.to_numpy()
                start, n = packed // (2 * PIECE), packed % (2 * PIECE)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n + (WINDOW - 1), -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_removed[-1] = int(gone.sum())
                words = [words[i] for i in np.flatnonzero(~gone)]
            kept.append(b" ".join(words))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["text", "n_words", "n_removed"])

    same = (F.col("_doc") == F.col("doc")) & (F.col("_tie") == F.col("tie"))
    met = rows.join(places.hint("shuffle_hash"), same, "left").withColumn("_cut", cut(F.col(text), F.col("_places")))
    names = [F.col("_cut.text").alias(text) if c == text else F.col(c) for c in df.columns if c not in ("n_words", "n_removed")]
    return met.select(*names, "_cut.n_words", "_cut.n_removed")


def repeat_digest(documents: DataFrame) -> DataFrame:
    """The query's columns for every row of `documents`."""
    kept = drop_repeats(documents.select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT u, doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
y AS (SELECT u, doc_id, s, array_to_string(w[s:s + 19], ' ') AS v FROM x),
r AS (SELECT u, s FROM y QUALIFY row_number() OVER (PARTITION BY v ORDER BY doc_id, s) > 1),
g AS (SELECT u, list(DISTINCT i) AS gone FROM (SELECT u, unnest(range(s, s + 20)) AS i FROM r) GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (u)
"""
