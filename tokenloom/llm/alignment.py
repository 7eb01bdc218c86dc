"""Alignment of two tokenizers by interval coalescing: token groups between common byte offsets, and links inside them."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tokenloom.llm.batches import ranges, slices
from tokenloom.llm.bpe import WORDS, byte_symbols, public_path
from tokenloom.sources.workspace import stage

#: Groups of more links than WIDE are expanded by distinct ids. About TABLE pairs reach the tasks with their counts.
WIDE, TABLE = 1 << 12, 1 << 18
#: Pair counts fall into this many levels for each doubling.
LEVELS = 8
GROUPED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Tokenizers:
    """Both vocabularies: ids of texts, and the bytes of every id. A is a byte-level BPE file whose ids are in order of its
    merges; B is a piece model with byte fallback."""

    def __init__(self, spec: str, model: bytes) -> None:
        import sentencepiece
        import tiktoken

        symbols = byte_symbols()
        self.spec, vocabulary = spec, json.loads(spec)["model"]["vocab"]
        special = {t["content"] for t in json.loads(spec)["added_tokens"]}
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.slow = None
        self.label_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.label_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.label_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in labels], dtype=np.int64) for labels in (self.label_a, self.label_b))

    def ids_a(self, text: str) -> list[int]:
        """Ids of space + text. A run that the fast pattern matcher has no room for goes to the tokenizers library."""
        try:
            return self.a.encode_ordinary(" " + text)
        except BaseException as fault:
            if isinstance(fault, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_str(self.spec)
                self.slow.encode_special_tokens = True
                self.slow.no_truncation()
                self.slow.no_padding()
            return self.slow.encode(" " + text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by A and B; none for an empty text or where joined bytes differ from space + text."""
        a, b = [self.ids_a(t) if t else [] for t in texts], self.b.encode(texts, num_threads=1) if texts else []
        for i, t in enumerate(texts):
            if t:
                want = b" " + t.encode()
                if b"".join([self.label_a[x] for x in a[i]]) != want or b"".join([self.label_b[x] for x in b[i]]) != want:
                    a[i], b[i] = [], []
            else:
                b[i] = []
        return a, b


def joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in ids], dtype=np.int64)
    return np.concatenate([np.zeros(0, np.int64), *[np.array(x, dtype=np.int64) for x in ids if x]]), counts


def coalesce(ends_a: np.ndarray, ends_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every A and every B token. All tokens are sorted by start (A before B); with the running maximum
    of ends, a group breaks where a start reaches it."""
    starts = np.concatenate([ends_a - sizes_a, ends_b - sizes_b])
    order = np.argsort(starts, kind="stable")
    reached = np.maximum.accumulate(np.concatenate([ends_a, ends_b])[order])
    breaks = np.ones(len(order), dtype=np.int64)
    breaks[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(ends_a)], group[len(ends_a) :]


class Groups:
    """Groups of a slice of texts: ids of A and B in order, their numbers of tokens per group, and the text of each group."""

    def __init__(self, both: Tokenizers, texts: list[str]) -> None:
        a, b = both.encode(texts)
        (self.a, self.n_a), (self.b, self.n_b) = joined(a), joined(b)
        sizes_a, sizes_b = both.sizes_a[self.a], both.sizes_b[self.b]
        # Texts with tokens have as many bytes by A as by B, so their offsets run on through the slice.
        self.ends_a, self.ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        self.group_a, self.group_b = coalesce(self.ends_a, self.ends_b, sizes_a, sizes_b)
        self.count = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=self.count), np.bincount(self.group_b, minlength=self.count)
        self.first_a, self.first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        self.row = np.repeat(np.arange(len(texts)), self.n_a)[self.first_a] if self.count else np.zeros(0, np.int64)
        self.per_row = np.bincount(self.row, minlength=len(texts))

    def links(self, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, times) of every distinct id pair that a row holds linked, by row and pair; a pair is
        A's id * size_b + B's id. Overlaps expand within their group; wide groups by their distinct ids."""
        few = self.in_a * self.in_b <= WIDE
        here = np.flatnonzero(few[self.group_a])
        group = self.group_a[here]
        n = self.in_b[group]
        rows = [np.repeat(self.row[group], n)]
        pairs = [np.repeat(self.a[here], n) * size_b + self.b[ranges(self.first_b[group], n)]]
        times = [np.ones(len(pairs[0]), dtype=np.int64)]
        for g in np.flatnonzero(~few):
            a, n_a = np.unique(self.a[self.first_a[g] : self.first_a[g] + self.in_a[g]], return_counts=True)
            b, n_b = np.unique(self.b[self.first_b[g] : self.first_b[g] + self.in_b[g]], return_counts=True)
            pairs.append((a[:, None] * size_b + b).ravel())
            times.append((n_a[:, None] * n_b).ravel())
            rows.append(np.full(len(pairs[-1]), self.row[g]))
        row, pair, n = np.concatenate(rows), np.concatenate(pairs), np.concatenate(times)
        most = int(pair.max(initial=0)) + 1
        if most * (len(self.per_row) + 1) < 1 << 63:
            found, at = np.unique(row * most + pair, return_inverse=True)
            row, pair = found // most, found % most
        else:
            found, at = np.unique(np.stack([row, pair]), axis=1, return_inverse=True)
            row, pair = found
        return row, pair, np.bincount(at.ravel(), weights=n, minlength=len(row)).astype(np.int64)

    def written(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` per row, '' without tokens."""
        side = lambda ids, n: pc.binary_join(listed(ids, n, pa.int64()).cast(pa.list_(pa.string())), ",")
        each = pc.binary_join_element_wise(side(self.a, self.in_a), side(self.b, self.in_b), "|")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.per_row)]), pa.int32()), each), ";").to_pylist()


def listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def share(df: DataFrame, spec: str | None, model: str | None):
    """Both files as a broadcast; its size is theirs, about 2 MB."""
    with open(spec or public_path("byte_bpe_50k.json"), encoding="utf-8") as a, open(model or public_path("piece_bpe_32k.model"), "rb") as b:
        return df.sparkSession.sparkContext.broadcast((a.read(), b.read()))


def align_documents(df: DataFrame, text: str = "text", spec: str | None = None, model: str | None = None) -> DataFrame:
    """All columns and `aligned`: per text its groups in order, with byte offsets in space + text and both sides' ids.

    Null and empty texts, and texts that a tokenizer doesn't keep byte by byte, have no groups. Repeated rows get equal
    groups; an empty table gives an empty one. A column `aligned` is replaced. No exchange; slices of texts in Python.
    """
    shared = share(df, spec, model)

    @F.arrow_udf("array<struct<start:bigint,end:bigint,a:array<int>,b:array<int>>>")
    def work(texts: pa.Array) -> pa.Array:
        both, out = Tokenizers(*shared.value), []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            g = Groups(both, pc.fill_null(part.column(0), "").to_pylist())
            ends = g.ends_a[g.first_a + g.in_a - 1]
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            base = np.repeat(starts[(np.cumsum(g.per_row) - g.per_row)[g.per_row > 0]], g.per_row[g.per_row > 0])
            each = pa.StructArray.from_arrays(
                [pa.array(starts - base, pa.int64()), pa.array(ends - base, pa.int64()), listed(g.a, g.in_a, pa.int32()), listed(g.b, g.in_b, pa.int32())], ["start", "end", "a", "b"]
            )
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(g.per_row)]), pa.int32()), each))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))

    return df.withColumn("aligned", work(F.col(text)))


def grouped(documents: DataFrame, shared, size_b: int) -> DataFrame:
    """Per document its counts, the digest of its groups, and its distinct linked pairs with how often each is linked."""

    def work(batches):
        both = None
        for batch in batches:
            both = both or Tokenizers(*shared.value)
            for part in slices(batch, "text"):
                g = Groups(both, pc.fill_null(part.column("text"), "").to_pylist())
                row, pair, times = g.links(size_b)
                n = len(g.per_row)
                links = np.bincount(g.row, weights=g.in_a * g.in_b, minlength=n).astype(np.int64)
                digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in g.written()]
                per_row = np.bincount(row, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (g.n_a, g.n_b, g.per_row, links)), pa.array(digest, pa.string()), listed(pair, per_row, pa.int64()), listed(times, per_row, pa.int32())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return documents.select("doc_id", "text").mapInArrow(work, f"doc_id long, {GROUPED}")


def counted(rows: DataFrame, size_a: int, size_b: int, most: int = TABLE) -> tuple[tuple[np.ndarray, ...], DataFrame]:
    """How many rows hold each pair: of at most `most` frequent ones (pair, count), the highest count of every A id, and a
    table (pair, n) of the others that more than one row holds. What reaches the driver is bounded by `most`, the
    number of levels and A's vocabulary."""
    counts = stage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    level = F.floor(F.log2("n") * LEVELS).cast("int")
    cut, total = None, 0
    for found, n in sorted(counts.where("n > 1").groupBy(level).count().collect(), reverse=True):
        if total + n > most:
            break
        cut, total = found, total + n
    top = np.zeros(size_a, dtype=np.int64)
    for a, n in counts.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("n")).collect():
        top[a] = n
    frequent = (F.col("n") > 1) & (level >= cut) if cut is not None else F.lit(False)
    some = counts.where(frequent).toArrow().combine_chunks()
    column = lambda name: np.concatenate([np.zeros(0, np.int64), *[c.to_numpy() for c in some.column(name).chunks]])
    order = np.argsort(column("pair"))
    return (column("pair")[order], column("n")[order], top), counts.where((F.col("n") > 1) & ~frequent)


def weighed(rows: DataFrame, known: tuple[np.ndarray, ...], rest: DataFrame, size_b: int) -> DataFrame:
    """`n_best` and `count_sum` of every row: frequent pairs meet their counts in the task; the others count as held once
    there and meet the table `rest` by an exchange of (row, pair)."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("struct<n_best:bigint,count_sum:bigint,open:array<struct<pair:bigint,times:int>>>")
    def rate(pairs: pa.Array, times: pa.Array) -> pa.Array:
        listed_pairs, listed_counts, top = shared.value
        n_rows = len(pairs)
        pair, n = pairs.flatten().to_numpy(), times.flatten().to_numpy()
        row = np.repeat(np.arange(n_rows), pc.fill_null(pc.list_value_length(pairs), 0).to_numpy())
        at = np.minimum(np.searchsorted(listed_pairs, pair), max(len(listed_pairs) - 1, 0))
        met = listed_pairs[at] == pair if len(listed_pairs) else np.zeros(len(pair), dtype=bool)
        count = np.where(met, listed_counts[at], 1) if len(listed_pairs) else np.ones(len(pair), np.int64)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))])])
        best, sums = total(n * (count == top[pair // size_b])), total(n * count)
        open_ = np.flatnonzero(~met)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[open_], minlength=n_rows))]), pa.int32()), pa.StructArray.from_arrays([pa.array(pair[open_], pa.int64()), pa.array(n[open_], pa.int32())], ["pair", "times"])
        )
        return pa.StructArray.from_arrays([pa.array(best, pa.int64()), pa.array(sums, pa.int64()), lists], ["n_best", "count_sum", "open"])

    told = rows.withColumn("_rated", rate("pairs", "times")).withColumn("_row", F.monotonically_increasing_id())
    told = stage(told.select("_row", *[c for c in rows.columns if c not in ("pairs", "times")], "_rated"), "rated")
    top = rest.sparkSession.createDataFrame(pa.table({"a": np.arange(len(known[2])), "most": known[2]})) if len(known[2]) else None
    others = rest.withColumn("a", F.expr(f"pair div {size_b}")).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    # A pair of `others` counted as held once so far, and never as its A id's best.
    more = told.select("_row", F.explode("_rated.open").alias("o")).select("_row", "o.*").join(others, "pair")
    more = more.groupBy("_row").agg(F.sum(F.expr("times * (n - 1)")).alias("_sum"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("_best"))
    done = told.join(more, "_row", "left")
    return done.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("_rated.n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("_rated.count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def alignment_digest(documents: DataFrame, spec: str | None = None, model: str | None = None, most: int = TABLE) -> DataFrame:
    """The query's columns for every row of `documents`; see `align_documents` for the groups themselves.

    Texts are encoded once, into a stage table of pairs. Null ids, repeated rows (each counts), empty and very long texts
    give a row each; an empty table gives none. A pair's count is over all rows.
    """
    shared = share(documents, spec, model)
    both = Tokenizers(*shared.value)
    size_a, size_b = len(both.label_a), len(both.label_b)
    rows = stage(grouped(documents, shared, size_b), "aligned")
    return weighed(rows, *counted(rows, size_a, size_b, most), size_b)
