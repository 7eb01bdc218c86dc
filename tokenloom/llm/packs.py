"""Hierarchical packing: documents go to context-size tiers, long windows are filled from shorter tiers."""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tokenloom.llm.batches import flat, ranges, slices

TIERS = (2048, 1024, 512, 256)
GROUP_BYTES, TEXT_SLICE, STEP = 1 << 21, 1 << 22, 8
#: Letters-only pieces encoded as one text, and pieces kept by a task.
JOINED, STORED = 512, 600_000
END = 1


def public_path(name: str) -> str:
    """Place of a public tokenizer's file on the driver; its content travels to the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 apostrophe, 5 part of a longer character.
KIND = np.full(256, 3, dtype=np.uint8)
KIND[[32, 10]] = 0
KIND[65:91] = KIND[97:123] = 1
KIND[48:58] = 2
KIND[39] = 4
KIND[128:] = 5


def pieces(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Cut texts where the word tokenizer always cuts: before a space or line break, and between ASCII letters,
    digits and signs (not at apostrophes, which may begin a contraction). ASCII capitals are lowered, as the
    tokenizer does. Distinct pieces by index, and the n + 1 offsets of the texts' pieces."""
    data, offsets = flat(pc.ascii_lower(texts))
    starts = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 1:
        kind = KIND[data]
        before, after = kind[:-1], kind[1:]
        plain = (before < 4) & (after < 4) & (before > 0)
        starts[1:-1] = (after == 0) | (plain & ((before != after) | (after == 2)))
    starts[offsets] = True
    places = np.flatnonzero(starts[:-1])
    ends = pa.py_buffer(np.append(places, len(data)).astype(np.int64))
    cut = pa.LargeStringArray.from_buffers(len(places), ends, pa.py_buffer(np.ascontiguousarray(data)))
    return cut.dictionary_encode(), np.searchsorted(places, offsets)


def only_letters(piece: str) -> bool:
    """Whether a piece is letters only as the tokenizer sees it, in form C and lower case: some letters become a
    letter and a mark there, at which the tokenizer cuts."""
    word = piece.strip(" \n")
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class Pieces:
    """Ids of distinct pieces, each worked out once while the store is not full.

    Letters-only pieces are one word each, so many are encoded as one text and told apart by the ids that end a
    word; other pieces are encoded on their own, and so are those of a text that ends another number of words.
    """

    def __init__(self, coder, wide: type) -> None:
        self.coder, self.wide = coder, wide
        ends = [i for token, i in coder.get_vocab(True).items() if token.endswith("</w>")]
        self.closes = np.zeros(coder.get_vocab_size(True) + 1, dtype=bool)
        self.closes[ends] = True
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.starts, self.sizes = (np.zeros(0, t) for t in (self.wide, np.int64, np.int64))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.wide) for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, parts: list[str]) -> None:
        letters = [p for p in parts if only_letters(p)]
        alone = [p for p in parts if not only_letters(p)]
        plain, joined, sizes = [], [np.zeros(0, self.wide)], [np.zeros(0, np.int64)]
        chunks = [letters[i : i + JOINED] for i in range(0, len(letters), JOINED)]
        for chunk, ids in zip(chunks, self.encode([" ".join(c) for c in chunks]), strict=True):
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(chunk) and ends[-1] == len(ids):
                plain += chunk
                joined.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                alone += chunk
        each = self.encode(alone)
        self.slot.update((p, len(self.sizes) + i) for i, p in enumerate([*plain, *alone]))
        self.ids = np.concatenate([self.ids, *joined, *each])
        self.sizes = np.concatenate([self.sizes, *sizes, np.array([len(x) for x in each], dtype=np.int64)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def slots(self, parts: list[str]) -> np.ndarray:
        if len(self.slot) > STORED:
            self.clear()
        slot = self.slot
        fresh = [p for p in parts if p not in slot]
        if fresh:
            self.add(fresh)
        return np.fromiter(map(slot.__getitem__, parts), np.int64, len(parts))


def tokenize_batches(spec, end: int):
    """Batches (..., text) to (..., ids binary of little-endian uint16 or uint32, n)."""

    def work(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(spec.value)
        coder.no_padding()
        coder.no_truncation()
        special = [t.content for t in coder.get_added_tokens_decoder().values()]
        wide = np.uint16 if coder.get_vocab_size(True) <= 1 << 16 and end < 1 << 16 else np.uint32
        store = Pieces(coder, wide)
        for batch in batches:
            for part in slices(batch, "text", TEXT_SLICE):
                texts = pc.fill_null(part.column("text"), "")
                marked = np.zeros(len(texts), dtype=bool)
                for mark in special:
                    marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
                # Texts with marks of special tokens are encoded whole; their ids and the closing id follow the store's.
                whole = {i: coder.encode(texts[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(marked)}
                index, places = pieces(pc.if_else(pa.array(~marked), texts, ""))
                slots = store.slots(index.dictionary.to_pylist())[index.indices.to_numpy()]
                more = [*whole.values(), [end]]
                known = len(store.sizes)
                sizes = np.concatenate([store.sizes, np.array([len(x) for x in more], dtype=np.int64)])
                values = np.concatenate([store.ids, *[np.array(x, dtype=wide) for x in more]])
                starts = np.cumsum(sizes) - sizes
                slots = np.insert(slots, places[1:], known + len(more) - 1)
                places = places + np.arange(len(texts) + 1)
                for k, i in enumerate(whole):
                    slots = np.insert(slots, places[i + 1] - 1, known + k)
                    places[i + 1 :] += 1
                lengths = sizes[slots]
                ids = values[ranges(starts[slots], lengths)]
                ends = np.concatenate([[0], np.cumsum(lengths)])[places]
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends * ids.itemsize), pa.py_buffer(ids)])
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], binary.cast(pa.binary()), pa.array(np.diff(ends))], [*names, "ids", "n"])

    return work


def place(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Lay documents of the given lengths into windows: pieces (document, start, length, window, offset) and the
    tier of each window.

    Full windows of the largest size are cut off long documents. What is left of each document goes to the
    smallest tier that holds it. From the longest tier down, every piece opens a window of its tier, whose gap
    takes the longest shorter piece that fits, again and again; when none fits, the shortest is cut to fill the
    gap, so the window is full. Once too few short pieces are left for that, what remains is laid end to end
    and cut into windows of falling powers of two, so these are full as well.
    """
    out: list[tuple[int, int, int, int, int]] = []
    sizes: list[int] = []
    longest = tiers[0]
    by_tier: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for document, n in enumerate(lengths):
        start = 0
        while n - start >= longest:
            out.append((document, start, longest, len(sizes), 0))
            sizes.append(longest)
            start += longest
        if n > start:
            by_tier[min(t for t in tiers if t >= n - start)].append((n - start, document, start))
    for pieces_of in by_tier.values():
        pieces_of.sort(reverse=True)
    tail: list[tuple[int, int, int]] = []
    for at, tier in enumerate(tiers):
        shorter = sorted(x for t in tiers[at + 1 :] for x in by_tier[t])
        left = sum(x[0] for x in shorter)
        for n, document, start in by_tier[tier]:
            gap = tier - n
            if left < gap:
                tail.append((n, document, start))
                continue
            window, offset = len(sizes), n
            sizes.append(tier)
            out.append((document, start, n, window, 0))
            while gap:
                fits = bisect_right(shorter, (gap, 1 << 60, 0)) - 1
                size, other, begin = shorter.pop(max(fits, 0))
                take = min(size, gap)
                out.append((other, begin, take, window, offset))
                if take < size:
                    insort(shorter, (size - take, other, begin + take))
                offset, gap, left = offset + take, gap - take, left - take
        for t in tiers[at + 1 :]:
            by_tier[t] = []
        for x in reversed(shorter):
            by_tier[min(t for t in tiers[at + 1 :] if t >= x[0])].append(x)
    total = sum(x[0] for x in tail)
    window, room, offset = -1, 0, 0
    for n, document, start in tail:
        while n:
            if not room:
                room = min(longest, 1 << (total.bit_length() - 1))
                window, offset = len(sizes), 0
                sizes.append(room)
            take = min(n, room)
            out.append((document, start, take, window, offset))
            start, n, room, offset, total = start + take, n - take, room - take, offset + take, total - take
    return out, sizes


def step_groups(pieces_of: list[tuple[int, int, int, int, int]], sizes: list[int], step: int = STEP) -> list[int]:
    """A step per window: windows of one tier are dealt, dearest first and in turning order, to steps of `step`
    windows, so that the steps of a tier cost about the same (attention inside documents: sum of squares)."""
    cost = [0] * len(sizes)
    for _, _, n, window, _ in pieces_of:
        cost[window] += n * n
    steps, first = [0] * len(sizes), 0
    for tier in sorted(set(sizes), reverse=True):
        own = sorted((w for w in range(len(sizes)) if sizes[w] == tier), key=lambda w: (-cost[w], w))
        count = -(-len(own) // step)
        for i, w in enumerate(own):
            turn, at = divmod(i, count)
            steps[w] = first + (at if turn % 2 == 0 else count - 1 - at)
        first += count
    return steps


def pack_documents(documents: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, end: int = END, step: int = STEP) -> DataFrame:
    """Pieces of all documents (doc_id, text) in packed windows, with their ids.

    Each document is its ids and then `end`; a null or empty text is `end` alone. Documents are dealt by hash to
    groups of about GROUP_BYTES of text, which are packed on their own, so no task needs more than a group and
    one long document, or what one scan task holds of equal rows. Repeated rows are packed each. Which documents share a
    window depends on the splits of the scan; a repeated task gives the same windows. An empty table gives no rows. Columns: doc_id, start, length,
    ids (binary, little-endian unsigned 32 bits), doc_tokens, sequence_id, offset, tier, step_id.
    """
    with open(path or public_path("word_bpe_49k.json"), encoding="utf-8") as file:
        spec = documents.sparkSession.sparkContext.broadcast(file.read())
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    # Rows that are equal in id and text are told apart by their scan task, so even a third of all rows makes no large group.
    rows = documents.select("doc_id", F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "text", F.spark_partition_id()), F.lit(groups)).alias("g"), "text")
    tokens = rows.mapInArrow(tokenize_batches(spec, end), "doc_id long, g long, ids binary, n long")

    def pack(table: pa.Table) -> pa.Table:
        numbers = table.column("n").to_numpy()
        ids = table.column("doc_id").combine_chunks()
        data = table.column("ids").to_pylist()
        key = pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        order = np.lexsort((np.array([zlib.crc32(x) for x in data]), key, numbers))
        laid, sizes = place([int(numbers[i]) for i in order], tiers)
        steps = step_groups(laid, sizes, step)
        base = int(table.column("g")[0].as_py()) << 32
        document, start, length, window, offset = (np.array(x, dtype=np.int64) for x in zip(*laid, strict=True))
        row = order[document]
        kind = [np.uint16 if len(x) == 2 * n else np.uint32 for x, n in zip(data, numbers, strict=True)]
        words = [np.frombuffer(x, dtype=k) for x, k in zip(data, kind, strict=True)]
        cut = [words[r][s : s + n].astype("<u4").tobytes() for r, s, n in zip(row, start, length, strict=True)]
        return pa.table(
            {
                "doc_id": ids.take(pa.array(row)),
                "start": start,
                "length": length,
                "ids": pa.array(cut, pa.binary()),
                "doc_tokens": numbers[row],
                "sequence_id": base + window,
                "offset": offset,
                "tier": np.array(sizes, dtype=np.int64)[window],
                "step_id": base + np.array(steps, dtype=np.int64)[window],
            }
        )

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_id long"
    return tokens.groupBy("g").applyInArrow(pack, schema)


def pack_digest(documents: DataFrame) -> DataFrame:
    packed = pack_documents(documents.select("doc_id", "text"))
    digest = packed.withColumn("ids_crc32", F.crc32("ids"))
    return digest.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id")
