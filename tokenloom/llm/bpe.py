"""Byte-level BPE as an automaton: compiled from merges, run over words by transitions, decoded by labels."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tokenloom.llm.batches import flat, slices

#: Fixed value: the pattern by which the byte-level tokenizer splits text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXT_SLICE, CACHED = 1 << 23, 400_000
NEVER = 1 << 60


def public_path(name: str) -> str:
    """Place of a public tokenizer's file on the driver; its content travels to the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    stands for itself, the other bytes follow in order from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    """Deterministic automaton over token labels that accepts exactly the correct tokenizations.

    It starts with one state where every byte loops. Merge t of (u, v) into w is a gadget: the state after u
    loses its arc v, so u v can no longer be read as two tokens; every state that could read u gets an arc w to
    the state that v led to. A state is therefore the last token read. The state of w begins as the state of v
    as it was at time t, and an arc w begins as the arc u was. Both inheritances are kept as links with their
    times (`right`, `left`, `born`) instead of copies, so 50,000 merges need 50,000 removed arcs. `reads` follows
    the links once and keeps its answer as an entry of the transition table.
    """

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)
        symbols = byte_symbols()
        text = lambda token: bytes(symbols[c] for c in token)
        ids = {text(token): i for token, i in model["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.label = [b""] * size
        for token, i in ids.items():
            self.label[i] = token
        for token, i in self.special.items():
            self.label[i] = token.encode()
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.removed: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        self.size, self.live = size, {token: i for token, i in ids.items() if len(token) == 1}
        for t, pair in enumerate(model["model"]["merges"]):
            u, v = (ids[text(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            w = ids[self.label[u] + self.label[v]]
            if self.live.get(self.label[u]) == u and self.live.get(self.label[v]) == v and self._reads(u, v):
                if self.label[w] not in self.live:
                    self.left[w], self.right[w], self.born[w] = u, v, t
                    self.live[self.label[w]] = w
                self.removed[u * size + v] = t
        #: Beginnings of tokens; True where the beginning is itself a token.
        self.heads = {token[:n]: False for token in self.live for n in range(2, len(token))} | dict.fromkeys(self.live, True)
        self.words = regex.compile(WORDS)

    def _reads(self, state: int, token: int) -> bool:
        before = NEVER
        while state >= 0:
            arc, until = token, NEVER
            while arc >= 0:
                t = self.removed.get(state * self.size + arc)
                if t is not None and t < before and t <= until:
                    return False
                arc, until = self.left[arc], self.born[arc]
            state, before = self.right[state], self.born[state]
        return True

    def reads(self, state: int, token: int) -> bool:
        """Whether the state after the token `state` has an arc `token`."""
        key = state * self.size + token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= CACHED * 5:
                self.table.clear()
            found = self.table[key] = self._reads(state, token)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word. From each position the longest arc that its state reads is tried
        first. The automaton accepts one tokenization of every prefix, so a position whose arcs all fail is
        dead for good and never entered again: the work grows with the word's length only."""
        live, n = self.live, len(word)
        if (whole := live.get(word)) is not None:
            return [whole]
        table, reads, heads, size = self.table, self.reads, self.heads, self.size
        ids: list[int] = []
        ends: list[int] = [0]
        dead: set[int] = set()
        at = tried = 0  # tried: the length that failed last at this position
        while at < n:
            if tried:
                most = tried - 1
            else:
                most, end = 1, at + 2
                while end <= n and (known := heads.get(word[at:end])) is not None:
                    if known:
                        most = end - at
                    end += 1
            base = ids[-1] * size if ids else -1
            for length in range(most, 0, -1):
                token = live.get(word[at : at + length])
                if token is None or at + length in dead:
                    continue
                if base < 0 or (found := table.get(base + token)) or found is None and reads(ids[-1], token):
                    ids.append(token)
                    at += length
                    ends.append(at)
                    tried = 0
                    break
            else:
                dead.add(at)
                ids.pop()
                ends.pop()
                at, tried = ends[-1], at - ends[-1]
        return ids

    def encode(self, text: str, words: dict | None = None) -> list[int]:
        """Token ids of a text; strings of special tokens are those tokens."""
        words = {} if words is None else words
        parts = [text]
        if any([s in text for s in self.special]):
            parts = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)
        found: list[int] = []
        for part in parts:
            if part in self.special:
                found.append(self.special[part])
                continue
            for word in self.words.findall(part):
                if (ids := words.get(word)) is None:
                    if len(words) >= CACHED:
                        words.clear()
                    ids = words[word] = self.encode_word(word.encode())
                found += ids
        return found

    def decode(self, ids: list[int]) -> str:
        """Emit the labels of the arcs and read them as UTF-8."""
        return b"".join([self.label[i] for i in ids]).decode("utf-8", "replace")


#: Bytes after which a space or line break cannot be known to end its run of white space: ASCII white space and
#: the first bytes of other white space in UTF-8.
OPEN = np.zeros(256, dtype=bool)
OPEN[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def chunks(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Cut texts before every last white-space character of a run, where words always end: distinct chunks by
    index, and the n + 1 offsets of the texts' chunks. White space stands at the start of its chunk."""
    data, offsets = flat(texts)
    starts = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 1:
        starts[:-2] = ((data[:-1] == 32) | (data[:-1] == 10)) & ~OPEN[data[1:]]
    starts[offsets] = True
    places = np.flatnonzero(starts[:-1])
    buffers = [None, pa.py_buffer(np.append(places, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    pieces = pa.LargeStringArray.from_buffers(len(places), buffers[1], buffers[2])
    return pieces.dictionary_encode(), np.searchsorted(places, offsets)


def digest_batches(spec):
    """Batches of (doc_id, text) to the query's columns, with one automaton per task."""

    def work(batches):
        auto = Automaton(spec.value)
        mark = "|".join(map(regex.escape, auto.special))
        words: dict[str, list[int]] = {}
        known: dict[str, tuple[int, str, bytes]] = {}

        def told(chunk: str) -> tuple[int, str, bytes]:
            ids = auto.encode(chunk, words)
            return len(ids), "".join([f",{i}" for i in ids]), b"".join([auto.label[i] for i in ids])

        for batch in batches:
            for part in slices(batch, "text", TEXT_SLICE):
                texts = pc.fill_null(part.column("text"), "")
                odd = pc.match_substring_regex(texts, mark).to_numpy(zero_copy_only=False) if mark else np.zeros(len(texts), bool)
                index, places = chunks(texts)
                each = []
                for chunk in index.dictionary.to_pylist():
                    if (found := known.get(chunk)) is None:
                        if len(known) >= CACHED:
                            known.clear()
                        found = told(chunk)
                        if len(chunk) < 64:
                            known[chunk] = found
                    each.append(found)
                counts, written, plain = ([x[i] for x in each] for i in range(3))
                codes = index.indices.to_numpy()
                totals = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64)[codes])]) if len(codes) else np.zeros(1, np.int64)
                out = []
                for row in range(len(texts)):
                    if odd[row]:  # marks of special tokens cut white space elsewhere
                        n, ids, data = told(texts[row].as_py())
                    else:
                        own = codes[places[row] : places[row + 1]].tolist()
                        n = int(totals[places[row + 1]] - totals[places[row]])
                        ids, data = "".join([written[i] for i in own]), b"".join([plain[i] for i in own])
                    decoded = data.decode("utf-8", "replace")
                    out.append((n, hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return work


def encode_documents(documents: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """All columns and `ids` (array<int>) of each whole text; a null or empty text has none. Repeated rows get equal ids, an
    empty table gives an empty one, and a column `ids` is replaced. Each text has one tokenization, so there are no ties.
    A task compiles one automaton and holds a slice of texts at a time."""
    spec = share(documents, path)
    rows = documents.drop("ids")
    schema = StructType([*rows.schema.fields, StructField("ids", ArrayType(IntegerType()))])
    arrow = to_arrow_schema(schema)

    def work(batches):
        auto, words = Automaton(spec.value), {}
        for batch in batches:
            for part in slices(batch, text, TEXT_SLICE):
                ids = pa.array([auto.encode(t or "", words) for t in part.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], schema=pa.schema([*part.schema, arrow.field("ids")]))

    return rows.mapInArrow(work, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """All columns and `decoded`, the text of `ids` (null ids decode to an empty text). Repeated rows decode alike, an empty
    table gives an empty one, and a column `decoded` is replaced."""
    spec = share(encoded, path)
    rows = encoded.drop("decoded")
    schema = StructType([*rows.schema.fields, StructField("decoded", StringType())])
    arrow = to_arrow_schema(schema)

    def work(batches):
        auto = Automaton(spec.value)
        for batch in batches:
            texts = pa.array([auto.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], schema=pa.schema([*batch.schema, arrow.field("decoded")]))

    return rows.mapInArrow(work, schema)


def share(df: DataFrame, path: str | None):
    """The tokenizer's file as a broadcast (its size is that of the file, about 1.5 MB)."""
    with open(path or public_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_digest(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digests of ids and of the decoded text. Repeated rows, null ids and empty or very
    long texts give a row each; an empty table gives none. Only a slice of texts is in a worker at a time."""
    spec = share(documents, path)
    return documents.select("doc_id", "text").mapInArrow(digest_batches(spec), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
