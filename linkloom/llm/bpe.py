"""Byte-pair encoding, decoding and counting.

A piece of text starts as single symbols. They stand in a doubly linked list;
a heap holds the ranks of adjacent pairs that the vocabulary can merge. The
lowest rank (then the leftmost place) is merged first. An entry whose symbols
have changed since it was pushed is stale and is skipped. Encoding returns the
symbols that are left, counting only subtracts the merges from the symbols at
the start, and decoding concatenates vocabulary strings.

Texts are cut at single spaces, where no piece of the pattern can reach across,
so each distinct run of non-spaces is merged once per cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from linkloom.llm.common import slices

#: The pieces that a byte-level vocabulary and a word vocabulary are trained on.
BYTE_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: White space as Unicode has it; Python also counts the four separators U+001C to U+001F.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: Runs and pieces remembered by a task in each of two generations, and the longest that are worth it.
REMEMBERED, WORTH = 250_000, 48


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and strings of one tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.lowered = bool(spec["normalizer"])
        ids = self.ids
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks[ids[a] << 32 | ids[b]] = rank
            self.merged.append(ids[a + b])
        symbols = byte_symbols()
        self.first = [ids[s] for s in symbols]
        self.last = [ids[s + self.suffix] for s in symbols]
        back = {s: b for b, s in enumerate(symbols)}
        self.strings = {i: bytes(back[c] for c in s.removesuffix(self.suffix)) if set(s) <= back.keys() else s.encode() for s, i in ids.items()}
        self.strings |= {i: s.encode() for s, i in self.specials.items()}

    def start(self, piece: str) -> list[int]:
        raw = piece.encode()
        symbols = [self.first[b] for b in raw]
        if self.suffix:
            symbols[-1] = self.last[raw[-1]]
        return symbols

    def merge(self, symbols: list[int]) -> int:
        """Merges within `symbols` and returns how often; merged-away places become -1."""
        n = len(symbols)
        rank_of, merged = self.ranks.get, self.merged
        heap = []
        for i in range(n - 1):
            rank = rank_of(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        if not heap:
            return 0
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = 0
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            rank = entry >> 32
            if symbols[i] < 0 or (j := after[i]) >= n or rank_of(symbols[i] << 32 | symbols[j]) != rank:
                continue
            merges += 1
            new = symbols[i] = merged[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(new << 32 | symbols[k])
                if rank is not None:
                    push(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbols[h] << 32 | new)
                if rank is not None:
                    push(heap, rank << 32 | h)
        return merges


class Memory(dict):
    """Answers by text; what was not asked for since it last filled up is forgotten, so its size is bounded."""

    def __init__(self, answer: Callable, remembered: int | None = None):
        super().__init__()
        self.answer = answer
        self.remembered = REMEMBERED if remembered is None else remembered
        self.older: dict = {}

    def __missing__(self, text: str):
        value = self.older.get(text)
        if value is None:
            value = self.answer(text)
        if len(text) <= WORTH:
            if len(self) >= self.remembered:
                self.older = dict(self)
                self.clear()
            self[text] = value
        return value


class ByteEncoder:
    """Encodes and decodes with a byte-level vocabulary; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(BYTE_PIECES.replace(r"[^\s", "[^" + SPACE[1:-1]).replace(r"\S", "[^" + SPACE[1:]).replace(r"\s", SPACE))
        self.crossing = regex.compile(f"{SPACE} {SPACE}")
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.specials))) if vocabulary.specials else None
        self.pieces = Memory(self._piece)
        self.runs = Memory(lambda run: self._plain(" " + run))

    def _piece(self, piece: str) -> bytes:
        symbols = self.vocabulary.start(piece)
        if self.vocabulary.merge(symbols):
            symbols = [s for s in symbols if s >= 0]
        return struct.pack(f"<{len(symbols)}I", *symbols)

    def _plain(self, text: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.pattern.findall(text)])

    def _part(self, text: str) -> bytes:
        if self.crossing.search(text):
            return self._plain(text)
        head, *rest = text.split(" ")
        return self._plain(head) + b"".join(map(self.runs.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self._part(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._part(text[at : m.start()]), struct.pack("<I", self.vocabulary.specials[m[0]])]
            at = m.end()
        return b"".join([*out, self._part(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.strings.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


class WordCounter:
    """Counts the tokens of a lower-casing vocabulary with word ends, and emits no ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(WORD_PIECES.replace(r"[^\s", "[^" + SPACE[1:-1]))
        self.space = regex.compile(SPACE + "+")
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.specials))) if vocabulary.specials else None
        self.pieces = Memory(self._piece)
        self.runs = Memory(lambda run: sum(self.pieces[p] for p in self.pattern.findall(run)))

    def _piece(self, piece: str) -> int:
        symbols = self.vocabulary.start(piece)
        return len(symbols) - self.vocabulary.merge(symbols)

    @staticmethod
    def _lower(text: str) -> str:
        # letter by letter: the form of a final sigma does not depend on its neighbours
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def _part(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = self._lower(text)
        runs = text.split() if not self.odd(text) else self.space.split(text)
        return sum(map(self.runs.__getitem__, runs))

    @staticmethod
    def odd(text: str) -> bool:
        return any(c in text for c in "\x1c\x1d\x1e\x1f")

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._part(text)
        parts = self.special.split(text)
        return sum(map(self._part, parts)) + len(parts) - 1


_LOADED: dict[tuple[str, str], object] = {}


def loaded(kind: type, spec) -> object:
    """The encoder of this Python worker for a broadcast tokenizer file."""
    text = spec.value
    key = kind.__name__, hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = kind(Vocabulary(text))
    return _LOADED[key]


def broadcast_file(df: DataFrame, path: str):
    """A tokenizer file for the tasks; its size is that of the vocabulary, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded text of every document.

    A null text is empty: no ids and an empty decoded text. Repeated rows are
    encoded each, a null doc_id stays null, other columns are left unread. An empty
    table gives no rows; a very long text is encoded whole, in one task.
    """
    spec = broadcast_file(docs, path)

    def run(batches):
        encoder = loaded(ByteEncoder, spec)
        for b in slices(batches):
            ids = [encoder.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([encoder.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every document; a null text has none of either.

    Repeated rows are counted each, a null doc_id stays null, other columns are
    left unread. An empty table gives no rows; a very long text is counted whole.
    """
    spec = broadcast_file(docs, path)

    def run(batches):
        counter = loaded(WordCounter, spec)
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(map(counter.count, texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
