"""Byte-pair encoding and decoding with a public vocabulary file.

Merging works on a doubly linked list of symbols and a priority queue of
(rank, position). A popped entry whose symbols have changed since it was pushed
is stale and skipped. Decoding joins vocabulary strings.

Nulls count as empty texts and give no ids. Empty texts give no ids. Texts of any
length are encoded whole: time is n log n in the longest unbroken word, and the
word caches are bounded by count and by length of what they keep. Repeated rows
give repeated results. Columns besides the two that are read stay out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import text_of

#: The path of a vocabulary file names it on every worker; parsed once a process.
_LOADED: dict[str, BpeCodec] = {}

#: Letters and marks for which the standard module's classes are exact.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-İĲ-ſ]")
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next free code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(free)
            free += 1
    return [table[b] for b in range(256)]


class BpeCodec:
    """A word-level BPE vocabulary: lower case, white space dropped, word ends marked."""

    def __init__(self, path: str, cache: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.ranks.setdefault((self.vocab[left], self.vocab[right]), rank)
            self.made.append(self.vocab[left + right])
        symbols = byte_symbols()
        self.inner = [self.vocab[x] for x in symbols]
        self.last = [self.vocab[x + self.end] for x in symbols]
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]
        self._unicode_words = None
        self.cache = cache
        self._words: dict[str, list[int]] = {}
        self._words_before: dict[str, list[int]] = {}
        self._chunks: dict[str, tuple[bytes, bytes]] = {}
        self._chunks_before: dict[str, tuple[bytes, bytes]] = {}

    @staticmethod
    def load(path: str) -> BpeCodec:
        if path not in _LOADED:
            _LOADED[path] = BpeCodec(path)
        return _LOADED[path]

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to one word's symbols, lowest rank first and leftmost among equals."""
        n = len(ids)
        if n < 2:
            return ids
        rank_of, made_by = self.ranks.get, self.made
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # An entry is rank * 2**40 + position; the rank tells which pair it was pushed for.
        queue = [rank << 40 | i for i, pair in enumerate(zip(ids, ids[1:])) if (rank := rank_of(pair)) is not None]
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            entry = pop(queue)
            rank, at = entry >> 40, entry & 0xFFFFFFFFFF
            follow = after[at]
            if follow < 0 or rank_of((ids[at], ids[follow])) != rank:
                continue  # stale
            made = ids[at] = made_by[rank]
            ids[follow] = -1
            nxt = after[at] = after[follow]
            if nxt >= 0:
                before[nxt] = at
                if (rank := rank_of((made, ids[nxt]))) is not None:
                    push(queue, rank << 40 | at)
            prev = before[at]
            if prev >= 0 and (rank := rank_of((ids[prev], made))) is not None:
                push(queue, rank << 40 | prev)
        out, at = [], 0
        while at >= 0:
            out.append(ids[at])
            at = after[at]
        return out

    def word(self, word: str) -> list[int]:
        found = self._words.get(word)
        if found is None:
            found = self._words_before.get(word)
            if found is None:
                shown, inner = word.encode("utf-8"), self.inner
                ids = [inner[b] for b in shown]
                ids[-1] = self.last[shown[-1]]
                found = self.merge(ids)
            if len(word) <= 64:
                if len(self._words) >= self.cache:
                    self._words, self._words_before = {}, self._words
                self._words[word] = found
        return found

    def _piece(self, text: str) -> list[int]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if _PLAIN.search(text):
            if self._unicode_words is None:
                import regex

                self._unicode_words = regex.compile(self.pattern)
            words = self._unicode_words.findall(text)
        else:
            words = _PLAIN_WORDS.findall(text)
        return [i for w in words for i in self.word(w)]

    def _ids(self, text: str) -> list[int]:
        if self.marks and "<" in text:
            out: list[int] = []
            for part in self.marks.split(text):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += self._piece(part)
            return out
        if text.isascii():  # most chunks are a word, and perhaps a sign after it
            low = text.lower()
            if low.isalpha():
                return self.word(low)
            if low[:-1].isalpha() and not low[-1].isalnum():
                return self.word(low[:-1]) + self.word(low[-1])
        return self._piece(text)

    def chunk(self, text: str) -> tuple[bytes, bytes]:
        """Ids and decoded form of a text without white space."""
        found = self._chunks_before.get(text)
        if found is None:
            ids = self._ids(text)
            found = struct.pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids]).encode()
        if len(text) <= 64:
            if len(self._chunks) >= self.cache:
                self._chunks, self._chunks_before = {}, self._chunks
            self._chunks[text] = found
        return found

    def chunks(self, text: str) -> list[tuple[bytes, bytes]]:
        if _SEPARATORS.search(text):
            return [self.chunk(text)]
        chunk = self.chunk
        return [self._chunks.get(w) or chunk(w) for w in text.split()]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join([c[0] for c in self.chunks(text or "")]), "<u4")

    def decode(self, ids) -> str:
        return " ".join([self.strings[int(i)] for i in ids])


#: White space to str.split, but ordinary characters to the vocabulary's own pattern.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def encode(df: DataFrame, vocab: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` with the ids of each whole text in ``out`` (array of int); a clashing column is replaced."""
    schema = df.drop(out).withColumn(out, F.array(F.lit(0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec.load(vocab)
        for b in batches:
            ids = pa.array([codec.encode(t).astype(np.int32) for t in b.column("__bpe_text").to_pylist()], pa.list_(pa.int32()))
            names = [n for n in b.schema.names if n != "__bpe_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), ids], [*names, out])

    return df.withColumn("__bpe_text", text_of(text)).drop(out).mapInArrow(run, schema)


def decode(df: DataFrame, vocab: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for in ``out``; null ids count as none."""
    schema = df.drop(out).withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec.load(vocab)
        for b in batches:
            texts = pa.array([codec.decode(x or ()) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, out])

    return df.drop(out).mapInArrow(run, schema)


def digests(df: DataFrame, vocab: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: the count of ids, and digests of the ids (little-endian, 32 bits) and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec.load(vocab)
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                chunks = codec.chunks(t.as_py())
                ids = b"".join([c[0] for c in chunks])
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(b" ".join([c[1] for c in chunks])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text_of(text).alias("text")).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
