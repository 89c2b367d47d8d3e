"""Problem 8: token ids of a whole corpus by a public byte-level BPE vocabulary.

Content-defined chunk reuse. Over the UTF-8 bytes of a batch a hash rolls with a window
of eight bytes; where its top bits are 0 a chunk ends (at the next character), so equal
stretches of different documents give equal chunks wherever they stand. A chunk met before
isn't encoded again: each Python worker remembers chunks up to ``MEMORY`` characters, over all
its batches and tasks. The memory is per worker: sharing chunks among all executors
would move the corpus twice through a shuffle, which costs more than encoding it.

Repair: one blank between two other characters always begins a new pre-token of the
vocabulary's pattern, whatever stands around. The part of a chunk between its first and
its last such blank (the body) therefore has the same ids in any context. What lies between the
bodies of two chunks, over the join, is encoded again as one string, so the result agrees
exactly with the encoding of the whole text.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k"
CHUNK_BITS = 9  # a chunk of 512 bytes on the average
MEMORY = 24_000_000

#: The pattern of the vocabulary's pre-tokens (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_FIRST = re.compile(r"(?<=\S) (?=\S)")
_LAST = re.compile(r"(?s:.*)(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The vocabulary's encoder; text that looks like a special token is ordinary text."""
    import tiktoken

    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Memory:
    """Bodies of chunks by chunk, in two generations; the older one goes when the younger is full."""

    def __init__(self, most: int = MEMORY):
        self.most, self.used, self.young, self.old = most // 2, 0, {}, {}
        self.made = self.reused = 0

    def get(self, chunk: str):
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                return None
            self.put(chunk, found)
        self.reused += 1
        return found

    def put(self, chunk: str, value) -> None:
        if self.used > self.most:
            self.old, self.young, self.used = self.young, {}, 0
        self.young[chunk] = value
        self.used += len(chunk) + 64


@functools.lru_cache(maxsize=4)
def _memory(folder: str, vocabulary: str) -> Memory:
    return Memory()


def chunk_ends(data: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Positions in the bytes where a chunk ends, none inside a character."""
    if len(data) < 16:
        return np.empty(0, np.int64)
    windows = np.ndarray((len(data) - 8,), "<u8", data.data if isinstance(data, np.ndarray) else data, strides=(1,))
    mixed = windows * np.uint64(0x9E3779B97F4A7C15)
    ends = np.flatnonzero(mixed >> np.uint64(64 - bits) == 0) + 8
    return ends[(data[ends] & 0xC0) != 0x80]


def chunks(text: str, bits: int = CHUNK_BITS) -> list[str]:
    raw = text.encode()
    ends = chunk_ends(np.frombuffer(raw, np.uint8), bits)
    at = [0, *ends.tolist(), len(raw)]
    if len(raw) == len(text):
        return [text[a:b] for a, b in zip(at, at[1:]) if b > a]
    return [raw[a:b].decode() for a, b in zip(at, at[1:]) if b > a]


def encode(text: str | None, enc, memory: Memory, bits: int = CHUNK_BITS) -> list[int]:
    """The ids of ``text``; null and empty give none."""
    if not text:
        return []
    out: list[int] = []
    loose = ""  # since the last body
    for chunk in chunks(text, bits):
        known = memory.get(chunk)
        if known is None:
            first = _FIRST.search(chunk)
            if first:
                a, b = first.start(), _LAST.match(chunk).end() - 1
                known = (chunk[:a], enc.encode_ordinary(chunk[a:b]) if b > a else [], chunk[b:])
            else:
                known = (chunk, None, "")
            memory.made += 1
            memory.put(chunk, known)
        head, body, tail = known
        loose += head
        if body is not None:
            if loose:
                out += enc.encode_ordinary(loose)
            out += body
            loose = tail
    if loose:
        out += enc.encode_ordinary(loose)
    return out


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY, count: bool = False, carry: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(``key``, ``carry``, ``ids``) of every row, or with ``count`` (``key``, ``carry``, ``n_tokens``).

    Null and empty texts have an empty list. Other columns aren't read. No shuffle.
    """
    def run(batches):
        enc, memory = encoder(folder, vocabulary), _memory(folder, vocabulary)
        for batch in batches:
            ids = [encode(t, enc, memory) for t in batch.column(text).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            if count:
                column = pa.array(sizes.astype(np.int64))
            else:
                flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if len(ids) else np.empty(0, np.int32)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), column], [*kept, "n_tokens" if count else "ids"])

    kept = [key, *carry]
    result = "".join(f"`{c}` {documents.schema[c].dataType.simpleString()}, " for c in kept) + ("n_tokens long" if count else "ids array<int>")
    return documents.select(*kept, text).mapInArrow(run, result)
