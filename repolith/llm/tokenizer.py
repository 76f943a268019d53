"""Byte-level BPE with a public vocabulary (problem 6).

A text is cut by the tokenizer's public pattern; every distinct piece is merged
by a segment tree over its byte positions. A leaf holds the rank of the pair that
starts at that position (with the position as tie-break), so the root is the
leftmost pair of lowest rank. A merge replaces two live neighbours by one and
updates three leaves in logarithmic time, which keeps a run of 50,000 equal
bytes at n log n instead of n squared.

Defined results: empty and null texts have an empty list; strings of special
tokens are ordinary text; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.runtime import spread

#: Fixed value: where the public vocabularies lie; every function takes another folder.
TOKENIZER_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces remembered by a worker before it starts afresh (memory bound).
CACHE_PIECES = 200_000
CACHE_PIECE_CHARS = 64

_NONE = 1 << 62


class SegmentTreeBPE:
    """Encoder over ``ranks`` (bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(data)
        ranks = self.ranks
        if n == 1:
            return [ranks[data]]
        get = ranks.get
        shift = n.bit_length()
        mask = (1 << shift) - 1
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            rank = get(data[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << shift | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 1))  # start of the next live part
        before = list(range(-1, n - 1))
        while tree[1] != _NONE:
            at = tree[1] & mask
            gone = after[at]
            follow = after[at] = after[gone]
            if follow < n:
                before[follow] = at
                rank = get(data[at : after[follow]])
                leaf = _NONE if rank is None else rank << shift | at
            else:
                leaf = _NONE
            updates = [(at, leaf), (gone, _NONE)]
            left = before[at]
            if left >= 0:
                rank = get(data[left:follow])
                updates.append((left, _NONE if rank is None else rank << shift | left))
            for position, value in updates:
                i = size + position
                tree[i] = value
                i >>= 1
                while i:
                    a, b = tree[2 * i], tree[2 * i + 1]
                    value = a if a < b else b
                    if tree[i] == value:
                        break
                    tree[i] = value
                    i >>= 1
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[data[i:j]])
            i = j
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8"))
                if len(piece) <= CACHE_PIECE_CHARS:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


def load_ranks(folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary file as bytes -> id; its size is fixed (about 50,000 rows)."""
    with open(f"{folder}/{vocabulary}", "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _from_packed(packed: bytes) -> SegmentTreeBPE:
    return SegmentTreeBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, packed.splitlines())})


def _packed(spark, folder: str, vocabulary: str):
    with open(f"{folder}/{vocabulary}", "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # fixed size, under 1 MB


def token_ids(documents: DataFrame, *, folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every row of ``documents`` (doc_id, text)."""
    packed = _packed(documents.sparkSession, folder, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _from_packed(packed.value)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start in range(0, len(texts), 500):
                lists = [np.asarray(encoder.encode(t), dtype=np.int32) for t in texts[start : start + 500]]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(start, 500), ids], names=["doc_id", "ids"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows, "doc_id").mapInArrow(encode, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, *, folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens; the ids themselves never leave the worker."""
    packed = _packed(documents.sparkSession, folder, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _from_packed(packed.value)
        for batch in batches:
            sizes = [len(encoder.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows, "doc_id").mapInArrow(count, "doc_id bigint, n_tokens bigint")
