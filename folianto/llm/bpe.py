"""Encoding of a corpus with a public byte-level BPE vocabulary.

Each pretoken is merged over a segment tree on its byte positions: the root holds the lowest rank of a pair of live
neighbours, the leftmost on ties, and a merge updates two or three leaves in logarithmic time. Pretokens seen before
come from a bounded memo in the worker.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Place of the vocabulary (``token rank`` lines, tokens in base64); a parameter of every function below.
VOCABULARY = os.environ.get("FOLIANTO_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Most pretokens in a worker's memo; it is emptied beyond.
MEMO = 200_000

#: A vocabulary larger than this isn't sent to the executors.
MOST_BYTES = 64 << 20


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pretoken."""
    n = len(piece)
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if n == 1:
        return [ranks[piece]]
    none = 1 << 62
    size = 1 << (n - 1).bit_length()
    tree = [none] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            value = a if a < b else b
            if tree[i] == value:
                return
            tree[i] = value

    def pair(i: int) -> int:
        j = after[i]
        return none if j >= n or (r := get(piece[i : after[j]])) is None else r << 32 | i

    while (top := tree[1]) != none:
        i = top & 0xFFFFFFFF
        j = after[i]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        put(j, none)
        put(i, pair(i))
        if (p := before[i]) >= 0:
            put(p, pair(p))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Text to ids without special tokens; null and empty text give an empty list."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memo: int = MEMO):
        import regex

        self.ranks, self.split, self.most, self.memo = ranks, regex.compile(pattern).findall, memo, {}

    def into(self, text: str | None, ids: array) -> None:
        """Append the ids of ``text`` to ``ids``."""
        if not text:
            return
        memo, extend = self.memo, ids.extend
        for word in self.split(text):
            try:
                extend(memo[word])
            except KeyError:
                found = array("i", merge(word.encode("utf-8", "replace"), self.ranks))
                if len(word) <= 64:
                    if len(memo) >= self.most:
                        memo.clear()
                    memo[word] = found
                extend(found)

    def __call__(self, text: str | None) -> list[int]:
        ids = array("i")
        self.into(text, ids)
        return ids.tolist()


_encoders: dict[int, Encoder] = {}


def worker_encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    key = hash((len(data), data[:64], data[-64:], pattern))
    if key not in _encoders:
        _encoders[key] = Encoder(load_ranks(data), pattern)
    return _encoders[key]


def _vocabulary(df: DataFrame, path: str):
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path}: vocabulary above {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(key, ids ARRAY<INT>)`` for every row of ``df``, one narrow pass without a shuffle.

    Null and empty text give an empty list. Repeated rows give repeated rows; other columns of ``df`` are not read.
    The vocabulary file (its size is checked) is read on the driver and broadcast, so executors need no copy of it.
    """
    vocabulary = _vocabulary(df, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary.value, pattern)
        for batch in batches:
            ids, ends = array("i"), [0]
            for t in batch.column(1):
                encoder.into(t.as_py(), ids)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(key, n_tokens INT)``: the lengths of the lists of ``encode``, without sending the lists."""
    vocabulary = _vocabulary(df, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary.value, pattern)
        for batch in batches:
            sizes = []
            for t in batch.column(1):
                ids = array("i")
                encoder.into(t.as_py(), ids)
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")
