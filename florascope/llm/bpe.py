"""Byte-pair encoding of whole texts by the ranks of a public vocabulary.

Each piece of a text (by the vocabulary's splitting pattern) is merged with a segment tree over its byte positions. A leaf holds
the rank of the pair that begins there, an inner node the leftmost smallest one of its half; a merge is a few point updates
(the merged position, its left neighbour and the position that vanished), each logarithmic, on neighbours kept as a linked list.
A piece of n bytes, even one word of a megabyte, takes O(n log n). Pieces met before in a task are looked up.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Fixed value: the splitting pattern published with the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 60
#: Pieces a task remembers, and the longest one worth it (characters).
MEMORY, LONGEST = 400_000, 64


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << max(0, n - 2).bit_length()
    # tree[k]: smallest rank of the node's positions times n plus its leftmost position, so that one comparison does both.
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        if tree[k] == value:
            return
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    def pair(i: int) -> int:
        j = after[i]
        if j >= n:
            return NONE
        r = ranks.get(parts[i] + parts[j])
        return NONE if r is None else r * n + i

    while tree[1] < NONE:
        i = tree[1] % n
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        if j < n - 1:
            put(j, NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty ones give none."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = merge_piece(piece.encode("utf-8"), self.ranks)
                if len(piece) <= LONGEST:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a public vocabulary: folder, else $TOKENIZERS_DIR, else /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id_col, ids array<int>), one row for each row of df, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty list, blank ones their ids;
    repeated rows are repeated; an empty table gives none; other columns aren't read. path has to exist on every executor.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = pa.array([encoder.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
