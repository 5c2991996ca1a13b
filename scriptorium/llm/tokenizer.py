"""Encoding with a public byte-level BPE vocabulary (problem 8).

Texts are cut by the vocabulary's own pattern. A piece is merged with a queue over merge ranks: each rank that
occurs has a bucket of positions, three levels of 64-way bitmaps mark the filled buckets, find-first-set yields the
lowest rank, and the pieces' bytes form a linked list, so that a merge costs a constant number of steps whatever
the piece's length. Entries whose pair has meanwhile changed are skipped when they are met.

Results for special inputs: null and empty texts give an empty list; strings of special tokens are ordinary text;
each input row gives one output row, repeated rows included.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern of the vocabularies byte_bpe_50k and byte_bpe_multi_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces up to this many characters are remembered by a worker, so many at most; longer ones are merged each time.
REMEMBERED_LENGTH, REMEMBERED = 40, 400_000


def _odd_characters() -> str:
    """A class of the characters on which ``re`` and the pattern's properties disagree: numerals that are no decimal
    digits, separators that only Python counts as space, unassigned ones and all beyond the basic plane."""
    odd = []
    for c in map(chr, range(0x80, 0x10000)):
        kind = unicodedata.category(c)
        if kind in ("Nl", "No", "Cn") or (kind[0] == "N") != c.isdecimal() or (kind[0] == "L") != c.isalpha():
            odd.append(ord(c))
    spans, start = [], None
    for a, b in zip(odd, [*odd[1:], -1]):
        start = a if start is None else start
        if b != a + 1:
            spans.append(f"\\U{start:08x}-\\U{a:08x}")
            start = None
    return "[\x1c-\x1f" + "".join(spans) + "\U00010000-\U0010ffff]"


class Encoder:
    """Encodes texts by a file of ranks (a line holds a token in base 64 and its id)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.words = max(self.ranks.values()) // 64 + 1
        self.slow = regex.compile(PATTERN)
        letter, digit = r"[^\W\d_]", r"\d"
        self.fast = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self.odd = re.compile(_odd_characters())
        self.known = _Known(self)

    def rank(self, a: int, b: int) -> int:
        """The rank at which two neighbouring tokens merge, -1 if they never do."""
        key = (a, b)
        found = self.pair_rank.get(key)
        if found is None:
            found = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
            if len(self.pair_rank) < 2_000_000:
                self.pair_rank[key] = found
        return found

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. A rank's pairs are merged from left to right; a merged token's own pairs have higher
        ranks than the merge that made it, so that a bucket is complete when its turn comes."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        single, rank = self.single, self.rank
        token = [single[b] for b in piece]
        n = len(token)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        low = [0] * self.words
        mid = [0] * (self.words // 64 + 1)
        top = 0

        def push(r: int, at: int) -> None:
            nonlocal top
            bucket = buckets.get(r)
            if bucket is None:
                buckets[r] = [at]
                w = r >> 6
                low[w] |= 1 << (r & 63)
                m = w >> 6
                mid[m] |= 1 << (w & 63)
                top |= 1 << m
            else:
                bucket.append(at)

        for i in range(n - 1):
            r = rank(token[i], token[i + 1])
            if r >= 0:
                push(r, i)
        while top:
            m = (top & -top).bit_length() - 1
            w = (m << 6) + (mid[m] & -mid[m]).bit_length() - 1
            r = (w << 6) + (low[w] & -low[w]).bit_length() - 1
            low[w] &= low[w] - 1
            if not low[w]:
                mid[m] &= ~(1 << (w & 63))
                if not mid[m]:
                    top &= ~(1 << m)
            bucket = buckets.pop(r)
            bucket.sort()
            for i in bucket:
                if token[i] < 0:
                    continue
                j = after[i]
                if j >= n or rank(token[i], token[j]) != r:
                    continue
                token[i], token[j] = r, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    x = rank(r, token[k])
                    if x >= 0:
                        push(x, i)
                h = before[i]
                if h >= 0:
                    x = rank(token[h], r)
                    if x >= 0:
                        push(x, h)
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        pieces = (self.slow if self.odd.search(text) else self.fast).findall(text)
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, pieces)), np.int32)


class _Known(dict):
    """Ids by piece."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encoder.merge(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_column(df: DataFrame, text: str, keep: list[str], path: str, out: str = "ids") -> DataFrame:
    """``keep`` columns of ``df`` and the ids of column ``text`` by the vocabulary file at ``path``, which every
    executor must be able to read. One pass without shuffle; only the named columns are read."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    names = [f"k{i}" for i in range(len(keep))]
    inner = df.select(*(F.col(c).alias(k) for c, k in zip(keep, names)), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            texts = batch.column(len(names))
            for at in range(0, batch.num_rows, 1000):
                rows = [encoder.encode(t) for t in texts.slice(at, 1000).to_pylist()]
                ends = np.cumsum([0, *map(len, rows)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows), pa.int32()))
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), ids], names=[*keep, out])

    return inner.mapInArrow(run, schema)
