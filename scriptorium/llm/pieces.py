"""Splitting oversized items at natural boundaries (problem 4).

Method: content-defined chunking. A rolling hash over the content sets landmarks; a piece ends at the natural boundary
nearest to a landmark within the minimum and maximum size, so that an edit moves only the cuts near it. In texts the
boundaries are, in order of preference, paragraph ends, sentence ends, line ends and blanks; in lists of vectors they
are places where neighbouring vectors differ most. The next piece begins ``overlap`` before the last one's end.

Results for special inputs: items within the limit are one piece; null and empty items have none; an item without any
boundary is cut at the limit; repeated rows of a key count once. An overlap must be less than half the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters under the text's rolling hash, and landmarks per piece of the greatest size, about.
WINDOW, LANDMARKS = 32, 6
PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
SENTENCE = re.compile(r"[.!?…;:。！？।॥][.!?…\"'»«“”„’‘)\]）」』]*(?:\s+|(?<=[。！？।॥」』]))")
BLANK = re.compile(r"\s+")


def _rolling(codes: np.ndarray, window: int) -> np.ndarray:
    """Hash of the ``window`` values that end at each place."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(min(window, len(codes))):
        h[k:] = h[k:] * np.uint64(1) + codes[: len(codes) - k] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def cut_points(n: int, landmarks: list[int], tiers: list[list[int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of an item of ``n`` elements. ``tiers``: boundaries by preference, each ascending."""
    out, start, least = [], 0, max(overlap + 1, limit // 3)
    while n - start > limit:
        low, high = start + least, start + limit
        end = 0
        for tier in tiers:
            a, b = bisect_left(tier, low), bisect_right(tier, high)
            if a == b:
                continue
            i = bisect_left(landmarks, low)
            if i < len(landmarks) and landmarks[i] <= high:
                at = bisect_left(tier, landmarks[i], a, b)
                near = [tier[j] for j in (at - 1, at) if a <= j < b]
                end = min(near, key=lambda x: (abs(x - landmarks[i]), x))
            else:
                end = tier[b - 1]
            break
        end = end or high
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def text_pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    spacing = np.uint64(max(1, limit // LANDMARKS))
    landmarks = (np.flatnonzero(_rolling(codes, WINDOW) % spacing == 0) + 1).tolist()
    tiers = [[m.end() for m in p.finditer(text)] for p in (PARAGRAPH, SENTENCE)]
    tiers.append([m.end() for m in re.finditer("\n", text)])
    tiers.append([m.end() for m in BLANK.finditer(text)])
    return cut_points(len(text), landmarks, tiers, limit, overlap)


def vector_pieces(vectors: list, limit: int, overlap: int) -> list[tuple[int, int]]:
    n = len(vectors)
    if n <= limit:
        return [(0, n)] if n else []
    width = max((len(v) for v in vectors if v is not None), default=0)
    m = np.zeros((n, width))
    for i, v in enumerate(vectors):
        if v is not None:
            m[i, : len(v)] = [0.0 if x is None else x for x in v]
    m = np.nan_to_num(m)
    marks = np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in m.astype(np.float32)], np.uint64)
    landmarks = (np.flatnonzero(_rolling(marks, 2) % np.uint64(max(1, limit // LANDMARKS)) == 0) + 1).tolist()
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    alike = (unit[1:] * unit[:-1]).sum(axis=1)
    turns = [i + 1 for i in range(len(alike)) if alike[i] <= min(alike[max(0, i - 1) : i + 2])]
    return cut_points(n, landmarks, [turns], limit, overlap)


def limits_of(size_limits: DataFrame, src_table: str) -> tuple[int, int]:
    """(limit, overlap) of a source table; the table has a row per source table."""
    r = size_limits.where(F.col("src_table") == src_table).select("max_size", "overlap_size").distinct().limit(2).collect()
    if len(r) != 1:
        raise ValueError(f"size_limits has {len(r)} rows for {src_table}")
    limit, overlap = int(r[0][0]), int(r[0][1] or 0)
    if limit < 2 or not 0 <= overlap < limit / 2:
        raise ValueError(f"no such limits: {limit}, {overlap}")
    return limit, overlap


def piece_spans(items: DataFrame, key: str, content: str, src_table: str, limit: int, overlap: int) -> DataFrame:
    """(src_table, item_key, piece_no, piece_start, piece_end) of all items; positions count characters or vectors from
    0. Only items beyond the limit leave the JVM; the rest are one piece."""
    is_text = dict(items.dtypes)[content] == "string"
    size = F.char_length(content) if is_text else F.size(content)
    base = items.select(F.col(key).cast("bigint").alias("item_key"), F.col(content).alias("c"), size.alias("n")).where("n > 0")
    cut = text_pieces if is_text else vector_pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), batch.column(1)
            out = []
            for i, k in enumerate(keys):
                out += [(k, p, a, b) for p, (a, b) in enumerate(cut(rows[i].as_py(), limit, overlap))]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["item_key", "piece_no", "piece_start", "piece_end"])

    large = base.where(F.col("n") > limit).select("item_key", "c").mapInArrow(run, "item_key bigint, piece_no int, piece_start int, piece_end int")
    small = base.where(F.col("n") <= limit).select("item_key", F.lit(0).alias("piece_no"), F.lit(0).alias("piece_start"), F.col("n").alias("piece_end"))
    return large.unionByName(small).distinct().select(F.lit(src_table).alias("src_table"), "item_key", "piece_no", "piece_start", "piece_end")


def oversized(spans: DataFrame) -> DataFrame:
    """(src_table, item_key) of the items that were cut."""
    return spans.where("piece_no = 1").select("src_table", "item_key").distinct()


def with_content(spans: DataFrame, items: DataFrame, key: str, content: str) -> DataFrame:
    """Spans and the piece itself. Rows of a key are taken to have one content."""
    of = items.select(F.col(key).cast("bigint").alias("item_key"), F.col(content).alias("c")).where("c is not null").dropDuplicates(["item_key"])
    joined = spans.join(of, "item_key")
    is_text = dict(of.dtypes)["c"] == "string"
    length = F.col("piece_end") - F.col("piece_start")
    piece = F.substring("c", F.col("piece_start") + 1, length) if is_text else F.slice("c", F.col("piece_start") + 1, length)
    return joined.select("src_table", "item_key", "piece_no", "piece_start", "piece_end", piece.alias("piece"))
