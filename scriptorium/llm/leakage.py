"""Evaluation texts leaking into training text (problem 9).

Method: the test items form a BM25 inverted index; every passage of every document is a query against it. Block-max WAND
retrieves all items whose score reaches a share of the item's own score, and each is verified: the longest common
subsequence of words between the item and a window of the document must hold at least half of the item's words.

Terms are pairs of words that stand at most REACH words apart in order. Where half of an item's words are left in order,
many are left at that distance even if every second one is exchanged, whereas single words, most of which any text of the
language holds, retrieve nearly every item. Statistics cover all items. The index is built once and sent to the
executors in blocks of at most BLOCK_ITEMS items, one pass over the documents per block; as statistics and windows are those of all
items, the blocks don't change the result.

Results for special inputs: null and empty texts and items match nothing; an item of one word matches where the word
stands; a document and item are reported once, however often they match or their rows repeat.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ITEMS = 20_000
REACH = 2
#: Share of an item's own BM25 score that a passage must reach, and share of the item's words that must be found.
RETRIEVE, HELD = 0.19, 0.5
#: Buckets, by hash, in which the items that hold a pair are counted: their number doesn't grow with the items.
DF_BUCKETS = 1 << 22
#: A window of the document is so many times as long as the item, and so many words more.
STRETCH, SLACK = 1.5, 12
K1, B = 1.2, 0.75
#: Items whose greatest impacts are kept as one.
BLOCK = 8

WORD = re.compile(r"[^\W_]+")
SCRIPT = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
SCRIPT_WORD = re.compile(r"[฀-๿぀-ヿ㐀-鿿]|[^\W_฀-๿぀-ヿ㐀-鿿]+")
BROKEN = re.compile(r"[-­¬‐⸗=][^\S\n]*\n\s*(?=[^\W\d_])|­")
MAY_BREAK = re.compile(r"[-­¬‐⸗=] *\n|­")
_SPELT = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "œ": "oe", "ſ": "s"})


def words(text: str) -> list[str]:
    """Words as they stand, words broken at line ends joined; scripts without blanks by character."""
    if MAY_BREAK.search(text):
        text = BROKEN.sub("", text)
    return (SCRIPT_WORD if SCRIPT.search(text) else WORD).findall(text)


def spelling(word: str) -> str:
    """A word without case, with umlauts written out and without accents."""
    w = unicodedata.normalize("NFC", word).casefold().translate(_SPELT)
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


def within_one(a: str, b: str) -> bool:
    """Whether two words differ by one inserted, lost or exchanged character, or two swapped ones."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x == y[1:] or x[1:] == y or (x[:2] == y[1::-1] and x[2:] == y[2:])


class _Codes(dict):
    """Number in the items' vocabulary by word as it stands."""

    def __init__(self, vocabulary: dict[str, int], other: int):
        self.vocabulary, self.other = vocabulary, other

    def __missing__(self, word: str) -> int:
        code = self.vocabulary.get(spelling(word), self.other)
        if len(self) < 1_000_000:
            self[word] = code
        return code


def _pairs(ws: list[str]) -> list[tuple[str, str]]:
    """Words at most REACH apart, in order; of a single word, the word and nothing."""
    return [(ws[i], ws[i + d]) for d in range(1, REACH + 1) for i in range(len(ws) - d)] if len(ws) > 1 else [(w, "") for w in ws]


def _bucket(pair: tuple[str, str]) -> int:
    return xxhash.xxh64_intdigest("\0".join(pair)) % DF_BUCKETS


class ItemStats:
    """What scores and windows depend on, over all items: their number, mean and greatest length, and the number of items
    that hold a pair, counted in hash buckets."""

    def __init__(self):
        self.n = self.words = self.longest = 0
        self.df = np.zeros(DF_BUCKETS, np.int32)

    def add(self, texts: Iterable[str]) -> "ItemStats":
        for t in texts:
            ws = [spelling(w) for w in words(t or "")]
            self.n, self.words, self.longest = self.n + 1, self.words + len(ws), max(self.longest, len(ws))
            for b in {_bucket(p) for p in set(_pairs(ws))}:
                self.df[b] += 1
        return self


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of several ranges, one after another."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


class ItemIndex:
    """BM25 index of items. A term's postings are ordered by item; with them goes the greatest impact in each block of
    items. Impacts are shares of the item's own score."""

    def __init__(self, items: list[tuple[int, str]], stats: ItemStats | None = None):
        stats = stats or ItemStats().add(t for _, t in items)
        self.ids = [i for i, _ in items]
        self.item_words = [[spelling(w) for w in words(t or "")] for _, t in items]
        self.vocabulary: dict[str, int] = {}
        for ws in self.item_words:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        v = self.base = len(self.vocabulary) + 1
        mean, rows = stats.words / max(1, stats.n), []
        for i, ws in enumerate(self.item_words):
            norm = K1 * (1 - B + B * len(ws) / max(mean, 1e-9))
            score = {}
            for p, n in Counter(_pairs(ws)).items():
                df = min(int(stats.df[_bucket(p)]), stats.n)
                score[self.vocabulary[p[0]] * v + self.vocabulary.get(p[1], v - 1)] = math.log(1 + (stats.n - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / (n + norm)
            own = sum(score.values()) or 1.0
            rows += [(g, i, s / own) for g, s in score.items()]
        rows.sort()
        keys, self.item, self.impact = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        self.terms, self.start = np.unique(keys, return_index=True)
        self.size = np.diff(np.append(self.start, len(keys)))
        self._blocks()
        self.blocks = len(items) // BLOCK + 1
        order = np.lexsort((np.repeat(np.arange(len(self.terms)), self.size), self.item))
        self.own_terms, self.own_impact = np.repeat(np.arange(len(self.terms)), self.size)[order], self.impact[order]
        self.own_start = np.searchsorted(self.item[order], np.arange(len(items) + 1))
        self.single = np.zeros(v, bool)
        self.single[[self.vocabulary[ws[0]] for ws in self.item_words if len(ws) == 1]] = True
        self.longest = stats.longest
        self.code_of = _Codes(self.vocabulary, self.base - 1)
        self.places = [{} for _ in items]
        for own, ws in zip(self.places, self.item_words):
            for j, w in enumerate(ws):
                own[self.vocabulary[w]] = own.get(self.vocabulary[w], 0) | 1 << j
        self._alike: dict[str, tuple[int, ...]] = {}
        self._shorter: dict[str, list[str]] = {}

    def alike(self, word: str) -> tuple[int, ...]:
        """Numbers of the items' words that a word may stand for: those of its spelling and, of words longer than three, those
        that differ by one character. Such words share a form that lacks one character at most of each, but for two
        exchanged ones, of which each lacks a different one."""
        out = self._alike.get(word)
        if out is None:
            if not self._shorter:
                for w in self.vocabulary:
                    if len(w) > 3:
                        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                            self._shorter.setdefault(x, []).append(w)
            s = spelling(word)
            near = {s} if s in self.vocabulary else set()
            if len(s) > 3:
                for x in {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}:
                    near.update(w for w in self._shorter.get(x, ()) if w not in near and within_one(w, s))
            out = tuple(self.vocabulary[w] for w in near)
            if len(self._alike) < 1_000_000:
                self._alike[word] = out
        return out

    def _blocks(self) -> None:
        """By term and block of items: the block, the greatest impact, where its postings begin and how many they are."""
        of = np.repeat(np.arange(len(self.terms)), self.size)
        new = (of[1:] != of[:-1]) | (self.item[1:] // BLOCK != self.item[:-1] // BLOCK)
        self.entry = np.flatnonzero(np.append(np.ones(min(1, len(of)), bool), new))
        self.entry_size = np.diff(np.append(self.entry, len(of)))
        self.entry_block = self.item[self.entry] // BLOCK
        self.entry_most = np.maximum.reduceat(self.impact, self.entry) if len(of) else np.empty(0)
        self.first_entry = np.searchsorted(of[self.entry], np.arange(len(self.terms)))
        self.entries = np.diff(np.append(self.first_entry, len(self.entry)))

    def retrieve(self, terms: np.ndarray, least: float) -> list[int]:
        """Items whose summed impact over ``terms`` is at least ``least``, by block-max WAND in bulk: a block is passed over unless
        its terms' greatest impacts add up to ``least``; the postings of the other blocks are scored."""
        terms = np.asarray(terms, np.int64)
        at = _ranges(self.first_entry[terms], self.entries[terms])
        bound = np.bincount(self.entry_block[at], self.entry_most[at], self.blocks)
        at = at[bound[self.entry_block[at]] >= least - 1e-12]
        if not len(at):
            return []
        p = _ranges(self.entry[at], self.entry_size[at])
        items, where = np.unique(self.item[p], return_inverse=True)
        return items[np.bincount(where, self.impact[p]) >= least - 1e-12].tolist()

    def _near(self, item: int, at: np.ndarray, terms: np.ndarray, least: float) -> tuple[int, int] | None:
        """(from, to) of the words in which windows of the item's width reach ``least``, given hits (place, term)."""
        own = self.own_terms[self.own_start[item] : self.own_start[item + 1]]
        k = np.searchsorted(own, terms)
        hit = np.flatnonzero(own[np.minimum(k, len(own) - 1)] == terms)
        places, width = at[hit], self._width(item)
        sums = np.concatenate([[0.0], np.cumsum(self.own_impact[self.own_start[item] + k[hit]])])
        good = np.flatnonzero(sums[np.searchsorted(places, places + width)] - sums[:-1] >= least - 1e-12)
        return (int(places[good[0]]) - width, int(places[good[-1]]) + 2 * width) if len(good) else None

    def _width(self, item: int) -> int:
        return math.ceil(len(self.item_words[item]) * STRETCH) + SLACK

    def held(self, item: int, doc: list[str], least: float = 0.0) -> float:
        """The greatest share of the item's words, if it reaches ``least``, that a window of ``doc`` holds in order. Words may differ in spelling
        by one character if they are longer than three."""
        n, places, width = len(self.item_words[item]), self.places[item], self._width(item)
        coded = []
        for w in doc:
            m = 0
            for c in self.alike(w):
                m |= places.get(c, 0)
            coded.append(m)
        full, most = (1 << n) - 1, 0
        for at in range(0, max(1, len(coded) - width + max(1, n // 4)), max(1, n // 4)):
            window, held = [m for m in coded[at : at + width] if m], 0
            for m in window:
                held |= m
            if min(held.bit_count(), len(window)) < max(most + 1, least * n):
                continue  # it can't hold enough
            v = full
            for m in window:
                u = v & m
                v = ((v + u) | (v - u)) & full
            most = max(most, n - v.bit_count())
        return most / max(1, n)

    def matches(self, text: str, least: float = RETRIEVE, held: float = HELD) -> list[tuple[int, float]]:
        """(item id, share of its words held) for a whole document, passage by passage."""
        ws = words(text)
        v, n = self.base, len(ws)
        codes = np.fromiter(map(self.code_of.__getitem__, ws), np.int64, n)
        known = codes < v - 1
        keys, places = [], []
        for d in range(1, min(REACH, n - 1) + 1):
            p = np.flatnonzero(known[:-d] & known[d:])
            keys.append(codes[p] * v + codes[p + d])
            places.append(p)
        p = np.flatnonzero(self.single[codes])
        keys, places = np.concatenate([*keys, codes[p] * v + v - 1]), np.concatenate([*places, p])
        if not len(self.terms) or not len(keys):
            return []
        k = np.minimum(np.searchsorted(self.terms, keys), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[k] == keys)
        hit = hit[np.argsort(places[hit], kind="stable")]
        at, terms = places[hit], k[hit]
        span = math.ceil(self.longest * STRETCH) + SLACK
        found: dict[int, float] = {}
        for start in range(0, max(1, n - span), span):
            a, b = np.searchsorted(at, [start, start + 2 * span])
            if a == b:
                continue
            for item in self.retrieve(np.unique(terms[a:b]), least):
                near = self._near(item, at[a:b], terms[a:b], least)
                if near and (share := self.held(item, ws[max(0, near[0]) : near[1]], held)) >= held:
                    found[item] = max(found.get(item, 0.0), share)
        return [(self.ids[i], s) for i, s in sorted(found.items())]


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, held) of every document that holds at least half of an item's words in order and close together."""
    rows = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    blocks = max(1, -(-rows.count() // BLOCK_ITEMS))
    part = lambda b: [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i", "t").collect()]
    stats, first = ItemStats(), part(0)
    for b in range(blocks):
        stats.add(t for _, t in (part(b) if b else first))
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null and k is not null")
    kind = dict(docs.dtypes)["k"]
    out = None
    for b in range(blocks):
        shared = documents.sparkSession.sparkContext.broadcast(ItemIndex(part(b) if b else first, stats))
        found = docs.mapInArrow(_finder(shared, key), f"`{key}` {kind}, item_id bigint, held double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy(key, "item_id").agg(F.max("held").alias("held"))


def _finder(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value  # built on the driver; a worker reads it once
        for batch in batches:
            keys, docs = batch.column(0), batch.column(1)
            where, ids, shares = [], [], []
            for n, t in enumerate(docs.to_pylist()):
                for i, s in index.matches(t):
                    where.append(n)
                    ids.append(i)
                    shares.append(s)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(where, pa.int64())), pa.array(ids, pa.int64()), pa.array(shares, pa.float64())], names=[key, "item_id", "held"])

    return run
