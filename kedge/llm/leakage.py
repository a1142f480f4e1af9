"""Evaluation passages inside a corpus, by greedy string tiling.

The items' word n-grams are hashed (Karp-Rabin) once; each document's rolling hashes meet them, which
gives the seeds. Seeds on one diagonal join into matches; the longest match that overlaps no marked
words is marked again and again, what is left of overlapped ones counts anew if long enough. The
marked tiles cover a share of the item, in whatever order its passages stand.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kedge.session import cut, spread

#: Words in a row that make a case.
MIN_WORDS = 12
#: Share of an item's words under tiles from which it counts as leaked as a whole.
COVERAGE = 0.5
#: Characters of items that one pass over the corpus carries; more items mean more passes.
BLOCK_CHARS = 8 << 20

WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of each window of ``k`` numbers, modulo 2**64."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    n = len(ids) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + ids[j : j + n]
    return h


class Items:
    """One block of items, ready to meet documents."""

    def __init__(self, rows: list[tuple[int, str]], k: int) -> None:
        self.k, self.codes, self.item_ids, self.words = k, {}, [], []
        hashes, which, at = [], [], []
        for item_id, text in rows:
            ids = np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in words_of(text)], np.uint64)
            h = rolling(ids, k)
            hashes.append(h)
            which.append(np.full(len(h), len(self.item_ids), np.int64))
            at.append(np.arange(len(h), dtype=np.int64))
            self.item_ids.append(item_id)
            self.words.append(ids)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.which = np.concatenate(which)[order] if which else np.empty(0, np.int64)
        self.at = np.concatenate(at)[order] if at else np.empty(0, np.int64)

    def seeds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in the document, item, position in the item) of equal windows."""
        none = np.empty(0, np.int64)
        if len(ids) < self.k or not len(self.h):
            return none, none, none
        known = np.cumsum(np.concatenate(([0], ids > 0)))
        can = np.flatnonzero(known[self.k :] - known[: -self.k] == self.k)
        if not len(can):
            return none, none, none
        h = rolling(ids, self.k)[can]
        lo, hi = np.searchsorted(self.h, h), np.searchsorted(self.h, h, "right")
        n = hi - lo
        pos = np.repeat(can, n)
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return pos, self.which[flat], self.at[flat]


def tiles(doc: np.ndarray, item: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seeds: (position in doc, position in item, words), longest first."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.concatenate(([True], (np.diff(i) != 1) | (np.diff(i - j) != 0)))
    start = np.flatnonzero(new)
    length = np.diff(np.concatenate((start, [len(i)]))) + k - 1
    heap = []
    for n, a, b in zip(length.tolist(), i[start].tolist(), j[start].tolist(), strict=True):
        # equal hashes may belong to unequal words: what lies between two such words counts by itself
        same = doc[a : a + n] == item[b : b + n]
        edge = np.diff(np.concatenate(([0], same, [0])).astype(np.int8))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if e - s >= k:
                heap.append((s - e, b + s, a + s))
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    while heap:
        n, b, a = heapq.heappop(heap)
        n = -n
        taken = in_doc[a : a + n] | in_item[b : b + n]
        if not taken.any():
            in_doc[a : a + n] = in_item[b : b + n] = True
            out.append((a, b, n))
            continue
        edge = np.diff(np.concatenate(([1], taken, [1])).astype(np.int8))
        for s, e in zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True):
            if e - s >= k:
                heapq.heappush(heap, (s - e, b + s, a + s))
    return out


SCHEMA = "item_id long, n_tiles int, longest int, tiled_words int, item_words int"


def _matcher(rows: Broadcast, k: int, key: str):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows.value, k)
        code = items.codes.get
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                ids = np.array([code(w, 0) for w in words_of(text)], np.uint64)
                pos, which, at = items.seeds(ids)
                for w in np.unique(which).tolist():
                    own = which == w
                    found = tiles(ids, items.words[w], pos[own], at[own], k)
                    if found:
                        out.append((doc_id, items.item_ids[w], len(found), max(t[2] for t in found), sum(t[2] for t in found), len(items.words[w])))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            types = [b.schema.field(0).type, pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, "item_id", "n_tiles", "longest", "tiled_words", "item_words"])

    return match


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_id, n_tiles, longest, tiled_words, item_words, coverage): documents with items of which they hold at least ``min_words`` words in a row.

    The items are a stated query set against all rows: they are broadcast in blocks of about ``block_chars``
    characters. With more than one block, each pass is written before the next block is read, so driver
    and tasks hold one block at a time. Texts that are null or have fewer words
    match nothing; repeated documents and items come out each; no items give no rows.
    """
    texts = items.filter(F.col("text").isNotNull()).select("item_id", "text")
    size = texts.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    parts = []
    for b in range(blocks):
        rows = [tuple(r) for r in texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()]
        block = docs.sparkSession.sparkContext.broadcast(rows)
        met = spread(docs.select(key, "text")).mapInArrow(_matcher(block, min_words, key), f"{key} {dict(docs.dtypes)[key]}, {SCHEMA}")
        if blocks > 1:
            met = cut(met)
            block.unpersist()
        parts.append(met)
    return reduce(DataFrame.unionByName, parts).withColumn("coverage", F.col("tiled_words") / F.col("item_words"))
