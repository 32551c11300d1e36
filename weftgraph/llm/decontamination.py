"""Operator 8, benchmark decontamination: seeds of two nearby words, then Smith-Waterman alignment.

1. An item's seeds are its pairs of words that are adjacent or one apart. Hashes of all seeds, and the items' words, are
   broadcast; a benchmark of over ``BLOCK`` characters goes in several blocks, and documents are read once for each.
2. An alignment with score S of an item of L words has at least S / 2 - 1 steps from a matched word to the next that
   skip at most one word on either side: of M matches, S = 2 M - skipped, and any other step skips two or more.
   So a document that reaches the least coverage c holds c L - 1 or more seeds, within 3 L - 2 c L words. Stretches
   that do become passages; nothing else can reach c. Items with c L <= 1 have single words as seeds.
3. Passages are aligned with the item, word by word. The best local score, as a share of the item's own, is its
   coverage: copies have 1, edited and paraphrased ones less.

All pairs of coverage c or more are found. Null ids, null texts and texts without words take no part on either side. Of
several passages the best counts, so a repeated document or item id has one row per pair, and ties make no difference. A document
of any length is searched whole, in overlapping pieces. Empty tables on either side give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from weftgraph.llm.common import small_batches, trimmed
from weftgraph.llm.repeats import join

#: Words: runs of letters and digits, lower-cased; bytes from 0x80 on belong to letters.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
MATCH, MISMATCH, GAP = 2, -1, -1
#: Characters of the items that are broadcast at once, with a hash and an item number for each seed; one longer item is a block too.
BLOCK = 1 << 21
#: Places of the bitmap of a block's seeds, as a power of two; a byte each, 8 MB.
BITS = 23
#: Pairs aligned at once, and words of their padded passages.
PAIRS, CELLS = 64, 200_000
#: Characters of the texts that are hashed at once.
TEXTS = 600_000
#: Words of a long document that are searched at once; the next ones overlap by an alignment's length.
PIECE = 100_000


def words(text: str) -> list[bytes]:
    return WORDS.findall(text.lower().encode())


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def pairs(h: np.ndarray, skip: int) -> np.ndarray:
    """Hashes of the pairs of words with ``skip`` words between them."""
    return join(h[: max(0, len(h) - skip - 1)], h[skip + 1 :])


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair of word-hash sequences; pairs are padded and aligned side by side."""
    rows, columns = max(map(len, items)), max(map(len, passages))
    a = np.zeros((len(items), rows), np.uint64)
    b = np.ones((len(items), columns), np.uint64)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x | np.uint64(2), y | np.uint64(2)
    slope = GAP * np.arange(columns, dtype=np.int32)
    h = np.zeros((len(items), columns + 1), np.int32)
    best = np.zeros(len(items), np.int32)
    for j in range(rows):
        cell = h[:, :-1] + np.where(a[:, j, None] == b, MATCH, MISMATCH).astype(np.int32)
        cell = np.maximum(np.maximum(cell, h[:, 1:] + GAP), 0)
        cell = np.maximum.accumulate(cell - slope, axis=1) + slope
        h = np.concatenate([np.zeros((len(items), 1), np.int32), cell], axis=1)
        best = np.maximum(best, np.where(a[:, j] != 0, cell.max(axis=1), 0))
    return best


class Index:
    """The items of a block: their words, seeds, and what a document must hold of them to reach the least coverage."""

    def __init__(self, items: list[tuple[int, str]], least_coverage: float):
        found = [(i, hashes(words(t))) for i, t in items]
        self.ids = np.array([i for i, h in found if len(h)], np.int64)
        self.words = [h for _, h in found if len(h)]
        lengths = np.array([len(h) for h in self.words], np.int64)
        need = np.ceil(least_coverage * lengths - 1 - 1e-9).astype(np.int64)
        self.need = np.maximum(need, 1)
        self.span = np.floor((3 - 2 * min(least_coverage, 1)) * lengths + 1e-9).astype(np.int64)
        self.singles = bool((need < 1).any())
        seeds = [np.unique(h if n < 1 else np.concatenate([pairs(h, 0), pairs(h, 1)])) for h, n in zip(self.words, need, strict=True)]
        seed = np.concatenate([np.zeros(0, np.uint64), *seeds])
        item = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        order = np.argsort(seed, kind="stable")
        self.item = item[order]
        self.seed, self.first, self.count = np.unique(seed[order], return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.seed & np.uint64((1 << BITS) - 1)] = True

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) for each place of ``g`` that is a seed of the item."""
        at = np.flatnonzero(self.bitmap[g & np.uint64((1 << BITS) - 1)])
        k = np.minimum(np.searchsorted(self.seed, g[at]), len(self.seed) - 1)
        same = self.seed[k] == g[at]
        at, k = at[same], k[same]
        n = self.count[k]
        move = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.item[np.repeat(self.first[k], n) + move], np.repeat(at, n)

    def passages(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, begin, end) of all stretches of texts, given one after another, that hold enough seeds of an item."""
        found = [self.hits(pairs(h, 0)), self.hits(pairs(h, 1))] + ([self.hits(h)] if self.singles else [])
        key = np.unique(np.concatenate([(item << 40) | place for item, place in found]))
        item, place = key >> 40, key & ((1 << 40) - 1)
        other = np.arange(len(key)) + self.need[item] - 1
        inside = other < len(key)
        item, place, other = item[inside], place[inside], other[inside]
        part = np.searchsorted(ends, place, side="right")
        span = self.span[item]
        enough = (key[other] - key[inside] < span) & (key[other] < (item << 40 | ends[part]))
        item, place, part, span, other = (x[enough] for x in (item, place, part, span, other))
        begin = np.maximum(place - span, np.append(0, ends)[part])
        end = np.minimum((key[other] & ((1 << 40) - 1)) + span, ends[part])
        if not len(item):
            return item, begin, end
        new = np.append(True, (np.diff(item) != 0) | (np.diff(part) != 0) | (begin[1:] > end[:-1]))
        first = np.flatnonzero(new)
        return item[first], begin[first], end[np.append(first[1:] - 1, len(item) - 1)]


@trimmed
def _found(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> the best score of each with each item that it may hold."""
    schema = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("score", pa.int64()), ("coverage", pa.float64())])
    overlap = int(index.span.max(initial=0))
    step = max(PIECE, overlap)

    def handle(ids: list[int], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, ends = np.concatenate(found), np.cumsum([len(f) for f in found])
        item, begin, end = index.passages(h, ends)
        if not len(item):
            return
        score = np.zeros(len(item), np.int64)
        order = np.argsort(end - begin, kind="stable")
        while len(order):
            n = int(np.count_nonzero((end - begin)[order[:PAIRS]] * np.arange(1, len(order[:PAIRS]) + 1) <= CELLS))
            part, order = order[: max(n, 1)], order[max(n, 1) :]
            score[part] = align([index.words[item[i]] for i in part], [h[begin[i] : end[i]] for i in part])
        doc = np.array(ids, np.int64)[np.searchsorted(ends, begin, side="right")]
        coverage = score / (MATCH * np.array([len(index.words[i]) for i in item]))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((doc, index.ids[item], score, coverage), schema, strict=True)], schema=schema)

    ids, found, size = [], [], 0
    for batch in batches:
        for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = hashes(words(text))
            for a in range(0, max(1, len(h) - overlap), step):
                ids.append(doc)
                found.append(h[a : a + step + overlap])
                size += 6 * len(found[-1])
                if size > TEXTS:
                    yield from handle(ids, found)
                    ids, found, size = [], [], 0
    if ids:
        yield from handle(ids, found)


def contaminated(docs: DataFrame, benchmark: DataFrame, least_coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, coverage) of all documents that hold an item, or an edited copy of one."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item"), F.col("text").alias("item_text"))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    blocks = -(-(items.agg(F.sum(F.length("item_text"))).first()[0] or 1) // BLOCK)

    def found(block: int) -> DataFrame:
        mine = items.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Index([(r["item"], r["item_text"]) for r in mine], least_coverage))
        return texts.mapInArrow(lambda b: _found(shared.value, b), "doc long, item long, score long, coverage double")

    scored = reduce(DataFrame.unionAll, map(found, range(blocks)))
    best = scored.groupBy("doc", "item").agg(F.max("score").alias("score"), F.max("coverage").alias("coverage"))
    return best.where(F.col("coverage") >= least_coverage).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "score", "coverage")
