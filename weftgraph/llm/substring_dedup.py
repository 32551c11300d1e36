"""Operator 9, substring deduplication by compressed FM-indexes.

A word goes if it is covered by a window of ``WINDOW`` words whose sequence also starts in a document with
a smaller id. ``repeats.covered`` deals out the segments of text around which copies begin or end. Each
shard of them gets an FM-index: the Burrows-Wheeler transform of its words in a wavelet matrix of packed
bits with rank counts. Segments are then streamed through it by backward search, many at a time; matching
statistics are held at the window's length by widening an interval to one word less before each step. Where
the statistic reaches the threshold, the smallest document of the interval says if the window is a copy.

Null texts hold no words; null ids and texts shorter than the window lose nothing. Rows that repeat an id are
taken for one document. Repeats within one document stay; the smallest id keeps its copy, so there are no ties. A text of any length
is searched whole, in overlapping pieces. Empty tables give no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from weftgraph.llm.common import trimmed
from weftgraph.llm.repeats import Windows, covered, doc_id, spans

WINDOW = 50


def words(text: str) -> list[bytes]:
    """Runs of bytes other than space and \\x09 to \\x0d."""
    return text.encode().split()


def _hashes(text: str) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


class WaveletMatrix:
    """Rank queries over a sequence of small integers: a packed bit vector with counts for each bit, highest first."""

    def __init__(self, x: np.ndarray, sigma: int):
        self.levels = []
        self.bits = max(1, int(sigma - 1).bit_length())
        for shift in range(self.bits - 1, -1, -1):
            bit = (x >> shift & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bool)), bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.uint32)
            self.levels.append((packed, counts, int((~bit).sum())))
            x = np.concatenate([x[~bit], x[bit]])

    def track(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the first ``place`` entries that equal ``symbol`` end, among the entries in the order of the last level."""
        for level, (packed, counts, zeros) in enumerate(self.levels):
            word = place >> 6
            ones = counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            up = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            place = np.where(up, zeros + ones.astype(np.int64), place - ones.astype(np.int64))
        return place


class FMIndex:
    """Backward search over segments; suffixes are sorted as far as a window reaches, which is as far as searches go."""

    def __init__(self, segments: list[np.ndarray], doc: np.ndarray, window: int):
        self.window = window
        alphabet, coded = np.unique(np.concatenate(segments), return_inverse=True)
        self.lengths = np.array([len(x) for x in segments])
        n = len(coded) + len(segments)
        ends = np.cumsum(self.lengths + 1) - 1
        text = np.zeros(n, np.int64)  # each segment is followed by a 0
        here = np.ones(n, bool)
        here[ends] = False
        text[here] = coded + 1
        self.starts = ends - self.lengths
        self.text = text
        ranks, size = {1: text}, 1
        while size < window:
            rank = ranks[size]
            rest = np.zeros(n, np.int64)
            rest[: n - size] = rank[size:] + 1
            _, ranks[2 * size] = np.unique(rank * (n + 2) + rest, return_inverse=True)
            size *= 2
        order = np.argsort(ranks[size], kind="stable")
        sigma = len(alphabet) + 1
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = WaveletMatrix(text[order - 1], sigma)
        self.zero = self.wavelet.track(np.zeros(sigma, np.int64), np.arange(sigma))
        shorter = np.cumsum(~self._same(ranks, order, window - 1)) - 1
        edges = np.append(np.flatnonzero(np.append(True, np.diff(shorter) != 0)), n)
        self.low, self.high = edges[shorter], edges[shorter + 1]
        whole = np.cumsum(~self._same(ranks, order, window)) - 1
        documents = np.repeat(doc, self.lengths + 1)[order]
        self.least = np.minimum.reduceat(documents, np.flatnonzero(np.append(True, np.diff(whole) != 0)))[whole]

    @staticmethod
    def _same(ranks: dict[int, np.ndarray], order: np.ndarray, length: int) -> np.ndarray:
        """Whether a suffix and the one before it in order share ``length`` symbols."""
        a, b = order[1:], order[:-1]
        same = np.ones(len(a), bool)
        at, n = 0, len(order)
        for size in sorted(ranks, reverse=True):
            if length & size:
                x, y = a + at, b + at
                inside = (x < n) & (y < n)
                same &= inside & (ranks[size][np.minimum(x, n - 1)] == ranks[size][np.minimum(y, n - 1)])
                at += size
        return np.append(False, same)

    def least_documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window of each segment: segment, place in it, and the smallest document of its interval."""
        lanes = np.arange(len(self.lengths))
        low, high = np.zeros(len(lanes), np.int64), np.full(len(lanes), len(self.text))
        out = []
        for step in range(int(self.lengths.max(initial=0))):
            live = self.lengths > step
            lanes, low, high = lanes[live[lanes]], low[live[lanes]], high[live[lanes]]
            if step >= self.window:  # one word less, so that the next fits
                low, high = self.low[low], self.high[high - 1]
            place = self.lengths[lanes] - 1 - step
            symbol = self.text[self.starts[lanes] + place]
            low = self.counts[symbol] + self.wavelet.track(low, symbol) - self.zero[symbol]
            high = self.counts[symbol] + self.wavelet.track(high, symbol) - self.zero[symbol]
            if step >= self.window - 1:
                out.append((lanes, place, self.least[low]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def earlier_windows(segments: list[np.ndarray], doc: np.ndarray) -> list[np.ndarray]:
    """Windows of each segment that start in a smaller document of the shard."""
    index = FMIndex(segments, doc, WINDOW)
    lane, place, least = index.least_documents()
    hit = least < doc[lane]
    lane, place = lane[hit], place[hit]
    order = np.lexsort((place, lane))
    lane, place = lane[order], place[order]
    return np.split(place, np.searchsorted(lane, np.arange(1, len(segments))))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (words joined by a space), kept_sha256 and the struct ``rest``."""

    @F.pandas_udf("n_words long, n_removed long, kept_text string, kept_sha256 string")
    @trimmed
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, stretches in batches:
            out = []
            for text, x in zip(texts, stretches, strict=True):
                found = words(text or "")
                kept, at = [], 0
                for a, e in zip(*(y.tolist() for y in spans(x)), strict=True):
                    kept += found[at:a]
                    at = e
                joined = b" ".join(kept + found[at:])
                out.append((len(found), len(found) - len(kept) - len(found[at:]), joined.decode(), hashlib.sha256(joined).hexdigest()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text", "kept_sha256"])

    found = covered(docs, Windows(WINDOW, 10, _hashes, False), earlier_windows)
    return found.select(doc_id(), "rest", keep("text", "stretches").alias("x")).select("doc_id", "x.*", "rest")
