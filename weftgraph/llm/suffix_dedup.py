"""Operator 2, exact substring deduplication by suffix arrays and longest-previous-factor arrays.

A byte goes if it is covered by a string of ``WINDOW`` bytes that also starts earlier: in a document with a
smaller id, or before in the same document. Copies are judged on the input, and the first is kept.

``repeats.covered`` finds the segments of text around which copies begin or end and deals them out in
blocks; for each block, a suffix array is built by doubling, and the longest previous factor of each
place is the longer of its common prefixes with the previous and the next smaller place in suffix order.

Null texts count as empty; null ids and texts shorter than the window lose nothing. Rows that repeat an id
are taken for one document. Equal documents keep the copy with the smallest id; place decides within one, so there are no ties. A text of
any length is searched whole, in overlapping pieces. Empty tables give no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import trimmed
from weftgraph.llm.repeats import Windows, covered, doc_id, spans

WINDOW = 100


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def prefix_ranks(s: np.ndarray, left: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Ranks of the prefixes of 8, 16, ... ``longest`` symbols of all suffixes; left: symbols left in a suffix's segment."""
    n = len(s)
    padded = np.append(s.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64))
    first = np.zeros(n, np.uint64)
    for i in range(7):  # nine bits for each of seven symbols; the eighth joins below
        first = first << np.uint64(9) | np.where(left > i, padded[i : i + n], 0)
    eighth = np.where(left > 7, padded[7 : 7 + n], 0).astype(np.int64)
    _, rank = np.unique(first, return_inverse=True)
    _, rank = np.unique(rank * 257 + eighth, return_inverse=True)
    ranks, size = {8: rank}, 8
    while 2 * size <= longest:
        rest = np.zeros(n, np.int64)
        rest[: n - size] = rank[size:] + 1
        rest[left <= size] = 0
        _, rank = np.unique(rank * (n + 1) + rest, return_inverse=True)
        size *= 2
        ranks[size] = rank
    return ranks


def smaller_neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each index of ``order``: the nearest index before, and after, with a smaller value; -1 and n if none.

    Pointers jump over what is larger: each round replaces a pointer by its target's, so rounds are few.
    """
    n = len(order)

    def before(x: np.ndarray) -> np.ndarray:
        at = np.arange(n) - 1
        open_ = np.flatnonzero((at >= 0) & (x[at] > x))
        while len(open_):
            at[open_] = at[at[open_]]
            open_ = open_[(at[open_] >= 0)]
            open_ = open_[x[at[open_]] > x[open_]]
        return at

    return before(order), n - 1 - before(order[::-1])[::-1]


def common_prefix(ranks: dict[int, np.ndarray], s: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, within their segments, as far as the ranks reach."""
    length, live = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    n = len(s)
    for size in sorted(ranks, reverse=True):
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        fits = live & (left[a] - length >= size) & (left[b] - length >= size)
        length[fits & (ranks[size][x] == ranks[size][y])] += size
    for _ in range(min(ranks) - 1):
        live &= (left[a] > length) & (left[b] > length)
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        live &= s[x] == s[y]
        length[live] += 1
    return length


def previous_factors(s: np.ndarray, left: np.ndarray, longest: int = 128) -> np.ndarray:
    """Longest-previous-factor array: how much of each suffix, to its segment's end, also starts before it."""
    ranks = prefix_ranks(s, left, longest)
    suffixes = np.argsort(ranks[max(ranks)], kind="stable")
    before, after = smaller_neighbours(suffixes)
    out = np.zeros(len(s), np.int64)
    for near, has in ((before, before >= 0), (after, after < len(s))):
        a, b = suffixes[has], suffixes[near[has]]
        out[a] = np.maximum(out[a], common_prefix(ranks, s, left, a, b))
    return out


def earlier_windows(segments: list[np.ndarray], doc: np.ndarray) -> list[np.ndarray]:
    """Windows of each segment that start earlier in the block; segments come in order of document and place."""
    lengths = np.array([len(x) for x in segments])
    ends = np.cumsum(lengths)
    s = np.concatenate(segments)
    left = np.repeat(ends, lengths) - np.arange(len(s))
    hits = np.flatnonzero(previous_factors(s, left) >= WINDOW)
    part = np.searchsorted(ends, hits, side="right")
    hits = hits - (ends - lengths)[part]
    return np.split(hits, np.searchsorted(part, np.arange(1, len(segments))))


def kept_bytes(text: str | None, stretches) -> tuple[bytes, int]:
    """What is left of a text, and the number of removed runs."""
    data = (text or "").encode()
    a, e = spans(stretches)
    out, at = [], 0
    for x, y in zip(a.tolist(), e.tolist(), strict=True):
        out.append(data[at:x])
        at = y
    return b"".join([*out, data[at:]]), len(a)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_text, kept_sha256 and the struct ``rest`` of its other columns.

    Cuts go through the bytes of characters; kept_text drops bytes that are no longer part of one, and is
    the text itself, null included, where nothing was removed.
    """

    @F.pandas_udf("n_removed long, n_spans long, kept_text string, kept_sha256 string")
    @trimmed
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, stretches in batches:
            out = []
            for text, x in zip(texts, stretches, strict=True):
                kept, n = kept_bytes(text, x)
                removed = len((text or "").encode()) - len(kept)
                out.append((removed, n, kept.decode(errors="ignore") if removed else text, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_text", "kept_sha256"])

    found = covered(docs, Windows(WINDOW, 32, _bytes, True), earlier_windows)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return found.select(doc_id(), size, "rest", keep("text", "stretches").alias("x")).select("doc_id", "n_bytes", "x.*", "rest")
