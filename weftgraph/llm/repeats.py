"""Repeated windows across a corpus: the search that operators 2 and 9 share.

A document is a row of symbols (bytes, or hashes of words). A window is ``window`` consecutive symbols of one
document. The question for each window is whether it also starts earlier. It is answered in steps, none
of which gathers a corpus in one place:

1. Every window is assigned to an anchor, the smallest of the hashes of its ``seed``-symbol pieces. Equal
   windows have equal anchors. Neighbouring windows of one anchor form a segment; a document has about
   one segment in (window - seed) / 2 symbols. Segments that repeat whole within a batch are settled there.
2. Segments meet by anchor. One that repeats whole elsewhere is settled by its hash. An anchor that
   occurs once is done with. What remains are anchors with several different segments around them: there
   copies begin or end.
3. Those segments fetch their symbols from their documents and meet again by anchor, in blocks of bounded
   size, where a ``resolver`` (a suffix array, an FM-index) finds the windows that start earlier.
4. Anchors with more than ``HOT`` different segments would make blocks too large; their windows are
   dealt out by two 64-bit hashes of their own instead.
5. The covered stretches return to their documents.

Order is by document id and place. Rows with a null id, and texts shorter than a window, take no part. Rows
that repeat an id are taken for one document. Long texts are handled in overlapping pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import drop_made, small_batches, stored, trimmed

#: Different segments around one anchor that still make a block of their own.
HOT = 4_000
#: Symbols of a block.
BLOCK = 600_000
#: Symbols that the anchor search handles at once; places are packed into so many bits.
PIECE, PLACE_BITS = 250_000, 24

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * _ODD[0]
    return x ^ (x >> np.uint64(29))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _ODD[1] + b * _ODD[2] + _ODD[0])


@dataclass(frozen=True)
class Windows:
    """window and seed length in symbols; ``symbols`` turns a text into an array of 64-bit integers.

    again: whether an earlier place of the same document counts.
    """

    window: int
    seed: int
    symbols: Callable[[str], np.ndarray]
    again: bool

    def _powers(self, s: np.ndarray) -> dict[int, np.ndarray]:
        """Hashes of all stretches of 1, 2, 4, ... symbols, up to the longest segment."""
        powers, size = {1: mix(s)}, 1
        while 2 * size <= 2 * self.window - self.seed:
            h, m = powers[size], max(0, len(s) - 2 * size + 1)
            powers[2 * size] = join(h[:m], h[size : size + m])
            size *= 2
        return powers

    def segments(self, s: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        """Segments of texts given one after another: first and last window, anchor and content hash.

        s: symbols, at most PIECE; ends: where each text ends. Windows don't cross ends.
        """
        n = len(s)
        assert n <= 1 << PLACE_BITS, "more symbols than places"
        bits = np.uint64(PLACE_BITS)
        powers = self._powers(s.astype(np.uint64))

        def hashes(length: int) -> np.ndarray:
            p = 1 << (length.bit_length() - 1)
            m = max(0, n - length + 1)
            return powers[p][:m] if p == length else join(powers[p][:m], powers[p][length - p : length - p + m])

        seeds = hashes(self.seed)
        text_end = np.repeat(ends, np.diff(np.append(0, ends)))
        m = max(0, n - self.window + 1)
        inside = np.arange(m) + self.window <= text_end[:m]
        if not inside.any():
            return {k: np.zeros(0, np.int64) for k in ("first", "last", "anchor", "content")}
        places = np.arange(len(seeds), dtype=np.uint64)
        low = (seeds >> bits << bits) | places
        width, size = self.window - self.seed + 1, 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:m], low[width - size : width - size + m])
        at = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        windows = np.flatnonzero(inside)
        at = at[windows]
        cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(windows) != 1) | (text_end[windows[1:]] != text_end[windows[:-1]])) + 1
        first = windows[np.append(0, cut)]
        last = windows[np.append(cut - 1, len(windows) - 1)]
        length = last - first + self.window
        content = np.zeros(len(first), np.uint64)
        if self.window == self.seed:  # anchor and content are of the same symbols, so they must be two hashes: 128 bits tell windows apart
            powers = self._powers(s.astype(np.uint64) ^ _ODD[2])
        big = 1 << ((2 * self.window - self.seed).bit_length() - 1)
        for p in (big, big // 2):
            pick = (length >= p) & ((p == big) | (length < big))
            a, l = first[pick], length[pick]
            content[pick] = join(powers[p][a], powers[p][a + l - p]) ^ mix(l.astype(np.uint64))
        return {"first": first, "last": last, "anchor": seeds[at[np.append(0, cut)]].view(np.int64), "content": content.view(np.int64)}


def _pieces(symbols: list[np.ndarray], window: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of (text number, offset, symbols) of at most PIECE symbols; long texts are cut, overlapping by window - 1."""
    group, total = [], 0
    for i, s in enumerate(symbols):
        for a in range(0, max(1, len(s) - window + 1), PIECE // 2):
            part = s[a : a + PIECE // 2 + window - 1]
            if total + len(part) > PIECE and group:
                yield group
                group, total = [], 0
            group.append((i, a, part))
            total += len(part)
    if group:
        yield group


def _runs(*columns: np.ndarray) -> np.ndarray:
    """For sorted columns: True where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _later(w: Windows, doc: np.ndarray, place: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For rows in order of content, document and place: those that come after the first of their run."""
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = doc > doc[lead]
    return later | ((doc == doc[lead]) & (place > place[lead])) if w.again else later


def _merged(doc: np.ndarray, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the same document that touch become one."""
    if not len(doc):
        return doc, a, e
    order = np.lexsort((a, doc))
    doc, a, e = doc[order], a[order], e[order]
    number = np.cumsum(_runs(doc))
    reach = np.maximum.accumulate(number * (1 << 40) + e) - number * (1 << 40)
    start = np.ones(len(doc), bool)
    start[1:] = (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])
    first = np.flatnonzero(start)
    return doc[first], a[first], reach[np.append(first[1:] - 1, len(doc) - 1)]


_FIELDS = {"kind": "int", "anchor": "long", "content": "long", "doc": "long", "a": "long", "e": "long", "symbols": "binary"}
_ROW = ", ".join(f"{k} {v}" for k, v in _FIELDS.items())
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(k, _ARROW[v]) for k, v in _FIELDS.items()])
COVERED, SEGMENT, ASK, HOT_ASK = range(4)
#: Stands for a null id, so that joins on ids need no filter and their shuffles of the texts are one.
NO_ID = -(1 << 63)


def _rows(kind: int, doc, a, e, anchor=None, content=None, symbols=None) -> pa.RecordBatch:
    """Rows of one kind. Those that are covered are dealt out by their document."""
    n = len(doc)
    anchor = mix(np.asarray(doc, np.int64).view(np.uint64)).view(np.int64) if anchor is None else anchor
    columns = (np.full(n, kind, np.int32), anchor, np.zeros(n, np.int64) if content is None else content, doc, a, e)
    last = pa.nulls(n, pa.binary()) if symbols is None else pa.array(symbols, pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(columns, _SCHEMA, strict=False)), last], schema=_SCHEMA)


def _local(w: Windows, kind: int, anchor, content, doc, first, last) -> Iterator[pa.RecordBatch]:
    """Segments of a batch: those that come after an equal one are covered, the others go on."""
    by = np.lexsort((first, doc, content, anchor))
    anchor, content, doc, first, last = (x[by] for x in (anchor, content, doc, first, last))
    later = _later(w, doc, first, _runs(anchor, content))
    yield _rows(COVERED, *_merged(doc[later], first[later], last[later] + w.window))
    yield _rows(kind, doc[~later], first[~later], last[~later], anchor[~later], content[~later])


@trimmed
def _anchors(w: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> segments."""
    drop_made()

    def handle(ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        for group in _pieces([w.symbols(t) for t in texts], w.window):
            lengths = np.array([len(s) for _, _, s in group])
            ends = np.cumsum(lengths)
            found = w.segments(np.concatenate([s for _, _, s in group]), ends)
            part = np.searchsorted(ends, found["first"], side="right")
            doc = np.array([ids[i] for i, _, _ in group], np.int64)[part]
            move = np.array([a for _, a, _ in group])[part] - (ends - lengths)[part]
            yield from _local(w, SEGMENT, found["anchor"], found["content"], doc, found["first"] + move, found["last"] + move)

    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i == NO_ID or t is None:
                continue
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size > PIECE:
                yield from handle(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield from handle(ids, texts)


@trimmed
def _meet(w: Windows, batches: Iterator[pa.RecordBatch], ask: bool = True) -> Iterator[pa.RecordBatch]:
    """Segments, in order of anchor, content, document and place -> what is covered, and what must be asked.

    The first segments of the last anchor are carried to the next batch; of an anchor with more than
    HOT of them, only those of the last content.
    """
    carry = [np.zeros(0, np.int64)] * 5
    hot: int | None = None
    for batch in batches:
        done = batch.filter(pa.compute.equal(batch.column(0), COVERED))
        if done.num_rows:
            yield done
        batch = batch.filter(pa.compute.equal(batch.column(0), SEGMENT))
        if not batch.num_rows:
            continue
        n_carried = len(carry[0])
        rows = [np.concatenate([c, batch.column(i).to_numpy()]) for i, c in enumerate(carry, 1)]
        later = _later(w, rows[2], rows[3], _runs(rows[0], rows[1]))
        fresh = np.arange(len(later)) >= n_carried
        yield _rows(COVERED, *_merged(rows[2][later], rows[3][later], rows[4][later] + w.window))
        told = ~fresh & (rows[0] == hot) if hot is not None else np.zeros(len(later), bool)
        first, told = [x[~later] for x in rows], told[~later]
        last = first[0] == rows[0][-1]
        if ask:
            yield from _asked([x[~last & ~told] for x in first], hot)
        carry = [x[last] for x in first]
        if ask and (carry[0][0] == hot or len(carry[0]) > HOT):
            hot = int(carry[0][0])
            yield from _asked([x[~told[last]] for x in carry], hot)
            carry = [x[carry[1] == carry[1][-1]] for x in carry]
        elif not ask:
            carry = [x[carry[1] == carry[1][-1]] for x in carry]
    if ask and len(carry[0]) and carry[0][0] != hot:
        yield from _asked(carry, hot)


def _asked(first: list[np.ndarray], hot: int | None) -> Iterator[pa.RecordBatch]:
    """The segments of anchors that have several contents."""
    anchor, content, doc, a, e = first
    if not len(anchor):
        return
    many = np.where(anchor == hot, 2, _several(anchor, content)) if hot is not None else _several(anchor, content)
    for kind, pick in ((ASK, many == 1), (HOT_ASK, many == 2)):
        if pick.any():
            yield _rows(kind, doc[pick], a[pick], e[pick], anchor[pick], content[pick])


@trimmed
def _fetch(w: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with what is asked of them -> segments with their symbols; of hot anchors, single windows."""
    one = Windows(w.window, w.window, w.symbols, w.again)

    def send(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for kind in (ASK, HOT_ASK):
            mine = [r for r in rows if r[0] == kind]
            if not mine:
                continue
            _, anchor, doc, a, e, symbols = zip(*mine, strict=True)
            doc, a = np.array(doc, np.int64), np.array(a, np.int64)
            if kind == ASK:
                yield _rows(ASK, doc, a, np.array(e, np.int64), np.array(anchor, np.int64), symbols=[x.tobytes() for x in symbols])
                continue
            lengths = np.array([len(x) for x in symbols])
            ends = np.cumsum(lengths)
            found = one.segments(np.concatenate(symbols), ends)
            part = np.searchsorted(ends, found["first"], side="right")
            place = a[part] + found["first"] - (ends - lengths)[part]
            yield from _local(w, SEGMENT, found["anchor"], found["content"], doc[part], place, place)

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if text is None:
                continue
            s = w.symbols(text)
            for x in asked:
                part = s[x["a"] : x["e"] + w.window]
                if rows and (size + len(part) > PIECE or len(rows) > 4_000):
                    yield from send(rows)
                    rows, size = [], 0
                rows.append((x["kind"], x["anchor"], doc, x["a"], x["e"], part))
                size += len(part)
    yield from send(rows)


@trimmed
def _resolve(w: Windows, resolver: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fetched segments come by anchor, whole anchors are gathered to blocks; single windows are compared by their hash."""
    kind = w.symbols("").dtype

    def block(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[:2])
        doc, a = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        found = resolver([np.frombuffer(r[2], kind) for r in rows], doc)
        n = [len(x) for x in found]
        start = np.repeat(a, n) + np.concatenate(found)
        return _rows(COVERED, *_merged(np.repeat(doc, n), start, start + w.window))

    def blocks(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nonlocal size, now
        for anchor, doc, a, s in zip(*(part.column(i).to_pylist() for i in (1, 3, 4, 6)), strict=True):
            if anchor != now and size > BLOCK * kind.itemsize:
                yield block(rows)
                rows.clear()
                size = 0
            now = anchor
            rows.append((doc, a, s))
            size += len(s)

    rows: list[tuple[int, int, bytes]] = []
    size, now = 0, None

    def others() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.filter(pa.compute.equal(batch.column(0), ASK))
            waiting.extend(blocks(asked))
            yield batch.filter(pa.compute.not_equal(batch.column(0), ASK))

    waiting: list[pa.RecordBatch] = []
    for out in _meet(w, others(), ask=False):
        yield from waiting
        waiting.clear()
        yield out
    yield from waiting
    if rows:
        yield block(rows)


def covered(docs: DataFrame, w: Windows, resolver: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(key, text, rest, stretches) for each row of ``docs``; key is its doc_id, NO_ID for null, and rest its other columns.

    stretches: array of a * 2^32 + e for each covered stretch [a, e) of symbols, or null.
    resolver: (symbols of each segment, their documents; in order of document and place) -> for each
    segment the numbers of its windows that start earlier.
    """
    small_batches(docs.sparkSession)
    rest = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    # both joins with the documents take the same columns, so that one shuffle of the texts serves both
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), "text", (F.struct(*rest) if rest else F.lit(0)).alias("rest"))
    order = ("anchor", "content", "doc", "a")

    def deal(rows: DataFrame) -> DataFrame:
        return rows.repartition("anchor").sortWithinPartitions(*order)

    segments = keyed.select("key", "text").mapInArrow(lambda b: _anchors(w, b), _ROW)
    met = stored(deal(segments).mapInArrow(lambda b: _meet(w, b), _ROW).drop("symbols", "content"))
    asked = met.where(F.col("kind").isin(ASK, HOT_ASK)).groupBy("doc").agg(F.collect_list(F.struct("kind", "anchor", "a", "e")).alias("asked"))
    fetched = keyed.join(asked, keyed["key"] == asked["doc"]).select("key", "text", "asked", "rest").mapInArrow(lambda b: _fetch(w, b), _ROW)
    resolved = deal(fetched).mapInArrow(lambda b: _resolve(w, resolver, b), _ROW)
    found = met.select("kind", "doc", "a", "e").unionByName(resolved.select("kind", "doc", "a", "e")).where(F.col("kind") == COVERED)
    stretches = found.groupBy("doc").agg(F.collect_list(F.shiftleft(F.col("a"), 32) + F.col("e")).alias("stretches"))
    return keyed.join(stretches, keyed["key"] == stretches["doc"], "left").select("key", "text", "rest", "stretches")


def doc_id() -> Column:
    """The id of a row that ``covered`` gives."""
    return F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id")


def _several(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    """For rows in order of anchor and content: 0 if the row's anchor has one content, 2 if more than HOT rows, else 1."""
    new = _runs(anchor)
    group = np.cumsum(new) - 1
    contents = np.bincount(group, _runs(anchor, content))
    sizes = np.bincount(group)
    return np.where(contents < 2, 0, np.where(sizes > HOT, 2, 1))[group]


def spans(packed) -> tuple[np.ndarray, np.ndarray]:
    """Merged stretches (starts, ends) of one document, from the column ``stretches``."""
    if packed is None or not len(packed):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = np.sort(np.asarray(packed, np.int64))
    _, a, e = _merged(np.zeros(len(p), np.int64), p >> 32, p & 0xFFFFFFFF)
    return a, e
