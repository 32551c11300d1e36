"""Operator 7, near-duplicate documents by SetSketch registers.

A document's set holds its distinct five-word shingles (lower-cased A-Z; with fewer words, the whole sequence).
Documents are linked if their sets' Jaccard similarity is at least 75 percent; the result is the connected
components of all links.

1. Each element of a set makes a Poisson process of points dealt over the registers; a register keeps its
   smallest point, truncated to an exponentially spaced grid. Registers of unions are maxima of registers.
   Points beyond what still can be a minimum are not made, so a set costs m ln m points, whatever its size.
2. Equal sets become one class. Classes meet in bands of register values; with 40 bands of four
   registers a pair of similarity 0.75 is missed with a probability below 3e-7.
3. In each bucket, members are paired with the bucket's smallest member only. A pair whose joint likelihood
   estimate of the similarity is far below the threshold is dropped; the others are verified on full sets.
4. Verified links give components. Buckets that then still hold several components are searched again: members
   that lie in different components are compared by the low bits of 512 registers, at once verified on their full sets, and
   joined by a union-find, so that a bucket gives fewer links than it has members and no pair is ever a row. A large
   bucket is dealt out in cells, each of which holds a bounded block of members against another one.

What may be lost: a link of similarity 0.75 exactly meets in no band with a probability of 3e-7, and fails the test on 512
registers, which lies more than seven standard deviations lower, with one of about 1e-13; both fall fast with the similarity.

Texts that are null or hold no word have an empty set, linked with nothing; rows with a null id stay alone and
have no component. Rows that repeat an id are taken for one document with the union of their links. Ties don't
arise: a component is named by its smallest id. A text of any length has all of its shingles, held at once as 8 bytes each; empty tables
give no rows. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from weftgraph.llm.common import cut, drop_made, small_batches, stored, trimmed
from weftgraph.llm.repeats import join, mix

SHINGLE = 5
#: Similarity, in percent.
THRESHOLD = 75
BANDS, ROWS = 40, 4
BANDED = BANDS * ROWS
#: All registers; those that aren't banded only sharpen estimates.
REGISTERS = 512
BASE, RATE = 1.001, 20.0
#: Estimates from the banded registers below this are more than four standard deviations under the threshold.
LEAST_ESTIMATE = 0.60
#: The same, by more than seven, for the share of 512 registers that agree.
LEAST_SHARP = 0.60
#: Bits, as a power of two, of the bitmap of documents whose sets are wanted: 8 MB, whatever their number.
BITS = 26
#: Members that one copy of a pair's first set is compared with, and chunks that go as one row.
CHUNK, CHUNKS = 256, 4096
#: Members that a cell holds, bytes of their sets, and members that stream past them.
HELD, HELD_BYTES, STREAMED = 4096, 16 << 20, 16_384
#: Candidates verified at once; the first that are linked spare the others of their component.
TRIED = 32


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        for i in range(1, len(h)):
            h[0] = join(h[:1], h[i : i + 1])[0]
        return mix(h[:1] + np.uint64(len(h)))
    two = join(h[:-1], h[1:])
    four = join(two[:-2], two[2:])
    return np.unique(join(four[:-1], h[4:]))


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """[set, register] of uint16; sets must not be empty.

    An element's points are sums of exponential steps that a counter seeds, so they don't depend on how many are made at once.
    """
    out = np.full((len(sets), m), np.inf)
    flat = out.ravel()
    todo, room = np.arange(len(sets)), 4.0
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        # points at once: about what an element of a set of this size needs, as a power of two
        block = np.clip(2 ** np.ceil(np.log2(m * (np.log(m) + room) / sizes)), 8, 2048).astype(np.int64)
        for size in np.unique(block).tolist():
            mine, n, held = [], 0, todo[block == size].tolist()
            for k, i in enumerate(held):
                mine.append(i)
                n += len(sets[i])
                if n * size > 1 << 19 or k == len(held) - 1:
                    _points(flat, [sets[x] for x in mine], np.array(mine), m, room, size)
                    mine, n = [], 0
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        room *= 3
    return np.clip(np.floor(1 - np.log(out / RATE) / np.log(BASE)), 0, 65535).astype(np.uint16)


def _points(flat: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, m: int, room: float, block: int) -> None:
    """Lowers the registers of sets to their elements' points below the sets' limits."""
    sizes = np.array([len(s) for s in sets])
    limit = np.repeat((np.log(m) + room) / sizes, sizes)
    element, row, x = np.concatenate(sets), np.repeat(rows * m, sizes), np.zeros(sizes.sum())
    counter = np.arange(1, block + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    while len(element):
        h = mix(mix(element[:, None] + counter[None]))
        steps = np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / -m
        steps[:, 0] += x
        points = np.cumsum(steps, axis=1)
        e, j = np.nonzero(points < limit[:, None])
        register = (mix(h[e, j] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(flat, row[e] + register, points[e, j])
        live = points[:, -1] < limit
        element, row, x, limit = element[live], row[live], points[live, -1], limit[live]
        counter = counter + np.uint64(block * 0x9E3779B97F4A7C15 % (1 << 64))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimates of the similarity of pairs of sets, from registers and sizes."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    grid = np.linspace(0, 1, 101)[None, 1:-1] * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    fit = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))
    return grid[np.arange(len(fit)), fit.argmax(axis=1)]


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


_SKETCH = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("regs", pa.binary()), ("signature", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_BAND = pa.schema([("band", pa.int64()), ("doc", pa.int64())])
_MEMBER = pa.schema([("band", pa.int64()), ("i", pa.int32()), ("k", pa.int32()), ("within", pa.bool_()), ("streams", pa.bool_()), ("component", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary())])


@trimmed
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_made()
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo in range(0, len(docs), 250):
            sets = [shingles(t) for t in texts[lo : lo + 250]]
            keys = [(int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))) for s in sets]
            # of equal sets in a batch, one is sketched
            place = {k: i for i, k in reversed(list(enumerate(keys))) if len(sets[i])}
            made: dict[tuple[int, int], tuple[bytes, bytes]] = {}
            if place:
                for k, r in zip(place, registers([sets[i] for i in place.values()]), strict=True):
                    low = (r & 15).astype(np.uint8)
                    made[k] = r[:BANDED].tobytes(), (low[::2] << 4 | low[1::2]).tobytes()
            found = [made.get(k, (None, None)) if len(s) else (None, None) for k, s in zip(keys, sets, strict=True)]
            yield _batch(_SKETCH, docs[lo : lo + 250], [len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys], [r for r, _ in found], [g for _, g in found])


@trimmed
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
        packed = np.ascontiguousarray(regs).view(np.uint64)[:, :, 0]
        band = join(mix(packed), mix(np.arange(BANDS, dtype=np.uint64))[None, :])
        yield _batch(_BAND, band.ravel().view(np.int64), np.repeat(batch.column(0).to_numpy(), BANDS))


class _Cell:
    """Members of a bucket, in blocks: those held, and a union-find over their components and those that stream past."""

    def __init__(self):
        self.rows: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # component, n, signature, set
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def top(self, component: int) -> int:
        while (up := self.parent.get(component, component)) != component:
            component = up
        return component

    def freeze(self, within: bool) -> None:
        """No more members are held; those that are, are compared with each other."""
        self.n = np.array([r[1] for r in self.rows], np.int64)
        self.signature = np.stack([r[2] for r in self.rows]) if self.rows else np.zeros((0, REGISTERS // 16), np.uint64)
        self.tops = np.array([r[0] for r in self.rows], np.int64)
        if within:
            for i, r in enumerate(self.rows):
                self.meet(r, i)

    def meet(self, row: tuple[int, int, np.ndarray, np.ndarray], upto: int) -> None:
        """Compares a member with the first ``upto`` held ones of other components, and joins its component with those that are near."""
        component, n, signature, shingles_ = row
        mine = self.top(component)
        m = self.n[:upto]
        j = np.flatnonzero((self.tops[:upto] != mine) & (100 * np.minimum(m, n) >= THRESHOLD * np.maximum(m, n)))
        if not len(j):
            return
        x = self.signature[j] ^ signature
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        equal = REGISTERS - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
        near = equal >= (LEAST_SHARP + (1 - LEAST_SHARP) / 16) * REGISTERS  # unequal registers agree in one of 16 cases
        j = j[near][np.argsort(-equal[near], kind="stable")]
        while len(j):
            some, j = j[:TRIED], j[TRIED:]
            sets = [self.rows[k][3] for k in some.tolist()]
            whole = np.concatenate(sets)
            at = np.minimum(np.searchsorted(shingles_, whole), len(shingles_) - 1)
            both = np.add.reduceat(shingles_[at] == whole, np.append(0, np.cumsum([len(s) for s in sets])[:-1]), dtype=np.int64)
            for k in some[100 * both >= THRESHOLD * (n + self.n[some] - both)].tolist():
                other = int(self.tops[k])
                if other != mine:
                    self.links.append((component, self.rows[k][0]))
                    self.parent[other] = mine
                    self.tops[self.tops == other] = mine
            j = j[self.tops[j] != mine]


@trimmed
def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, k, within, streams, component, signature, shingles), in order -> pairs of components that a link joins.

    A cell's held members come before those that stream past them.
    """
    cell, now, frozen, within = _Cell(), None, False, False
    for batch in batches:
        for band, i, k, inside, streams, component, signature, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (band, i, k) != now:
                if not frozen:
                    cell.freeze(within)
                if cell.links:
                    yield _batch(_PAIR, *zip(*cell.links, strict=True))
                cell, now, frozen, within = _Cell(), (band, i, k), False, inside
            row = (component, len(data) // 8, np.frombuffer(signature, np.uint64), np.frombuffer(data, np.uint64))
            if not streams:
                cell.rows.append(row)
                continue
            if not frozen:
                cell.freeze(within)
                frozen = True
            cell.meet(row, len(cell.rows))
    if not frozen:
        cell.freeze(within)
    if cell.links:
        yield _batch(_PAIR, *zip(*cell.links, strict=True))


@trimmed
def _send_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the cells that they are in -> one row per cell."""
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for text, component, signature, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = shingles(text).tobytes()
            for x in cells:
                out.append((x["band"], x["i"], x["k"], x["within"], x["streams"], component, signature, s))
                size += len(s) + len(signature)
                if size > 4 << 20:
                    yield _batch(_MEMBER, *zip(*out, strict=True))
                    out, size = [], 0
        if out:
            yield _batch(_MEMBER, *zip(*out, strict=True))


@trimmed
def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BANDED) for i in (2, 3))
        keep = np.zeros(len(a), bool)
        n_a, n_b = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        for lo in range(0, len(a), 2_000):
            part = slice(lo, lo + 2_000)
            keep[part] = estimate(a[part], b[part], n_a[part], n_b[part]) >= LEAST_ESTIMATE
        yield batch.select([0, 1]).filter(pa.array(keep))


@trimmed
def _among(bits: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose document has its bit set: all that are wanted, and by chance a few others, which the join drops."""
    for batch in batches:
        h = mix(batch.column(0).fill_null(0).to_numpy().view(np.uint64)) & np.uint64((1 << BITS) - 1)
        yield batch.filter(pa.array((bits[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> words of the bitmap with their bits."""
    schema = pa.schema([("line", pa.int64()), ("bit", pa.int64())])
    for batch in batches:
        h = mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64((1 << BITS) - 1)
        yield _batch(schema, (h >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (h & np.uint64(63))).view(np.int64))


@trimmed
def _send_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the chunks that want their set -> one row per chunk."""
    schema = pa.schema([("a", pa.int64()), ("chunk", pa.int64()), ("member", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = shingles(text).tobytes()
            for x in wanted:
                out.append((x["a"], x["chunk"], doc if x["member"] else None, s))
                size += len(s)
            if size > 4 << 20:
                yield _batch(schema, *zip(*out, strict=True))
                out, size = [], 0
        if out:
            yield _batch(schema, *zip(*out, strict=True))


@trimmed
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk, the first set of the pairs before the members -> pairs that are linked."""
    now, first = None, np.zeros(0, np.uint64)
    for batch in batches:
        links = []
        for a, chunk, member, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = np.frombuffer(data, np.uint64)
            if member is None:
                now, first = (a, chunk), s
            elif now == (a, chunk):
                both = len(np.intersect1d(first, s, assume_unique=True))
                if 100 * both >= THRESHOLD * (len(first) + len(s) - both):
                    links.append((a, member))
        if links:
            yield _batch(_PAIR, *zip(*links, strict=True))


def connected_components(links: DataFrame) -> DataFrame:
    """(doc, component) of all documents in ``links`` (a, b); component is the smallest reachable id.

    Alternates between tying each vertex's larger and its smaller neighbours to the smallest one, until nothing
    changes: a number of rounds that grows with the logarithm of the longest path. Minima are aggregated before they are shuffled.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("doc"), F.col("v").alias("component"))).distinct()


def _cells(marked: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc, cells) of all members of buckets with several components.

    Members outside a bucket's largest component are held, in A blocks; those of the largest stream, in S slices. Cell (i, k) with
    k < A compares block i with block k, cell (i, A + s) compares block i with slice s; with one block, its members meet there too.
    """
    parts = marked.join(sizes, "doc").groupBy("band", "component").agg(F.count("*").alias("size"), F.sum("n").alias("elements"))
    of_band = parts.groupBy("band").agg(F.count("*").alias("c"), F.sum("size").alias("size"), F.sum("elements").alias("elements"), F.max(F.struct("size", "component", "elements")).alias("top")).where("c > 1")
    blocks = F.greatest(F.ceil((F.col("size") - F.col("top.size")) / HELD), F.ceil((F.col("elements") - F.col("top.elements")) * 8 / HELD_BYTES)).cast("int")
    plan = of_band.select("band", F.col("top.component").alias("largest"), blocks.alias("A"), F.ceil(F.col("top.size") / STREAMED).cast("int").alias("S"))
    member = marked.join(plan, "band").withColumn("streams", F.col("component") == F.col("largest"))
    mine = F.pmod(F.xxhash64("doc", "band"), F.when(F.col("streams"), F.col("S")).otherwise(F.col("A"))).cast("int")

    def cell(i, k, within):
        return F.struct(F.col("band"), i.cast("int").alias("i"), k.cast("int").alias("k"), within.alias("within"), F.col("streams"))

    counted = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    slices = F.transform(counted("S"), lambda s: cell(F.col("mine"), F.col("A") + s, (F.col("A") == 1) & (s == 0)))
    # a member meets the other blocks' members in the cell of the two blocks, in which one of them streams
    others = F.transform(counted("A"), lambda b: F.struct(F.col("band"), F.least("mine", b).alias("i"), F.greatest("mine", b).alias("k"), (F.col("mine") == b).alias("within"), (b < F.col("mine")).alias("streams")))
    held = F.when(F.col("A") == 1, slices).otherwise(F.concat(slices, others))
    streamed = F.transform(counted("A"), lambda b: cell(b, F.col("A") + F.col("mine"), (F.col("A") == 1) & (F.col("mine") == 0)))
    listed = member.withColumn("mine", mine).select("doc", F.explode(F.when(F.col("streams"), streamed).otherwise(held)).alias("cell"))
    return listed.groupBy("doc").agg(F.collect_list("cell").alias("cells"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    sketches = stored(texts.mapInArrow(_sketch, "doc long, n long, k1 long, k2 long, regs binary, signature binary"))
    full = sketches.where("doc is not null and n > 0")
    classes = stored(full.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc", "regs", "signature")).alias("x")).select("x.*", "n", "k1", "k2"))
    bands = classes.select("doc", "regs").mapInArrow(_bands, "band long, doc long")
    firsts = bands.groupBy("band").agg(F.min("doc").alias("first"), F.count("*").alias("size")).where("size > 1").select("band", "first")
    crowded = stored(bands.join(firsts, "band").select("band", "doc", "first"))

    def likely(pairs: DataFrame) -> DataFrame:
        a = classes.select(F.col("doc").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
        b = classes.select(F.col("doc").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
        sized = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb"))
        return sized.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_likely, "a long, b long")

    def among(wanted: DataFrame) -> DataFrame:
        """The documents whose texts are wanted, and by chance a few others."""
        bits = np.zeros(1 << (BITS - 6), np.uint64)  # at most as many rows come to the driver
        for r in wanted.select("doc").mapInArrow(_bits, "line long, bit long").groupBy("line").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
            bits[r["line"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
        shared = spark.sparkContext.broadcast(bits)
        return texts.mapInArrow(lambda b: _among(shared.value, b), "doc long, text string")

    def verified(pairs: DataFrame) -> DataFrame:
        sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"), F.col("b").alias("doc"), F.lit(True).alias("member"))
        firsts = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("doc"), F.lit(False).alias("member"))
        wanted = stored(members.unionByName(firsts).groupBy("doc", F.floor(F.col("chunk") / CHUNKS).alias("part")).agg(F.collect_list(F.struct("a", "chunk", "member")).alias("wanted")))
        sets = among(wanted).join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_send_sets, "a long, chunk long, member long, shingles binary")
        dealt = sets.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("member").asc_nulls_first())
        return dealt.mapInArrow(_verify, "a long, b long")

    starred = likely(crowded.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct())
    components = cut(connected_components(stored(verified(stored(starred)))))
    # buckets that still hold several components
    marked = crowded.select("band", "doc").join(components, "doc", "left").select("band", "doc", F.coalesce("component", "doc").alias("component"))
    cells = stored(_cells(marked, classes.select("doc", "n")))
    joined = cells.join(classes.select("doc", "signature"), "doc").join(components, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    members = among(cells).join(joined, "doc").select("text", "component", "signature", "cells")
    sent = members.mapInArrow(_send_members, "band long, i int, k int, within boolean, streams boolean, component long, signature binary, shingles binary")
    dealt = sent.repartition("band", "i", "k").sortWithinPartitions("band", "i", "k", "streams")
    more = stored(dealt.mapInArrow(_settle, "a long, b long").distinct())
    if not more.isEmpty():
        above = connected_components(more).select(F.col("doc").alias("component"), F.col("component").alias("above"))
        components = cut(components.unionByName(more.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(components, "doc", "left_anti").select("doc", F.col("doc").alias("component"))))
        components = cut(components.join(above, "component", "left").select("doc", F.coalesce("above", "component").alias("component")))
    of_class = classes.join(components, "doc", "left").select("k1", "k2", "n", F.coalesce("component", "doc").alias("c"))
    joined = sketches.select("doc", "n", "k1", "k2").join(of_class, ["k1", "k2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("c", "doc")).otherwise(F.col("doc"))
    return joined.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), component).alias("component_id"),
        F.when(F.col("doc").isNotNull(), F.col("doc") == component).otherwise(True).alias("kept"),
    )
