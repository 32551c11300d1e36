"""Vector code compression: each of a vector's parts becomes the number of its nearest codebook entry.

Components are integers. A task puts the distinct parts of a block of rows in lexicographic order, which is a trie, and goes through
it depth first: parts that begin alike share the vector of distances to all entries over these dimensions, so each node adds one
dimension once. A leaf takes the least of its distances, and adds its part, times its copies, to the sums of that entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import small_batches, stored, trimmed

#: Components beyond this are taken as this: distances and sums stay exact in 64 bits.
LARGEST = 1 << 24
#: Rows of a block, whose distinct parts make a trie, and leaves that are finished a level at a time: 64 distances each.
BLOCK_ROWS, LEAVES = 1 << 14, 1 << 10


@dataclass(frozen=True)
class Codebooks:
    """``books[p]`` holds the entries of part p, as rows of integers; vectors have ``width`` components, of which ``scale`` times the value is floored."""

    books: list[np.ndarray]
    width: int
    scale: int

    @property
    def bounds(self) -> list[tuple[int, int]]:
        n = len(self.books)
        return [(p * self.width // n, (p + 1) * self.width // n) for p in range(n)]

    def digest(self) -> str:
        """sha256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, copies of each, for each given row its place among them)."""
    if not parts.shape[1]:
        return parts[:1], np.array([len(parts)]), np.zeros(len(parts), np.int64)
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(new) - 1
    return rows[new], np.diff(np.concatenate([np.flatnonzero(new), [len(parts)]])), place


def nearest_entries(leaves: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the distinct parts, in lexicographic order: its nearest entry (ties: the lower) and the squared distance to it."""
    n, depth = leaves.shape
    code, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    departs = np.argmax(leaves[1:] != leaves[:-1], axis=1) if depth else np.zeros(max(n - 1, 0), np.int64)  # where a leaf leaves its predecessor's path
    todo = [(0, n, 0, np.zeros(len(book), np.int64))]  # leaves lo to hi share their first d dimensions, whose distances are in `shared`
    while todo:
        lo, hi, d, shared = todo.pop()
        if hi - lo <= LEAVES or d == depth:
            nodes, at = shared[None, :], np.zeros(hi - lo, np.int64)  # the nodes of this level, and that of each leaf
            for level in range(d, depth):
                first = np.concatenate([[True], departs[lo : hi - 1] <= level])
                nodes = nodes[at[first]] + (leaves[lo:hi, level][first][:, None] - book[None, :, level]) ** 2
                at = np.cumsum(first) - 1
            nodes = nodes[at]
            code[lo:hi] = nodes.argmin(axis=1)
            least[lo:hi] = np.take_along_axis(nodes, code[lo:hi, None], axis=1)[:, 0]
            continue
        starts = np.concatenate([[lo], lo + 1 + np.flatnonzero(departs[lo : hi - 1] <= d), [hi]])
        run = lo  # small children next to each other are taken as one run
        for a, b in zip(starts[:-1], starts[1:]):
            if b - run > LEAVES and run < a:
                todo.append((run, a, d, shared))
                run = a
            if b - a > LEAVES:
                todo.append((a, b, d + 1, shared + (leaves[a, d] - book[:, d]) ** 2))
                run = b
        if run < hi:
            todo.append((run, hi, d, shared))
    return code, least


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    held, n = [], 0

    def block():
        rows = pa.Table.from_batches(held)
        values = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return rows, integers(values, scale).reshape(-1, width)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield block()
            held, n = [], 0
    if n:
        yield block()


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with a vector whose components are all finite."""
    return vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))


def commonest_width(vectors: DataFrame) -> int | None:
    found = vectors.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return found["width"] if found else None


def first_codebooks(vectors: DataFrame, width: int, n_parts: int, n_entries: int, scale: int) -> Codebooks:
    """The parts of the rows with the smallest ids (equal ids: by their vectors; null ids last)."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(n_entries).collect()
    x = integers(np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), width), scale)
    empty = Codebooks([np.zeros((0, 0), np.int64)] * n_parts, width, scale)
    return Codebooks([np.ascontiguousarray(x[:, a:b]) for a, b in empty.bounds], width, scale)


def improved(vectors: DataFrame, codes: Codebooks) -> Codebooks:
    """One round: parts go to their nearest entry, and an entry becomes the floor of the mean of its parts; unused ones stay.

    A task sends the sums of its rows, one number for each component of each entry, so what is shuffled doesn't grow with the rows of a task.
    """

    @trimmed
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(book), book.shape[1] + 1), np.int64) for book in codes.books]  # the last column counts
        for _, x in _blocks(batches, codes.width, codes.scale):
            for book, total, (a, b) in zip(codes.books, totals, codes.bounds):
                leaves, copies, _ = distinct_parts(x[:, a:b])
                code, _ = nearest_entries(leaves, book)
                weighted = np.column_stack([leaves * copies[:, None], copies])
                for d in range(weighted.shape[1]):
                    total[:, d] += np.bincount(code, weighted[:, d], len(book)).astype(np.int64)  # below 2^53, so exact
        for p, total in enumerate(totals):
            used = np.flatnonzero(total[:, -1])
            entry, place = np.repeat(used, total.shape[1]), np.tile(np.arange(total.shape[1]), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p)), pa.array(entry), pa.array(place), pa.array(total[entry, place])], ["part", "entry", "place", "total"])

    parts = vectors.select("embedding").mapInArrow(sums, "part long, entry long, place long, total long")
    found = {(r["part"], r["entry"], r["place"]): r["total"] for r in parts.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()}
    books = [book.copy() for book in codes.books]
    for p, book in enumerate(books):
        for e in range(len(book)):
            if n := found.get((p, e, book.shape[1])):
                book[e] = [found[p, e, d] // n for d in range(book.shape[1])]
    return Codebooks(books, codes.width, codes.scale)


def encode(vectors: DataFrame, codes: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error: each vector's nearest entries and its squared distance to them."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), "S2")
        for rows, x in _blocks(batches, codes.width, codes.scale):
            error, text = np.zeros(len(x), np.int64), np.zeros((len(x), len(codes.books)), "S2")
            for p, (book, (a, b)) in enumerate(zip(codes.books, codes.bounds)):
                leaves, _, place = distinct_parts(x[:, a:b])
                code, least = nearest_entries(leaves, book)
                error += least[place]
                text[:, p] = digits[code[place]]
            out = rows.select(["vec_id", "label"]).append_column("code", pa.array([t.tobytes().decode() for t in text])).append_column("error", pa.array(error))
            yield from out.combine_chunks().to_batches()

    kept = vectors.select("vec_id", "label", "embedding")
    return kept.mapInArrow(run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long")


def fit(vectors: DataFrame, n_parts: int = 16, n_entries: int = 64, scale: int = 256, rounds: int = 2) -> Codebooks | None:
    """Codebooks of at most 256 entries; fewer usable rows than entries make as many entries. None if there is no usable row."""
    if not 0 < n_entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    small_batches(vectors.sparkSession)
    vectors = usable(vectors)
    width = commonest_width(vectors)
    if width is None:
        return None
    vectors = vectors.where(F.size("embedding") == width)
    codes = first_codebooks(vectors, width, n_parts, n_entries, scale)
    for _ in range(rounds):
        codes = improved(vectors, codes)
    return codes


def compress(vectors: DataFrame, codes: Codebooks | None) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for each usable row; ``label_error`` sums the errors of a label, nulls together.

    Null vectors and those with a null or non-finite component take no part, nor do vectors of another width than the commonest (of equally common
    ones, the smaller). A width that isn't a multiple of the parts is cut at its multiples, rounded down. Components beyond 2^24 after scaling
    count as 2^24. Repeated rows are coded each; an empty table gives no rows. Only vec_id, label and embedding are read; without a column label, all labels are null.
    """
    if "label" not in vectors.columns:
        vectors = vectors.withColumn("label", F.lit(None).cast("string"))
    spark = vectors.sparkSession
    small_batches(spark)
    if codes is None:
        kept = vectors.select("vec_id", "label").where(F.lit(False))
        return kept.withColumns({"code": F.lit(""), "error": F.lit(0).cast("long"), "label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")})
    coded = stored(encode(usable(vectors).where(F.size("embedding") == codes.width), codes))
    of_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(of_label, coded["label"].eqNullSafe(of_label["of"])).drop("of").withColumn("codebooks_sha256", F.lit(codes.digest()))
