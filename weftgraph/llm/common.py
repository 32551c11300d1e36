"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Rows and bytes of one Arrow batch handed to a Python worker, so that a batch of long texts stays small.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20
#: Characters that a worker handles at once in numpy; a longer text is a slice of its own.
SLICE_CHARS = 400_000


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, unless the session already has smaller bounds."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, and an error otherwise."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftgraph-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: lineage ends, and lost executors do no harm. For small rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there: as ``cut``, but compact."""
    path = f"{shared_folder(df.sparkSession)}/weftgraph-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column | str, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo the folds; of four, remainder 2 is held out from every fit. A null id gives 0."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def as_row(docs: DataFrame) -> Column:
    """All columns, whatever their names, as one struct ``row``."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def beside_row(rows: DataFrame, name: str, made: str) -> StructType:
    """The schema of ``rows``' struct ``row`` and of a column that is made beside it."""
    return StructType([rows.schema["row"], StructField(name, DataType.fromDDL(made))])


def from_row(found: DataFrame, columns: list[str], made: str) -> DataFrame:
    """The columns of the struct ``row``, and the one that was made, which takes the place of one of the same name."""
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in columns if c != made], made)


def hash_share(key: Column, numerator: Column, denominator: int = 1 << 20) -> Column:
    """A deterministic sample: true for about numerator / denominator of the keys."""
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(denominator)) < numerator


def slices(lengths: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with at most ``limit`` characters each, or one text."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def trimmed(batches_of: Callable) -> Callable:
    """A generator function that, when it ends, gives the memory that its worker has freed back to the system.

    Workers are used again by later stages; what the allocators keep would add up beside the executor's own memory.
    """

    @wraps(batches_of)
    def run(*args, **named):
        try:
            yield from batches_of(*args, **named)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only the GNU C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


class Memo(dict):
    """A dict that computes missing values by ``make``, and is emptied when what it holds exceeds ``limit`` bytes.

    It may be emptied at any lookup, so a worker's memory is bounded within one long text too; results don't depend on it.
    Sizes are those of keys and values themselves, with 120 bytes for an entry of the table.
    """

    def __init__(self, make: Callable, limit: int = 16 << 20):
        super().__init__()
        self.make, self.limit, self.used = make, limit, 0

    def __missing__(self, key):
        value = self.make(key)
        self.used += 120 + getsizeof(key) + getsizeof(value)
        if self.used > self.limit:
            self.clear()
            self.used = 0
        self[key] = value
        return value


class WordTable:
    """Rows of floats for words, each computed once by ``vector``; emptied between parts of a text beyond ``limit`` bytes."""

    #: Words that are looked up at once.
    PART = 50_000

    def __init__(self, vector: Callable[[str], tuple[float, ...]], width: int, limit: int = 64 << 20):
        self.vector, self.width, self.limit = vector, width, limit
        self.clear()

    def clear(self) -> None:
        self.row, self.rows, self.used = Memo(self._new, 1 << 62), np.zeros((1024, self.width)), 0

    def _new(self, word: str) -> int:
        n = len(self.row)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n] = self.vector(word)
        self.used += 8 * self.width
        return n

    def parts(self, words: list[str]) -> Iterator[np.ndarray]:
        """The rows of the words, part by part."""
        for a in range(0, len(words), self.PART):
            if self.row.used + self.used > self.limit:
                self.clear()
            some = words[a : a + self.PART]
            at = np.fromiter(map(self.row.__getitem__, some), np.int64, len(some))  # before the rows are read: they may move
            yield self.rows[at]

    def of(self, words: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros((0, self.width)), *self.parts(words)])


_MADE: dict = {}


def drop_made() -> None:
    """Lets go of what an earlier stage has kept in this Python worker."""
    _MADE.clear()


def per_worker(key, make: Callable):
    """What ``make`` gives, made once in this Python worker for ``key`` and kept for its later tasks.

    Only the last one is kept, so a worker that serves many jobs doesn't grow.
    """
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]
