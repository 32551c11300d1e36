"""Operator 4, approximate nearest neighbours by a forest of random-projection trees.

1. The trees are fitted on the driver, on a bounded sample of the vectors. For inner products, they see vectors with
   one more component that gives them all the same norm. On the sample, by brute force, it is measured how many leaves a
   query must visit for the wanted recall: few for clustered vectors, most for those without any structure. Trees are as
   deep as they can be while queries, each sent to that many leaves, cost no more than the rows, each sent to one leaf of a tree.
2. A query walks all trees through one shared priority queue, nearest cell first, until it has visited that many leaves, and
   more while these hold fewer than k + 1 rows of the sample. The best such rows of the first leaves give a floor: the score
   that a neighbour has at least.
3. Every row goes to its leaf of each tree, and a query to the leaves that it visits and to no others. A leaf is a cell: its rows
   stream past its queries and are scored exactly, and those above a query's floor come out, at most k + 1 a query. A leaf
   with many rows is dealt out in slices, one with many queries in parts; a leaf that no query visits gets no rows.
4. The best of all its leaves are a query's neighbours.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do those of another length than
most have (of lengths that are as frequent, the largest), since no inner product with them is defined. Rows that repeat an id
and its vector count once; of several vectors of one id, the smallest is the query, and the best counts as a candidate. Of
equal vectors, the index holds one with the k + 1 smallest ids, which is all that a result can show, so a vector that fills the
table doesn't fill a leaf. Ties go to the smaller id. Fewer candidates than k give as many rows; empty tables, or
ones without usable vectors, give none. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import hash_share, small_batches, stored

#: Rows that are scored, or routed, at once.
ROWS = 2_048
#: Rows of the sample that give a query's floor, and rows that are scored at the price of sending one.
FLOOR_ROWS, ROWS_A_SEND = 1_024, 4_096


class Forest:
    """Trees as arrays: node n has children 2n and 2n + 1; leaves are the nodes of the last level, numbered from 0."""

    def __init__(self, sample: np.ndarray, n_rows: int, trees: int, leaf_rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.top = float(np.square(sample, dtype=float).sum(axis=1).max(initial=0))
        points = self.lift(sample)
        most = max(0, int(np.log2(max(1, len(sample) / 4))))
        self.depth = min(most, max(0, round(np.log2(max(1, n_rows / leaf_rows)))))
        self.trees, self.leaves_a_tree = trees, 1 << self.depth
        width = points.shape[1] if len(points) else 1
        self.normals = np.zeros((trees, 1 << self.depth, width), np.float32)
        self.offsets = np.zeros((trees, 1 << self.depth), np.float32)
        for t in range(trees):
            cells = {1: np.arange(len(points))}
            for node in range(1, 1 << self.depth):
                rows = cells.pop(node)
                normal, offset = self._split(points[rows], rng)
                right = points[rows] @ normal > offset
                cells[2 * node], cells[2 * node + 1] = rows[~right], rows[right]
                self.normals[t, node], self.offsets[t, node] = normal, offset
        self.sample = sample
        self._gather()

    def _gather(self) -> None:
        """The rows of the sample by leaf."""
        at = self.leaves(self.sample)
        self.order = (np.argsort(at.ravel(), kind="stable") // self.trees).astype(np.int32)
        self.bounds = np.searchsorted(np.sort(at.ravel()), np.arange(self.trees * self.leaves_a_tree + 1))

    def prune(self, depth: int) -> None:
        """Make the nodes of level ``depth`` leaves."""
        self.depth, self.leaves_a_tree = depth, 1 << depth
        self.normals, self.offsets = self.normals[:, : 1 << depth].copy(), self.offsets[:, : 1 << depth].copy()
        self._gather()

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Adds the component that gives rows the norm of the longest; rows longer than that get 0."""
        rest = np.sqrt(np.maximum(0, self.top - np.square(x, dtype=float).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)

    @staticmethod
    def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        """A random two-means direction, cut at the median."""
        if len(points) < 2:
            return np.zeros(points.shape[1]), 0.0
        near = points[rng.choice(len(points), min(len(points), 256), replace=False)]
        a, b = near[:2]
        for _ in range(5):
            side = near @ (a - b) > (a @ a - b @ b) / 2
            if side.all() or not side.any():
                break
            a, b = near[side].mean(axis=0), near[~side].mean(axis=0)
        normal = a - b
        length = np.linalg.norm(normal)
        normal = normal / length if length > 0 else rng.normal(size=len(normal))
        return normal, float(np.median(points @ normal))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """[row, tree]: the leaf of each row in each tree; trees are numbered through."""
        points = self.lift(x.astype(np.float32))  # rows go where their like in the sample went
        at = np.ones((len(x), self.trees), np.int64)
        for t in range(self.trees):
            for _ in range(self.depth):
                n = at[:, t]
                at[:, t] = 2 * n + (np.einsum("ij,ij->i", points, self.normals[t, n]) > self.offsets[t, n])
        return at - self.leaves_a_tree + np.arange(self.trees) * self.leaves_a_tree

    def margins(self, q: np.ndarray) -> np.ndarray:
        """[tree, node]: how far a query lies beyond each cut."""
        # among points of equal norm, the nearest to a query is the nearest to it at that norm
        norm = np.linalg.norm(q)
        point = np.append(q * (np.sqrt(self.top) / norm if norm > 0 else 0), 0).astype(np.float32)
        return self.normals @ point - self.offsets

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """All leaves in the order of a query's shared queue, nearest first."""
        margins = self.margins(q).tolist()
        queue = [(0.0, t, 1) for t in range(self.trees)]
        last = self.leaves_a_tree
        while queue:
            far, t, n = heapq.heappop(queue)
            while n < last:
                m = margins[t][n]
                heapq.heappush(queue, (max(far, m), t, 2 * n) if m > 0 else (max(far, -m), t, 2 * n + 1))
                n = 2 * n + (m > 0)
            yield n - last + t * last

    def ask(self, q: np.ndarray, wanted: int, k: int) -> tuple[list[int], float]:
        """The leaves that a query visits, and its floor: k rows other than its own, in these leaves, score no less."""
        out, rows, floor = [], np.zeros(0, np.int32), -np.inf
        for leaf in self.visits(q):
            if len(out) >= wanted and len(rows) > k:
                break
            out.append(leaf)
            if len(rows) < FLOOR_ROWS:
                rows = np.union1d(rows, self.order[self.bounds[leaf] : self.bounds[leaf + 1]])
        if len(rows) > k:
            floor = float(np.partition(self.sample[rows].astype(float) @ q, -k - 1)[-k - 1])
            floor -= 1e-6 * float(np.linalg.norm(q)) * self.top**0.5  # the sample is in single precision
        return out, floor

    def turns(self, q: np.ndarray) -> np.ndarray:
        """The turn at which each leaf comes up in the queue, for all leaves at once: by the widest margin on its way."""
        margins, far = self.margins(q), np.zeros((self.trees, 1), np.float32)
        for level in range(self.depth):
            m = margins[:, 1 << level : 2 << level]
            far = np.stack([np.maximum(far, m), np.maximum(far, -m)], axis=2).reshape(self.trees, -1)
        out = np.empty(far.size, np.int64)
        out[np.argsort(far.ravel(), kind="stable")] = np.arange(far.size)
        return out

    def fit_visits(self, n_rows: int, n_queries: int, k: int, recall: float, tried: int = 100) -> int:
        """Prune the trees to the depth that suits, and give the leaves that a query must visit there.

        By brute force on the sample: so many that they hold the share ``recall`` of the k nearest.
        """
        step = max(1, len(self.sample) // tried)
        asked = self.sample[::step][:tried]
        at, best = self.leaves(self.sample) % self.leaves_a_tree, []
        for i, q in enumerate(asked):
            s = self.sample.astype(float) @ q.astype(float)
            s[i * step] = -np.inf
            best.append(np.argpartition(-s, min(k, len(s) - 1) - 1)[: min(k, len(s) - 1)])
        deepest = self.depth
        for depth in range(deepest, -1, -1):
            if depth < deepest:
                self.prune(depth)
            where = (at >> (deepest - depth)) + np.arange(self.trees) * self.leaves_a_tree
            turns = np.sort(np.concatenate([np.zeros(0, int), *(self.turns(q)[where[b]].min(axis=1) for q, b in zip(asked, best, strict=True))]))
            wanted = int(turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))))]) + 1 if len(turns) else 1
            if n_queries * wanted <= self.trees * n_rows + n_queries * (wanted / self.leaves_a_tree) * (n_rows / ROWS_A_SEND):
                break
        return wanted


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Cell:
    """The queries of one cell, and the best k + 1 of the rows that have streamed past them."""

    def __init__(self, k: int):
        self.k, self.ids, self.vectors, self.floors, self.q = k, [], [], [], None
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows -> their exact scores with the queries whose floor they reach."""
        if self.q is None:
            self.q = np.concatenate(self.vectors).astype(float) if self.vectors else np.zeros((0, x.shape[1]))
            self.ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
            self.floor = np.concatenate(self.floors) if self.floors else np.zeros(0)
        x = x.astype(float)
        scores = self.q @ x.T
        low = self.floor
        if len(x) > self.k + 1:
            low = np.maximum(low, np.partition(scores, -self.k - 1, axis=1)[:, -self.k - 1])
        finite = np.isfinite(low)
        low = np.where(finite, low - 1e-9 * (1 + np.abs(np.where(finite, low, 0))), -np.inf)  # the last bits may differ from the exact score
        a, c = np.nonzero(scores >= low[:, None])
        exact = np.concatenate([np.zeros(0), *(np.cumsum(self.q[a[i : i + 50_000]] * x[c[i : i + 50_000]], axis=1)[:, -1] for i in range(0, len(a), 50_000))])
        self.best.append((a, ids[c], exact))
        self.n += len(a)
        if self.n > 40 * (self.k + 1) * max(1, len(self.q)):
            self.tidy()

    def tidy(self) -> None:
        a, ids, s = (np.concatenate(x) for x in zip(*self.best, strict=True))
        order = np.lexsort((ids, -s, a))
        a, ids, s = a[order], ids[order], s[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        self.floor[a[rank == self.k]] = s[rank == self.k]
        keep = rank <= self.k
        self.best, self.n = [(a[keep], ids[keep], s[keep])], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.best:
            return None
        self.tidy()
        a, ids, s = self.best[0]
        return self.ids[a], ids, s


def _scan(k: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, query, id, v, floor) in order, a cell's queries first -> (query_id, rep, score)."""
    names = ["query_id", "rep", "score"]
    cell, now = _Cell(k), None
    for batch in batches:
        if not batch.num_rows:
            continue
        where, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        ids, x, floor = batch.column(2).to_numpy(), _matrix(batch.column(3), width), batch.column(4).to_numpy()
        edges = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (query[1:] != query[:-1])))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(where)], strict=True):
            if where[lo] != now:
                if (made := cell.result()) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(y) for y in made], names)
                cell, now = _Cell(k), where[lo]
            if query[lo]:
                cell.ids.append(ids[lo:hi])
                cell.vectors.append(x[lo:hi])
                cell.floors.append(floor[lo:hi])
            else:
                for i in range(lo, hi, ROWS):
                    cell.add(ids[i : min(hi, i + ROWS)], x[i : min(hi, i + ROWS)])
    if (made := cell.result()) is not None:
        yield pa.RecordBatch.from_arrays([pa.array(y) for y in made], names)


def nearest(
    rows: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    trees: int = 4,
    leaf_rows: int = 80,
    recall: float = 0.95,
    sample_rows: int = 50_000,
    sample_values: int = 1 << 22,
    slice_rows: int = 32_768,
    part_queries: int = 1_024,
) -> DataFrame:
    """query_id, rank, ``vec_id`` and score of each query's k nearest rows by inner product.

    queries: a condition that says which rows are queries. The forest is fitted on about ``sample_rows`` rows, taken by a
    hash of the vector, or fewer of wide vectors, so that they have ``sample_values`` components. leaf_rows: the fewest
    rows of a leaf; a tree has at most a fourth as many leaves as the sample has rows. Sample and forest are broadcast, so both bound
    that. recall: what a query's own leaves must hold of its nearest rows, on the sample; their share of all leaves is kept for
    the whole table. slice_rows, part_queries: rows and queries of a cell, on average.
    """
    spark = rows.sparkSession
    small_batches(spark)
    # single precision goes through the shuffle as such; any other type as double
    kind = "float" if rows.schema[vector].dataType.simpleString() == "array<float>" else "double"
    picked = rows.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), queries.alias("is_query"))
    sizes = picked.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("count"), F.count_if("is_query").alias("n_queries"))
    common = sizes.orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    width, n_rows = common["width"], common["count"]
    picked = picked.where(F.size("v") == width)
    of_vector = Window.partitionBy("v")
    distinct = picked.select("id", "v").distinct().withColumn("n", F.row_number().over(of_vector.orderBy("id"))).where(F.col("n") <= k + 1)
    held = distinct.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", F.col("ids")[0].alias("rep"), "ids")

    most = max(2, min(sample_rows, sample_values // width))
    chosen = picked.where(hash_share(F.col("v"), F.lit(-(-most * (1 << 20) // n_rows)))).select("v").limit(2 * most).toArrow()["v"].combine_chunks()
    sample = np.unique(_matrix(chosen, width).astype(np.float32), axis=0)
    np.random.default_rng(3).shuffle(sample)
    forest = Forest(sample, n_rows, trees, leaf_rows)
    wanted = forest.fit_visits(n_rows, max(1, common["n_queries"]), k, recall)
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                yield b.append_column("leaves", pa.array(list(shared.value.leaves(_matrix(b.column(0), width)).astype(np.int32)), pa.list_(pa.int32())))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaves, floors = zip(*(shared.value.ask(q, wanted, k) for q in _matrix(b.column(0), width).astype(float)), strict=True)
                yield b.append_column("leaves", pa.array(leaves, pa.list_(pa.int32()))).append_column("floor", pa.array(floors, pa.float64()))

    index = stored(held.mapInArrow(route, f"v array<{kind}>, rep long, ids array<long>, leaves array<int>"))
    one = picked.where("is_query").groupBy("id").agg(F.min("v").alias("v")).select("v", "id")
    asked = stored(one.repartition("id").mapInArrow(ask, f"v array<{kind}>, id long, leaves array<int>, floor double"))
    # how each visited leaf is dealt out in cells: at most as many rows as the forest has leaves
    n_rows_of, n_queries_of = (df.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count() for df in (index, asked))
    plan, cells = [], 0
    for leaf, n, q in n_rows_of.join(n_queries_of.withColumnRenamed("count", "q"), "leaf").orderBy("leaf").collect():
        slices, parts = -(-n // slice_rows), -(-q // part_queries)
        plan.append((leaf, cells, slices, parts))
        cells += slices * parts
    of_leaf = F.broadcast(spark.createDataFrame(plan, "leaf int, base long, slices int, parts int"))

    def dealt(df: DataFrame, is_query: bool) -> DataFrame:
        """For each of its leaves, a row goes to its slice in all parts, and a query to its part in all slices."""
        own, others = ("parts", "slices") if is_query else ("slices", "parts")
        there = df.select("id", "v", "floor", F.explode("leaves").alias("leaf")).join(of_leaf, "leaf")
        there = there.withColumn(own[:-1], F.pmod(F.xxhash64("id", "leaf"), own)).withColumn(others[:-1], F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return there.select((F.col("base") + F.col("slice") * F.col("parts") + F.col("part")).alias("cell"), F.lit(is_query).alias("query"), "id", "v", "floor")

    met = dealt(asked, True).unionByName(dealt(index.select(F.col("rep").alias("id"), "v", "leaves", F.lit(0.0).alias("floor")), False))
    found = met.repartition("cell").sortWithinPartitions("cell", F.desc("query")).mapInArrow(lambda b: _scan(k, width, b), "query_id long, rep long, score double")
    scored = found.distinct().join(index.select("rep", "ids"), "rep").select("query_id", "score", F.explode("ids").alias("id")).where("id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
