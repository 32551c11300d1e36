"""Sort, limit and set operations: pages are top-k plans, not sorts of the whole table, and deep ones are found by counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from weftgraph.operators.expand import undirected
from weftgraph.schema import Graph, checkpointed

PAGE = 200


#: Rows before a page that one task may have to skip; farther pages are located by counts.
SHALLOW = 10_000
#: Stretches in which rows are counted at once.
STRETCHES = 4_096
#: A key after all others.
LAST = 1 << 62


def _compared(keys: list[Column], at: list[int], before: bool) -> Column:
    """Rows before a place in the order of the keys, or from there on."""
    test = F.lit(not before)
    for key, value in zip(reversed(keys), reversed(at)):
        test = (key < value if before else key > value) | ((key == value) & test)
    return test


def _located(rows: DataFrame, keys: list[Column], offset: int) -> tuple[list[int], int] | None:
    """(keys of the row after ``offset`` others, how many of the rows with just these keys come before it); None if there are no more rows.

    Keys are bigints, in ascending order. Rows are counted in equal stretches of the first key, then of the stretch in which the row is, until it holds
    few; rows with an equal key are told apart by the next one. Each step is one aggregation over the rows of a stretch.
    """
    found: list[int] = []
    for i, key in enumerate(keys):
        low, high = rows.agg(F.min(key), F.max(key)).first()
        if low is None:
            return None
        while low < high:
            width = (high - low) // STRETCHES + 1
            counts = rows.groupBy(F.call_function("div", key - low, F.lit(width)).alias("stretch")).count().collect()
            for stretch, inside in sorted(counts):
                if offset < inside:
                    break
                offset -= inside
            else:
                return None
            low, high = low + stretch * width, min(high, low + (stretch + 1) * width - 1)
            rows = rows.where((key >= low) & (key <= high))
            if inside <= SHALLOW:
                names = [f"k{j}" for j in range(i, len(keys))]
                row = rows.select(*[k.alias(n) for k, n in zip(keys[i:], names)]).orderBy(*names).offset(offset).limit(1).first()
                return [*found, *row], offset - rows.where(_compared(keys[i:], list(row), before=True)).count()
        rows = rows.where(key == low)
        found.append(low)
    return found, offset


def page(rows: DataFrame, keys: list[Column], offset: int, limit: int) -> DataFrame:
    """The rows of one page, in ascending order of the keys, which are bigints. A deep page is found by counts first, so no task holds the rows before it."""
    if offset <= SHALLOW:
        return rows.orderBy(*keys).offset(offset).limit(limit)
    at = _located(rows, keys, offset)
    if at is None:
        return rows.limit(0)
    rest = rows.where(_compared(keys, at[0], before=False)).orderBy(*keys)
    return (rest.offset(at[1]) if at[1] else rest).limit(limit)


def page_nodes(g: Graph, graph: str, ids: list[int] | None = None, search: str | None = None, label: str | None = None, offset: int = 0, limit: int = PAGE, after: int | None = None) -> DataFrame:
    """Nodes of a graph by ids, case-sensitive prefix of the name and label, in order of id; ``after`` an id, to go on from the last one seen."""
    found = g.nodes.where(F.col("graph") == graph)
    found = found.where(F.col("id").isin(ids)) if ids else found
    found = found.where(F.startswith("name", F.lit(search))) if search else found
    found = found.where(F.col("label") == label) if label else found
    found = found.where(F.col("id") > after) if after is not None else found
    return page(found, [F.col("id")], offset, limit)


def latest_nodes(g: Graph, graph: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """Newest first, undated ones last; ties by id."""
    age = F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(LAST))
    return page(g.nodes.where(F.col("graph") == graph), [age, F.col("id")], offset, limit)


def page_edges(g: Graph, graph: str, with_self: bool | None = None, offset: int = 0, limit: int = PAGE, after: tuple[int, int] | None = None, stored: bool = False) -> DataFrame:
    """Edges in both orientations (left_id, right_id), in order of id and left_id; self loops once, and only if asked for. ``after``: the id and left_id last seen.

    Both ends of a deep page are located on keys alone, so just the edges of the page are derived with what is asked of them.
    ``stored``: the edges are read from where they are stored, and their keys needn't be."""
    edges, keys = g.edges.where(F.col("graph") == graph), [F.col("id"), F.col("left_id")]
    edges = edges if with_self else edges.where("src <> dst")

    def both(edges: DataFrame) -> DataFrame:
        rows = undirected(edges)
        return rows if after is None else rows.where(_compared(keys, list(after), before=False) & ~((keys[0] == after[0]) & (keys[1] == after[1])))

    if offset <= SHALLOW:
        return page(both(edges), keys, offset, limit)
    ends = edges.select("id", "src", "dst")
    ends = both(ends if stored else derived_once(g, ends))  # counted several times
    at = _located(ends, keys, offset)
    if at is None:
        return both(edges).limit(0)
    of_page = ends.where(_compared(keys, at[0], before=False)).select(*keys).orderBy(*keys).limit(at[1] + limit)
    rest = both(edges.where(F.col("id").between(at[0][0], of_page.agg(F.max("id")).first()[0])))
    rest = rest.where(_compared(keys, at[0], before=False)).orderBy(*keys)
    return (rest.offset(at[1]) if at[1] else rest).limit(limit)


def derived_once(g: Graph, edges: DataFrame) -> DataFrame:
    """Edges of the graph that are used several times: as they are, if the graph is stored, else written and read from there."""
    return edges if g.sides else checkpointed(edges)


def page_concat(sets: list[DataFrame], order: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page over the concatenation of several sets, each in the order of a column; of a column of numbers, a deep page is found by counts."""
    numbered = reduce(DataFrame.unionByName, [s.withColumn("set_no", F.lit(i)) for i, s in enumerate(sets)])
    if isinstance(numbered.schema[order].dataType, IntegralType):
        return page(numbered, [F.col("set_no").cast("long"), F.coalesce(F.col(order).cast("long"), F.lit(-LAST))], offset, limit)
    return numbered.orderBy("set_no", order).offset(offset).limit(limit)


def union_paths(paths: list[DataFrame], dedupe: bool = False) -> DataFrame:
    """All rows of several path results; dedupe on start, end and edges."""
    out = reduce(DataFrame.unionByName, paths)
    return out.dropDuplicates(["graph", "start_id", "end_id", "edge_ids"]) if dedupe else out


def tag_intersection(tags: DataFrame) -> DataFrame:
    """Pairs of categories that share tags, and how many: by an equi-join on the tag."""
    a, b = tags.select(F.col("category_id").alias("left_id"), "tag"), tags.select(F.col("category_id").alias("right_id"), "tag")
    return a.join(b, "tag").where("left_id < right_id").groupBy("left_id", "right_id").agg(F.count_distinct("tag").alias("shared"))
