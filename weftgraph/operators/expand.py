"""One hop: incident edges, neighbours, endpoints and pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.schema import Graph, prefixed

_SMALL = ("graph", "id", "label", "node_type", "category_id", "name")


def hop(g: Graph, rows: DataFrame, end: str, where: Column | str | None = None, columns: Sequence[str | Column] = ()) -> DataFrame:
    """``rows`` (graph, END, ...) joined with the edges that have that end, of which ``where`` holds: columns of the edges beside those of the rows.

    On a graph in adjacency layout the edges stay where they are and only the rows are shuffled; rows of a hub are copied to its parts.
    """
    key, side = [end, "graph"], g.sides.get(end)  # ids first: rows are sorted by them, not by a name that most have in common
    of = lambda edges, *more: (edges if where is None else edges.where(where)).select(*key, *columns, *more)
    met = rows.join(of(g.edges if side is None else side.edges), key)
    if side is None or side.hubs is None:
        return met
    parted = rows.join(F.broadcast(side.hubs), key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return met.unionByName(parted.join(of(side.hub_edges, "part"), [*key, "part"]).drop("part"))


def edges_by(g: Graph, end: str) -> DataFrame:
    """All edges, stored by that end if there is such a copy: a join or grouping on it, with whatever else, needs no shuffle of them."""
    return g.edges if end not in g.sides else g.sides[end].all_edges()


def _incident(g: Graph, ids: DataFrame, end: str, where: str | None = None) -> DataFrame:
    here = ids.select("graph", F.col("id").alias(end)).distinct()
    rest = [c for c in g.edges.columns if c not in ("graph", end)]
    return hop(g, here, end, where, rest).select(*g.edges.columns, F.col(end).alias("node_id"))


def out_edges(g: Graph, ids: DataFrame) -> DataFrame:
    """Edges leaving the nodes (graph, id) of ``ids``, with node_id."""
    return _incident(g, ids, "src")


def in_edges(g: Graph, ids: DataFrame) -> DataFrame:
    return _incident(g, ids, "dst")


def incident_edges(g: Graph, ids: DataFrame) -> DataFrame:
    """Edges of either direction, with true src and dst and a direction; a self loop comes once, as out."""
    return out_edges(g, ids).withColumn("direction", F.lit("out")).unionByName(_incident(g, ids, "dst", "src <> dst").withColumn("direction", F.lit("in")))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both orientations (left, right); a self loop once. A join across keys never needs an OR."""
    forth = edges.withColumns({"left_id": F.col("src"), "right_id": F.col("dst")})
    return forth.unionByName(edges.where("src <> dst").withColumns({"left_id": F.col("dst"), "right_id": F.col("src")}))


def neighbors(g: Graph, ids: DataFrame) -> DataFrame:
    """Distinct (node_id, edge_id, neighbor_id), neighbour other than the node itself."""
    inc = incident_edges(g, ids).where("src <> dst")
    other = F.when(F.col("direction") == "out", F.col("dst")).otherwise(F.col("src"))
    met = inc.select("graph", "node_id", F.col("id").alias("edge_id"), other.alias("neighbor_id"))
    known = g.nodes.select("graph", F.col("id").alias("neighbor_id"), F.col("label").alias("neighbor_label"), F.col("name").alias("neighbor_name"))
    return met.join(known, ["graph", "neighbor_id"]).dropDuplicates(["graph", "node_id", "edge_id", "neighbor_id"])


def resolve_endpoints(g: Graph, edges: DataFrame) -> DataFrame:
    """Edges with columns left_* and right_* of their end nodes; edges without an end are left out."""
    left = prefixed(g.nodes, "left_", *_SMALL).withColumnRenamed("left_graph", "graph").withColumnRenamed("left_id", "src")
    right = prefixed(g.nodes, "right_", *_SMALL).withColumnRenamed("right_graph", "graph").withColumnRenamed("right_id", "dst")
    return edges.join(left, ["src", "graph"]).join(right, ["dst", "graph"])


def paired_nodes(g: Graph, left=None, right=None, edge=None, with_self: bool | None = None, offset: int = 0, limit: int | None = None, dedupe: bool = False) -> DataFrame:
    """(left, right, edge) triples over undirected edges: each edge once per orientation unless ``dedupe``.

    left, right, edge: conditions on node and edge columns, all of which must hold.
    """
    tests = [F.expr(edge) if isinstance(edge, str) else edge] if edge is not None else []
    straight = reduce(Column.__and__, tests + ([] if with_self else [F.col("src") != F.col("dst")]), F.lit(True))
    a = prefixed(g.nodes if left is None else g.nodes.where(left), "left_", "graph", "id", "label", "name").withColumnRenamed("left_graph", "graph")
    b = prefixed(g.nodes if right is None else g.nodes.where(right), "right_", "graph", "id", "label", "name").withColumnRenamed("right_graph", "graph")

    def oriented(end: str, other: str, test: Column) -> DataFrame:
        met = hop(g, a.withColumnRenamed("left_id", end), end, test, [F.col("id").alias("edge_id"), F.col("label").alias("edge_label"), F.col(other).alias("right_id")])
        return met.withColumnRenamed(end, "left_id")

    forth = oriented("src", "dst", straight)
    both = forth if dedupe else forth.unionByName(oriented("dst", "src", straight & (F.col("src") != F.col("dst"))))
    pairs = both.join(b, ["graph", "right_id"]).select("graph", "right_id", "left_id", "edge_id", "edge_label", "left_label", "left_name", "right_label", "right_name")
    if offset or limit is not None:
        pairs = pairs.orderBy("edge_id", "left_id").offset(offset)
        pairs = pairs.limit(limit) if limit is not None else pairs
    return pairs


def edges_between(g: Graph, left: int | None = None, right: int | None = None, ids: list[int] | None = None, search: str | None = None, with_self: bool | None = None) -> DataFrame:
    """Undirected edges by left id, right id, edge ids and label prefix, with left_id and right_id."""
    edges = g.edges if with_self else g.edges.where("src <> dst")
    edges = edges.where(F.col("id").isin(ids)) if ids else edges
    edges = edges.where(F.startswith("label", F.lit(search))) if search else edges
    both = undirected(edges)
    both = both.where(F.col("left_id") == left) if left is not None else both
    return both.where(F.col("right_id") == right) if right is not None else both


def self_loop_metrics(g: Graph) -> DataFrame:
    return g.edges.where("src = dst")


def structure_measurements(g: Graph, categories: DataFrame) -> DataFrame:
    """Measurements leaving structures, of the categories (category_id)."""
    structures = g.nodes.where("node_type = 'STRUCTURE'").select("graph", F.col("id").alias("src"), "identifier", "object")
    chosen = g.edges.where("edge_type = 'MEASUREMENT'").join(categories.select("category_id").distinct(), "category_id", "left_semi")
    return chosen.join(structures, ["graph", "src"])


def active_measurements(g: Graph, user_id: int) -> DataFrame:
    """The same, of categories that the user has pinned."""
    return structure_measurements(g, g.catalog["pins"].where(F.col("user_id") == user_id))


def structure_metrics(g: Graph) -> DataFrame:
    """(structure_id, metric_id, category_id, value) for each metric that describes a structure."""
    metric = g.nodes.where("node_type = 'METRIC'").select("graph", F.col("id").alias("src"), F.col("category_id").alias("metric_category"), F.col("value_float").alias("value"))
    structure = g.nodes.where("node_type = 'STRUCTURE'").select("graph", F.col("id").alias("dst"))
    joined = hop(g, metric, "src", "edge_type = 'DESCRIPTION'", ["dst"]).join(structure, ["graph", "dst"])
    return joined.select("graph", F.col("dst").alias("structure_id"), F.col("src").alias("metric_id"), "metric_category", "value")


def structure_measures(g: Graph) -> DataFrame:
    """(structure_id, entity_id, category_id) for each measurement from a structure to an entity."""
    structure = g.nodes.where("node_type = 'STRUCTURE'").select("graph", F.col("id").alias("src"))
    entity = g.nodes.where("node_type = 'ENTITY'").select("graph", F.col("id").alias("dst"), F.col("category_id").alias("entity_category"))
    joined = hop(g, structure, "src", "edge_type = 'MEASUREMENT'", ["dst", "valid_from", "valid_to"]).join(entity, ["graph", "dst"])
    return joined.select("graph", F.col("src").alias("structure_id"), F.col("dst").alias("entity_id"), "entity_category", "valid_from", "valid_to")


def attach_category(g: Graph, facts: DataFrame) -> DataFrame:
    """Nodes or edges with kind and name of their category; null where they have none."""
    c = g.catalog["categories"].select("category_id", F.col("kind").alias("category_kind"), F.col("name").alias("category_name"))
    return facts.join(c, "category_id", "left")


def dangling_edges(g: Graph) -> DataFrame:
    """Edges of which an end doesn't exist, with the side that is missing."""
    ids = g.nodes.select("graph", "id")
    sides = [edges_by(g, end).join(ids.withColumnRenamed("id", end), ["graph", end], "left_anti").select("graph", "id", "src", "dst", F.lit(end).alias("missing")) for end in ("src", "dst")]
    return sides[0].unionByName(sides[1])


def cross_graph_edges(edges: DataFrame) -> DataFrame:
    """Edges given by global ids (left_gid, right_gid) whose ends are in different graphs, or malformed."""
    graph = [F.when(F.col(c).rlike(r"^[^:]+:\d+$"), F.split(c, ":")[0]) for c in ("left_gid", "right_gid")]
    return edges.where(~F.coalesce(graph[0] == graph[1], F.lit(False)))


def degree(g: Graph) -> DataFrame:
    """In-degree, out-degree and number of incident edges (a self loop once) of all nodes, isolated ones included.

    Each end is counted by itself, so that edges in adjacency layout are counted where they are; of hubs, counts are shuffled.
    """

    def counts(end: str, *made: Column) -> DataFrame:
        side = g.sides.get(end)
        tables = [g.edges] if side is None else [t for t in (side.edges, side.hub_edges) if t is not None]
        return reduce(DataFrame.unionByName, [t.groupBy("graph", F.col(end).alias("id")).agg(*made) for t in tables])

    out = counts("src", F.count("*").alias("o"))
    into = counts("dst", F.count("*").alias("i"), F.count_if(F.col("src") != F.col("dst")).alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    met = g.nodes.select("graph", "id").join(out, ["graph", "id"], "left").join(into, ["graph", "id"], "left")
    return met.select("graph", "id", zero("o").alias("out_degree"), zero("i").alias("in_degree"), (zero("o") + zero("t")).alias("incident"))
