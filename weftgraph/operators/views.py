"""Result shapes of saved queries: tables, paths, pairs, lists, and plots. A saved query is a function Graph -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.expand import paired_nodes
from weftgraph.operators.pattern import path_graph
from weftgraph.operators.scan import cast_columns
from weftgraph.schema import Graph

KINDS = ("NODE", "VALUE", "EDGE")


def render_table(result: DataFrame, columns: dict[str, str], value_kinds: dict[str, str] | None = None) -> DataFrame:
    """The declared columns, name -> NODE, VALUE or EDGE, with their kind in the column's metadata; text values are cast to value_kinds."""
    for name, kind in columns.items():
        if kind not in KINDS:
            raise ValueError(f"column {name} has the unknown kind {kind}")
    out = cast_columns(result, value_kinds or {}).select(*columns)
    return out.select(*[F.col(c).alias(c, metadata={"kind": k}) for c, k in columns.items()])


def render_path(walks: DataFrame, g: Graph) -> tuple[DataFrame, DataFrame]:
    return path_graph(walks, g)


def render_pairs(g: Graph, **filters) -> DataFrame:
    return paired_nodes(g, **filters)


def render_node_list(result: DataFrame, column: str, g: Graph) -> DataFrame:
    """The distinct nodes of one column of a result."""
    return g.nodes.join(result.select("graph", F.col(column).alias("id")), ["graph", "id"], "left_semi")


def render_edge_list(result: DataFrame, column: str, g: Graph) -> DataFrame:
    return g.edges.join(result.select("graph", F.col(column).alias("id")), ["graph", "id"], "left_semi")


def anchored(result: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """A node query: the rows of a result whose column is one of many nodes (graph, id)."""
    return result.join(ids.select("graph", F.col("id").alias(column)).distinct(), ["graph", column], "left_semi")


def render_node_table(result: DataFrame, column: str, ids: DataFrame, columns: dict[str, str]) -> DataFrame:
    return render_table(anchored(result, column, ids), columns)


def render_node_path(walks: DataFrame, ids: DataFrame, g: Graph) -> tuple[DataFrame, DataFrame]:
    return path_graph(anchored(walks, "start_id", ids), g)


def render_node_pairs(g: Graph, ids: DataFrame, **filters) -> DataFrame:
    return anchored(paired_nodes(g, **filters), "left_id", ids)


def scatter_points(table: DataFrame, id: str, x: str, y: str, share: float | None = None, seed: int = 0, **roles: str) -> DataFrame:
    """id, x, y and other roles (x_id, y_id, color, size, shape) of a rendered table; ids must be NODE or EDGE columns, the others exist."""
    bound = {"id": id, "x": x, "y": y, **roles}
    for role, column in bound.items():
        if column not in table.columns:
            raise ValueError(f"{role}: no column {column}")
        if role.endswith("id") and table.schema[column].metadata.get("kind") not in ("NODE", "EDGE"):
            raise ValueError(f"{role}: {column} is not a node or edge column")
    out = table.select(*[F.col(c).alias(r) for r, c in bound.items()])
    return out.sample(fraction=share, seed=seed) if share is not None else out
