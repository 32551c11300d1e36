"""Integrity audits: the bulk form of rules that hold when facts are written. Each returns the rows that break its rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.roles import participants
from weftgraph.schema import VALUE_TYPES, VECTOR_SIZES, Graph, prefixed


def audit_metric_attachment(g: Graph) -> DataFrame:
    """Metrics that describe no structure."""
    structures = g.nodes.where("node_type = 'STRUCTURE'").select("graph", F.col("id").alias("dst"))
    attached = g.edges.where("edge_type = 'DESCRIPTION'").join(structures, ["graph", "dst"], "left_semi").select("graph", F.col("src").alias("id"))
    return g.nodes.where("node_type = 'METRIC'").join(attached, ["graph", "id"], "left_anti")


def audit_unsupported_events(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(natural events that no structure supports, placeholder structures to add for them)."""
    structures = g.nodes.where("node_type = 'STRUCTURE'").select("graph", F.col("id").alias("src"))
    supported = g.edges.where("edge_type = 'RELATION'").join(structures, ["graph", "src"], "left_semi").select("graph", F.col("dst").alias("id"))
    events = g.nodes.where("node_type = 'NATURAL_EVENT'").join(supported, ["graph", "id"], "left_anti")
    return events, events.select("graph", F.lit("@core/toldyouso").alias("identifier"), F.col("id").cast("string").alias("object"), F.col("id").alias("event_id"))


def audit_edge_definitions(g: Graph, rules: DataFrame) -> DataFrame:
    """Edges whose ends are of no category that the edge category allows.

    rules: category_id, side (src, dst), allowed: one row per allowed category of the end. A side without rules takes any.
    """
    out = []
    for side in ("src", "dst"):
        of_side = rules.where(F.col("side") == side)
        ends = g.nodes.select("graph", F.col("id").alias(side), F.col("category_id").alias("allowed"))
        ruled = g.edges.join(of_side.select("category_id").distinct(), "category_id", "left_semi").select("graph", "id", "category_id", side)
        broken = ruled.join(ends, ["graph", side], "left").join(of_side.select("category_id", "allowed"), ["category_id", "allowed"], "left_anti")
        out.append(broken.select("graph", "id", "category_id", F.lit(side).alias("side"), F.col("allowed").alias("found")))
    return out[0].unionByName(out[1])


def audit_definitions(g: Graph, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references to categories that don't exist, structure categories to create for ``@`` references).

    definitions: owner_id, graph, ref: the name of a category, or ``@identifier``.
    """
    known = g.catalog["categories"].select("graph", F.col("name").alias("ref"))
    unknown = definitions.join(known, ["graph", "ref"], "left_anti")
    at = F.startswith("ref", F.lit("@"))
    return unknown.where(~at), unknown.where(at).select("graph", F.lit("STRUCTURE").alias("kind"), F.col("ref").alias("name")).distinct()


def audit_measurement_direction(g: Graph) -> DataFrame:
    """Measurements that don't run from a structure to an entity."""
    a = prefixed(g.nodes, "left_", "graph", "id", "node_type").withColumnsRenamed({"left_graph": "graph", "left_id": "src"})
    b = prefixed(g.nodes, "right_", "graph", "id", "node_type").withColumnsRenamed({"right_graph": "graph", "right_id": "dst"})
    ends = g.edges.where("edge_type = 'MEASUREMENT'").join(a, ["src", "graph"], "left").join(b, ["dst", "graph"], "left")
    fine = (F.col("left_node_type") == "STRUCTURE") & (F.col("right_node_type") == "ENTITY")
    return ends.where(~F.coalesce(fine, F.lit(False))).select("graph", "id", "left_node_type", "right_node_type")


def audit_metric_kind(values: DataFrame, column: str = "value", kind: str = "kind") -> DataFrame:
    """Rows whose text value can't be cast to their category's kind."""
    fits = F.lit(False)
    for name, spark_type in VALUE_TYPES.items():
        fits = F.when(F.col(kind) == name, F.col(column).try_cast(spark_type).isNotNull()).otherwise(fits)
    for name, size in VECTOR_SIZES.items():
        v = F.from_json(column, "array<double>")
        fits = F.when(F.col(kind) == name, F.coalesce(v.isNotNull() if size is None else F.size(v) == size, F.lit(False))).otherwise(fits)
    return values.where(F.col(column).isNotNull() & ~fits)


def audit_roles(g: Graph) -> DataFrame:
    """Participants in a role that their event's category doesn't define, or without a quantity that it needs."""
    events = g.nodes.select("graph", F.col("id").alias("event_id"), F.col("category_id").alias("event_category_id"))
    defs = g.catalog["role_defs"].select("event_category_id", "direction", "role", "needs_quantity")
    met = participants(g).join(events, ["graph", "event_id"]).join(defs, ["event_category_id", "direction", "role"], "left")
    problem = F.when(F.col("needs_quantity").isNull(), "undefined role").when(F.col("needs_quantity") & F.col("quantity").isNull(), "no quantity")
    return met.withColumn("problem", problem).where("problem IS NOT NULL").select("graph", "event_id", "direction", "role", "member_id", "problem")
