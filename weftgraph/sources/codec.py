"""Graph values that come as text: ``{json}::vertex``, ``{json}::edge`` and paths of them, decoded a column at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERTEX = "id bigint, label string, properties map<string,string>"
EDGE = "id bigint, label string, end_id bigint, start_id bigint, properties map<string,string>"
#: One object with at most one nested object, and its tag.
_PART = r"(\{(?:[^{}]|\{[^{}]*\})*\})::(vertex|edge)"


def decode_graph_values(values: DataFrame, column: str = "value") -> DataFrame:
    """kind (vertex or edge), id, label, start_id, end_id, properties of each value; malformed ones have a null kind."""
    kind = F.regexp_extract(column, r"::(vertex|edge)\s*$", 1)
    parsed = F.from_json(F.regexp_replace(column, r"::(vertex|edge)\s*$", ""), EDGE)
    fine = (kind != "") & parsed["id"].isNotNull()
    return values.withColumn("v", parsed).select(*values.columns, F.when(fine, kind).alias("kind"), "v.id", "v.label", "v.start_id", "v.end_id", "v.properties")


def decode_paths(paths: DataFrame, column: str = "path") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the distinct vertices and edges of all paths."""
    parts = paths.select(F.explode(F.regexp_extract_all(column, F.lit(_PART), F.lit(0))).alias("value"))
    decoded = decode_graph_values(parts)
    nodes = decoded.where("kind = 'vertex'").select("id", "label", "properties").dropDuplicates(["id"])
    return nodes, decoded.where("kind = 'edge'").select("id", "label", "start_id", "end_id", "properties").dropDuplicates(["id"])


def encode_nodes(nodes: DataFrame) -> DataFrame:
    """(id, value) of nodes as text: the inverse of decoding."""
    props = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("external_id"), F.col("external_id")), lambda _, v: v.isNotNull())
    return nodes.select("id", F.concat(F.to_json(F.struct("id", "label", props.alias("properties"))), F.lit("::vertex")).alias("value"))


def encode_edges(edges: DataFrame) -> DataFrame:
    props = F.map_filter(F.create_map(F.lit("role"), F.col("role")), lambda _, v: v.isNotNull())
    return edges.select("id", F.concat(F.to_json(F.struct("id", "label", F.col("dst").alias("end_id"), F.col("src").alias("start_id"), props.alias("properties"))), F.lit("::edge")).alias("value"))
