"""The data model: a property graph as three DataFrames, and what belongs to its ontology.

Nodes and edges have fixed, well-known columns; ids are unique within a graph. A null validity bound is unbounded.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

NODE_COLUMNS = ("graph", "id", "label", "node_type", "category_id", "category_type", "external_id", "name", "identifier", "object", "active", "value_float", "created_at", "valid_from", "valid_to", "local_seq", "value", "variables")
#: Variables of a protocol event.
VARIABLES = "array<struct<key:string,value:string>>"
EDGE_COLUMNS = ("graph", "id", "label", "edge_type", "category_id", "src", "dst", "role", "quantity", "valid_from", "valid_to")
NODE_TYPES = ("ENTITY", "REAGENT", "STRUCTURE", "METRIC", "NATURAL_EVENT", "PROTOCOL_EVENT")
EDGE_TYPES = ("MEASUREMENT", "RELATION", "PARTICIPANT", "DESCRIPTION")
#: Metric kinds and the Spark types of their values.
VALUE_TYPES = {"INT": "bigint", "FLOAT": "double", "STRING": "string", "BOOLEAN": "boolean", "DATETIME": "timestamp_ntz", "CATEGORY": "string"}
#: Vector kinds and their lengths; None for any.
VECTOR_SIZES = {"ONE_D_VECTOR": 1, "TWO_D_VECTOR": 2, "THREE_D_VECTOR": 3, "FOUR_D_VECTOR": 4, "N_VECTOR": None}


@dataclass(frozen=True)
class Side:
    """Edges by one of their ends: those of most nodes in ``edges``, bucketed by (graph, end); those of hubs apart.

    hubs: graph, end and the number of parts; hub_edges: with their part.
    """

    edges: DataFrame
    hubs: DataFrame | None = None
    hub_edges: DataFrame | None = None

    def all_edges(self) -> DataFrame:
        return self.edges if self.hub_edges is None else self.edges.unionByName(self.hub_edges.select(*self.edges.columns))

    def of(self, graph: str) -> Side:
        return Side(*[None if t is None else t.where(F.col("graph") == graph) for t in (self.edges, self.hubs, self.hub_edges)])


@dataclass(frozen=True)
class Graph:
    """One or several graphs: nodes, edges, and the catalog tables of their ontology by name.

    sides: the same edges by "src" and by "dst", if they are stored so (``sources.adjacency``). counts: (label, node_type, category_id,
    number) of the stored nodes, by which a pattern's order is chosen; results don't depend on them. names: an index of the nodes' names, if one
    is stored (``sources.names``).
    """

    nodes: DataFrame
    edges: DataFrame
    catalog: dict[str, DataFrame] = field(default_factory=dict)
    sides: dict[str, Side] = field(default_factory=dict)
    counts: tuple[tuple, ...] = ()
    names: object | None = None

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes, names=None)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges, sides={})

    def of(self, graph: str) -> Graph:
        """One graph of several: a partition filter on both tables."""
        return Graph(self.nodes.where(F.col("graph") == graph), self.edges.where(F.col("graph") == graph), self.catalog, {end: side.of(graph) for end, side in self.sides.items()}, self.counts, self.names)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; unset, a temporary one in local mode, else an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftgraph-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read from there, where lineage and plan end: for what many parts of a job use. It is computed once."""
    if any(isinstance(f.dataType, NullType) for f in df.schema):  # Parquet has no such type
        shared_folder(df.sparkSession)
        return df.checkpoint()
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_id(id_: str | Column = "id", graph: str | Column = "graph") -> Column:
    return F.concat(graph, F.lit(":"), F.col(id_).cast("string") if isinstance(id_, str) else id_.cast("string"))


def prefixed(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """The columns (all, if none are given) renamed with a prefix."""
    return df.select(*[F.col(c).alias(prefix + c) for c in columns or df.columns])
