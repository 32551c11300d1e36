"""Adjacency layout: edges stored twice, bucketed by either end, and nodes bucketed by id, so that a hop shuffles only what comes to it.

All tables have the same number of buckets. A hub, a node with more edges at one end than a bucket should hold, is kept apart from that
end's buckets, in parts of bounded size; what meets a hub is copied to its parts. Hubs are few: none has less than its share of all edges.
"""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schema import EDGE_COLUMNS, NODE_COLUMNS, Graph, Side
from weftgraph.sources.files import Folder
from weftgraph.sources.names import read_names, store_names

#: Tables of a layout: folder, the bucketed key, the column that partitions it.
_TABLES = {"nodes": (("graph", "id"), "node_type"), "edges_src": (("graph", "src"), "edge_type"), "edges_dst": (("graph", "dst"), "edge_type")}


def _table(path: str, name: str) -> str:
    return f"weftgraph_{name}_{sha256(path.encode()).hexdigest()[:16]}"


def _bucketed(df: DataFrame, path: str, name: str, buckets: int) -> None:
    """One file for each bucket and type: rows come to the task of their bucket first."""
    key, type_ = _TABLES[name]
    df.repartition(buckets, *key).write.mode("overwrite").partitionBy(type_).bucketBy(buckets, *key).sortBy(*key).option("path", f"{path}/{name}").saveAsTable(_table(path, name))


def store_adjacency(g: Graph, path: str, buckets: int | None = None, hub_edges: int = 1_000_000) -> None:
    """Writes the layout, and an index of the names, under ``path``; its description comes last, so an unfinished one can't be opened.

    buckets: as many as there are shuffle partitions, unless given. A hub has more than ``hub_edges`` edges at an end, and more than a
    quarter of what a bucket holds on average, so there are at most 4 * ``buckets`` of them.
    """
    spark = g.nodes.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _bucketed(g.nodes.select(*NODE_COLUMNS), path, "nodes", buckets)
    edges, n_hubs = g.edges.select(*EDGE_COLUMNS), {}
    most = max(hub_edges, edges.count() // (4 * buckets))
    for end in ("src", "dst"):
        key = ["graph", end]
        hubs = edges.groupBy(*key).count().where(F.col("count") > most)
        hubs.select(*key, F.ceil(F.col("count") / most).cast("int").alias("parts")).coalesce(1).write.mode("overwrite").parquet(f"{path}/hubs_{end}")
        hubs = spark.read.parquet(f"{path}/hubs_{end}")
        n_hubs[end] = hubs.count()
        if n_hubs[end]:
            split = edges.join(F.broadcast(hubs), key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
            split.repartition(*key, "part").write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/hub_edges_{end}")
            _bucketed(edges.join(F.broadcast(hubs), key, "left_anti"), path, f"edges_{end}", buckets)
        else:
            _bucketed(edges, path, f"edges_{end}", buckets)
    counts = [list(r) for r in g.nodes.groupBy("label", "node_type", "category_id").count().collect()]  # as many as the ontology has
    store_names(g, path)
    about = {"buckets": buckets, "hubs": n_hubs, "counts": counts, "columns": {name: spark.table(_table(path, name)).schema.json() for name in _TABLES}}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")


def _opened(spark: SparkSession, path: str, name: str, about: dict) -> DataFrame:
    """A table of the layout; a session whose catalog doesn't know it yet is told of its buckets and partitions."""
    table, (key, type_) = _table(path, name), _TABLES[name]
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{c['name']}` {spark_type(c['type'])}" for c in json.loads(about["columns"][name])["fields"])
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY ({type_}) CLUSTERED BY ({', '.join(key)}) SORTED BY ({', '.join(key)}) INTO {about['buckets']} BUCKETS LOCATION '{path}/{name}'")
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table)


def spark_type(described: str | dict) -> str:
    """The SQL name of a type in a schema's JSON."""
    if isinstance(described, str):
        return {"long": "bigint", "integer": "int"}.get(described, described)
    if described["type"] == "array":
        return f"array<{spark_type(described['elementType'])}>"
    return "struct<" + ",".join(f"`{f['name']}`:{spark_type(f['type'])}" for f in described["fields"]) + ">"


def is_stored(spark: SparkSession, path: str) -> bool:
    return Folder(spark, path).exists("layout/_SUCCESS")


def read_adjacency(spark: SparkSession, path: str, catalog: dict[str, DataFrame] | None = None) -> Graph:
    """The graph of a layout. Its ``sides`` are what ``expand.hop`` joins with; nodes and edges are plain tables to all other operators."""
    about = json.loads(spark.read.text(f"{path}/layout").first()[0])
    sides = {}
    for end in ("src", "dst"):
        edges = _opened(spark, path, f"edges_{end}", about).select(*EDGE_COLUMNS)
        if about["hubs"][end]:
            split = spark.read.parquet(f"{path}/hub_edges_{end}").select(*EDGE_COLUMNS, "part")
            sides[end] = Side(edges, spark.read.parquet(f"{path}/hubs_{end}"), split)
        else:
            sides[end] = Side(edges)
    nodes = _opened(spark, path, "nodes", about).select(*NODE_COLUMNS)
    return Graph(nodes, sides["src"].all_edges(), catalog or {}, sides, tuple(map(tuple, about["counts"])), read_names(spark, path))
