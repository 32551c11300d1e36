"""An inverted index of names by trigrams, beside the stored nodes: a search reads the lists of its trigrams instead of every name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schema import Graph
from weftgraph.sources.files import Folder

#: Found nodes up to this many are read by their ids, which skips the parts of the nodes' files without them; more are joined.
FEW = 1_000


@dataclass(frozen=True)
class NameIndex:
    """``lists``: gram, graph, node_type, id for each trigram of each lower-cased name, stored by ranges of the gram."""

    lists: DataFrame

    def candidates(self, search: str, node_type: str | None = None, graph: str | None = None) -> DataFrame | None:
        """(graph, id) of nodes whose name has all trigrams of the search; None if it is too short to have one."""
        text = search.lower()
        grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
        if not grams:
            return None
        rows = self.lists.where(F.col("gram").isin(grams))
        for column, value in (("node_type", node_type), ("graph", graph)):
            rows = rows.where(F.col(column) == value) if value is not None else rows
        return rows.groupBy("graph", "id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("graph", "id")


def store_names(g: Graph, path: str, files: int | None = None) -> None:
    """Writes the index: each distinct trigram of a name once, in order of the trigrams, so that a list is a stretch of few files. Frequent ones are dealt by id as well."""
    name = F.lower("name")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.substr(name, i, F.lit(3))))
    rows = g.nodes.where(F.length("name") >= 3).select(F.explode(grams).alias("gram"), "graph", "node_type", "id")
    files = files or int(g.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(files, "gram", "id").sortWithinPartitions("gram", "graph", "id").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{path}/names")


def read_names(spark: SparkSession, path: str) -> NameIndex | None:
    return NameIndex(spark.read.parquet(f"{path}/names")) if Folder(spark, path).exists("names/_SUCCESS") else None


def searched(nodes: DataFrame, index: NameIndex, search: str, node_type: str | None = None, graph: str | None = None) -> DataFrame:
    """Nodes whose name holds the search, whatever its case. Candidates of the index are checked against the names; a search of under three characters checks all."""
    holds = F.contains(F.lower("name"), F.lower(F.lit(search)))
    found = index.candidates(search, node_type, graph)
    if found is None:
        return nodes.where(holds)
    first = found.limit(FEW + 1).collect()
    if len(first) <= FEW:
        return nodes.where(F.col("id").isin([r["id"] for r in first]) & holds) if first else nodes.where(F.lit(False))
    return nodes.join(found, ["graph", "id"], "left_semi").where(holds)
