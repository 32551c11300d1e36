"""Scans, filters and projections of nodes and edges."""

from __future__ import annotations

import random
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.schema import EDGE_TYPES, NODE_TYPES, VALUE_TYPES, VECTOR_SIZES, Graph, global_id
from weftgraph.sources.names import searched


def scan_nodes(g: Graph, graph: str) -> DataFrame:
    return g.nodes.where(F.col("graph") == graph)


def scan_edges(g: Graph, graph: str) -> DataFrame:
    return g.edges.where(F.col("graph") == graph)


def split_ids(ids: DataFrame, column: str = "gid") -> DataFrame:
    """Global ids ``graph:id`` -> distinct (graph, id); malformed ones are left out."""
    parts = F.split(F.col(column), ":", 2)
    return ids.select(parts[0].alias("graph"), F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("id")).where("id is not null").distinct()


def nodes_by_id(g: Graph, ids: DataFrame) -> DataFrame:
    """Nodes with the global ids in column ``gid``."""
    return g.nodes.join(split_ids(ids), ["graph", "id"], "left_semi")


def edges_by_id(g: Graph, ids: DataFrame) -> DataFrame:
    return g.edges.join(split_ids(ids), ["graph", "id"], "left_semi")


def entities_by_external_id(g: Graph, keys: DataFrame) -> DataFrame:
    """Entities with the given (category_id, external_id)."""
    return g.nodes.where("node_type = 'ENTITY'").join(keys, ["category_id", "external_id"], "left_semi")


def structures_by_object(g: Graph, keys: DataFrame) -> DataFrame:
    """Structures with the given (identifier, object)."""
    return g.nodes.where("node_type = 'STRUCTURE'").join(keys, ["identifier", "object"], "left_semi")


def structures_by_reference(g: Graph, refs: DataFrame) -> DataFrame:
    """Structures with the given references ``identifier:object``, in column ``ref``."""
    at = F.locate(":", F.col("ref"))
    keys = refs.where(at > 0).select(F.expr("substring(ref, 1, locate(':', ref) - 1)").alias("identifier"), F.expr("substring(ref, locate(':', ref) + 1)").alias("object"))
    return structures_by_object(g, keys)


def categories_tagged(g: Graph, tags: list[str]) -> DataFrame:
    """category_id of the categories that have any of the tags."""
    tagged = g.catalog["category_tags"].where(F.col("tag").isin(tags)).select("category_id")
    return g.catalog["categories"].join(tagged, "category_id", "left_semi").select("category_id")


def _filtered(
    g: Graph,
    node_type: str,
    graph: str | None = None,
    tags: list[str] | None = None,
    categories: list[int] | None = None,
    external_ids: list[str] | None = None,
    search: str | None = None,
    created_after: datetime | None = None,
    created_before: datetime | None = None,
    ids: list[int] | None = None,
    active: bool | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    found = g.nodes.where(F.col("node_type") == node_type)
    tests: list[Column] = []
    if graph is not None:
        tests.append(F.col("graph") == graph)
    if categories:
        tests.append(F.col("category_id").isin(categories))
    if external_ids:
        tests.append(F.col("external_id").isin(external_ids))
    if search and g.names is not None:
        found = searched(found, g.names, search, node_type, graph)
    elif search:
        tests.append(F.contains(F.lower("name"), F.lower(F.lit(search))))
    if created_after is not None:
        tests.append(F.col("created_at") > F.lit(created_after).cast("timestamp_ntz"))
    if created_before is not None:
        tests.append(F.col("created_at") < F.lit(created_before).cast("timestamp_ntz"))
    if ids:
        tests.append(F.col("id").isin(ids))
    if active:  # only True filters
        tests.append(F.col("active"))
    for t in tests:
        found = found.where(t)
    if tags:
        found = found.join(categories_tagged(g, tags), "category_id", "left_semi")
    if limit is not None or offset:
        found = found.orderBy("id").offset(offset)
        found = found.limit(limit) if limit is not None else found
    return found


def filter_entities(g: Graph, **filters) -> DataFrame:
    """Entities by any of: graph, tags, categories, external_ids, search, created_after, created_before, ids, active; limit, offset by id.

    search: a part of the name, whatever its case, found by the index of names if the graph has one.
    """
    return _filtered(g, "ENTITY", **filters)


def filter_reagents(g: Graph, **filters) -> DataFrame:
    return _filtered(g, "REAGENT", **filters)


def typed_nodes(g: Graph, node_type: str, ids: list[int] | None = None, search: str | None = None) -> DataFrame:
    """Nodes of one kind; search is a case-sensitive prefix of the name."""
    found = g.nodes.where(F.col("node_type") == node_type)
    if ids:
        found = found.where(F.col("id").isin(ids))
    return found.where(F.startswith("name", F.lit(search))) if search else found


def typed_edges(g: Graph, edge_type: str, ids: list[int] | None = None, search: str | None = None, with_self: bool | None = None, left: int | None = None, right: int | None = None) -> DataFrame:
    """Edges of one kind; search is a case-sensitive prefix of the label; self loops only if asked for."""
    found = g.edges.where(F.col("edge_type") == edge_type)
    for test in (
        F.col("id").isin(ids) if ids else None,
        F.startswith("label", F.lit(search)) if search else None,
        None if with_self else F.col("src") != F.col("dst"),
        F.col("src") == left if left is not None else None,
        F.col("dst") == right if right is not None else None,
    ):
        found = found if test is None else found.where(test)
    return found


def split_node_subtypes(g: Graph) -> DataFrame:
    """Number of nodes of each subtype of a graph; unknown types come as null."""
    subtype = F.when(F.col("node_type").isin(*NODE_TYPES), F.col("node_type"))
    return g.nodes.groupBy("graph", subtype.alias("subtype")).agg(F.count("*").alias("n"))


def split_edge_subtypes(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(edges per subtype, edges of unknown type, which are errors)."""
    known = F.col("edge_type").isin(*EDGE_TYPES)
    return g.edges.where(known).groupBy("graph", F.col("edge_type").alias("subtype")).agg(F.count("*").alias("n")), g.edges.where(~F.coalesce(known, F.lit(False)))


def project_node_public(nodes: DataFrame, with_kind: bool = False) -> DataFrame:
    """Global id, local id, external id and display label: external id, else sequence number, else id."""
    local = F.col("local_seq") if "local_seq" in nodes.columns else F.lit(None).cast("bigint")
    shown = F.coalesce("external_id", local.cast("string"), F.col("id").cast("string"))
    shown = F.concat_ws(" ", "category_type", shown) if with_kind else shown
    return nodes.select(global_id().alias("gid"), F.col("id"), "external_id", local.alias("local_id"), shown.alias("display"))


def project_node_label(nodes: DataFrame) -> DataFrame:
    return nodes.select("graph", "id", F.coalesce("name", F.concat_ws(" - ", "label", F.col("id").cast("string"))).alias("shown"))


def project_edge_public(edges: DataFrame) -> DataFrame:
    return edges.select(global_id().alias("gid"), "label", global_id("src").alias("left_gid"), global_id("dst").alias("right_gid"), "role", "quantity", "valid_from", "valid_to")


def project_properties(df: DataFrame, bag: str = "props") -> DataFrame:
    """The property bag without the keys id and labels."""
    return df.withColumn(bag, F.map_filter(bag, lambda k, _: ~k.isin("id", "labels")))


def filter_categories(g: Graph, ids: list[int] | None = None, search: str | None = None, graph: str | None = None, pinned_by: int | None = None, tags: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """Categories by ids, case-sensitive part of the name, graph, kind, pinning user and tags."""
    c = g.catalog["categories"]
    for test in (
        F.col("category_id").isin(ids) if ids else None,
        F.contains("name", F.lit(search)) if search else None,
        F.col("graph") == graph if graph else None,
        F.col("kind") == kind if kind else None,
    ):
        c = c if test is None else c.where(test)
    if pinned_by is not None:
        c = c.join(g.catalog["pins"].where(F.col("user_id") == pinned_by).select("category_id"), "category_id", "left_semi")
    if tags:
        c = c.join(categories_tagged(g, tags), "category_id", "left_semi")
    return c


def of_categories(facts: DataFrame, categories: DataFrame) -> DataFrame:
    """Nodes or edges whose category is among ``categories``."""
    return facts.join(categories.select("category_id"), "category_id", "left_semi")


def random_nodes(g: Graph, k: int = 1, seed: int | None = None) -> DataFrame:
    """k nodes at random: those whose md5 of seed, graph and id is least, all nodes with an equal chance.

    A drawing with a seed depends on the nodes alone, not on partitions or order; drawings of parts can be merged (``merge_drawings``), since the least of
    the parts are among the least of each. Without a seed, one is drawn. Only k rows leave a task.
    """
    seed = random.getrandbits(62) if seed is None else seed
    return _drawn(g.nodes, k, seed)


def _drawn(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), "graph", F.col("id").cast("string")))
    return nodes.orderBy(drawn, "graph", "id").limit(k)


def merge_drawings(drawings: list[DataFrame], k: int, seed: int) -> DataFrame:
    """The drawing of k from all nodes, from drawings of at least k from parts of them with the same seed."""
    return _drawn(reduce(DataFrame.unionByName, drawings), k, seed)


def expand_edge_metrics(edges: DataFrame, bag: str = "props") -> DataFrame:
    """One row (id, key, value) for each property of each edge."""
    return edges.select("graph", "id", F.explode(bag).alias("key", "value"))


def cast_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns -> typed ones by declared kind; what can't be cast becomes null."""
    made = {}
    for name, kind in kinds.items():
        if kind in VECTOR_SIZES:
            v, size = F.from_json(name, "array<double>"), VECTOR_SIZES[kind]
            made[name] = F.when(F.size(v) == size, v) if size else v
        else:
            made[name] = F.col(name).try_cast(VALUE_TYPES[kind])
    return df.withColumns(made)
