"""Bulk ingest: each job takes a table of inputs and gives the graph with them.

Upserts are full outer joins on the key; checks run before anything is written, so an input with an error
leaves nothing behind. New ids are ``new_ids`` plus the input's own number ``input_no``, which is unique.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.functions.names import parse_structure_refs
from weftgraph.operators.aggregate import latest_per_external_id, numbered
from weftgraph.operators.roles import active_reagent, counted_edges, counted_reagents, counted_roles, set_active_reagent
from weftgraph.schema import EDGE_COLUMNS, NODE_COLUMNS, VALUE_TYPES, VECTOR_SIZES, Graph, checkpointed
from weftgraph.sources.files import Folder


def _shaped(df: DataFrame, columns: tuple[str, ...], like: DataFrame, **fixed) -> DataFrame:
    """``df`` with the given columns: fixed values, its own, or null, in the types of ``like``."""
    made = []
    for c in columns:
        value = F.lit(fixed[c]) if c in fixed and not isinstance(fixed[c], Column) else fixed.get(c, F.col(c) if c in df.columns else F.lit(None))
        made.append(value.cast(like.schema[c].dataType).alias(c))
    return df.select(*made)


def _given(g: Graph, node_type: str) -> DataFrame:
    """(category_id, n_given): how many running numbers each category has given."""
    return g.nodes.where((F.col("node_type") == node_type) & F.col("local_seq").isNotNull()).groupBy("category_id").agg(F.count("*").alias("n_given"))


def _upsert(g: Graph, inputs: DataFrame, label: str, node_type: str, new_ids: int, sequence: dict | None = None, changed: tuple[str, ...] = ("name", "created_at")) -> Graph:
    """inputs: graph, category_id, external_id, created_at, input_no and what is ``changed``. The last of a key holds, with its nulls; no key always appends.

    sequence: start, step, least, most or cycle of ``numbered``, for the numbers that new nodes get, in order of input_no; they go
    on from those that their categories have given.
    """
    key = ["external_id", "graph", "category_id"]
    last = latest_per_external_id(inputs, key, ["created_at", "input_no"])
    mine = (F.col("node_type") == node_type) & F.col("external_id").isNotNull()
    olds, others = g.nodes.where(mine), g.nodes.where(~F.coalesce(mine, F.lit(False)))
    found = olds.join(last.where("external_id IS NOT NULL").select(*key, F.lit(True).alias("_met"), *[F.col(c).alias(f"_{c}") for c in changed]), key, "left")
    updated = found.withColumns({c: F.when(F.col("_met"), F.col(f"_{c}")).otherwise(F.col(c)) for c in changed})
    created = last.join(olds.select(*key), key, "left_anti").withColumn("id", F.lit(new_ids) + F.col("input_no"))
    if sequence is not None:
        created = numbered(created, "category_id", "input_no", given=_given(g, node_type), **sequence)
    return g.with_nodes(others.select(*NODE_COLUMNS).unionByName(updated.select(*NODE_COLUMNS)).unionByName(_shaped(created, NODE_COLUMNS, g.nodes, label=label, node_type=node_type)))


def ingest_entities(g: Graph, inputs: DataFrame, new_ids: int, sequence: dict | None = None) -> Graph:
    return _upsert(g, inputs, "Entity", "ENTITY", new_ids, sequence)


def ingest_reagents(g: Graph, inputs: DataFrame, new_ids: int, sequence: dict | None = None) -> Graph:
    """As entities; inputs with set_active then make their reagent the active one of its category."""
    made = _upsert(g, inputs, "Reagent", "REAGENT", new_ids, sequence)
    if "set_active" not in inputs.columns:
        return made
    asked = inputs.where("set_active AND external_id IS NOT NULL").select("graph", "category_id", "external_id", F.col("input_no").alias("seq"))
    by_key = made.nodes.where("node_type = 'REAGENT'").select("graph", "category_id", "external_id", "id").join(asked, ["graph", "category_id", "external_id"])
    loose = inputs.where("set_active AND external_id IS NULL").select("graph", (F.lit(new_ids) + F.col("input_no")).alias("id"), F.col("input_no").alias("seq"))
    return set_active_reagent(made, by_key.select("graph", "id", "seq").unionByName(loose))


def ingest_structures(g: Graph, inputs: DataFrame, new_ids: int, new_categories: int) -> tuple[Graph, DataFrame]:
    """(graph with a new structure for each well-formed reference, malformed inputs). inputs: graph, ref, created_at, input_no.

    Identifiers without a category get one, numbered from ``new_categories`` in order of graph and identifier.
    """
    parsed, bad = parse_structure_refs(inputs)
    parsed = inputs.join(parsed.distinct(), "ref")
    known = g.catalog["categories"].where("kind = 'STRUCTURE'").select("graph", F.col("name").alias("identifier"), F.col("category_id").cast("bigint"))
    missing = parsed.select("graph", "identifier", "input_no").join(known, ["graph", "identifier"], "left_anti").groupBy("graph", "identifier").agg(F.min("input_no").alias("first"))
    added = numbered(missing.withColumn("one", F.lit(1)), "one", "first", start=new_categories).select("graph", "identifier", F.col("local_seq").alias("category_id"))
    rows = parsed.join(known.unionByName(added), ["graph", "identifier"]).withColumn("id", F.lit(new_ids) + F.col("input_no"))
    nodes = _shaped(rows, NODE_COLUMNS, g.nodes, label="Structure", node_type="STRUCTURE", category_type=F.col("identifier"))
    catalog = g.catalog | {"categories": g.catalog["categories"].unionByName(added.select(F.col("category_id").cast("int"), "graph", F.lit("STRUCTURE").alias("kind"), F.col("identifier").alias("name")))}
    return Graph(g.nodes.select(*NODE_COLUMNS).unionByName(nodes), g.edges, catalog), bad


def typed_text(value: str, kind: str) -> Column:
    """A value's text in the form of its kind, null if it isn't one of that kind (or the kind is unknown)."""
    v, out = F.col(value).cast("string"), F.lit(None).cast("string")
    for name, type_ in VALUE_TYPES.items():
        out = F.when(F.col(kind) == name, v.try_cast(type_).cast("string")).otherwise(out)
    for name, size in VECTOR_SIZES.items():
        parsed = F.from_json(v, "array<double>")
        good = F.forall(parsed, lambda x: x.isNotNull()) & (F.size(parsed) == size if size else F.size(parsed) > 0)
        out = F.when(F.col(kind) == name, F.when(good, F.to_json(parsed))).otherwise(out)
    return out


def ingest_metrics(g: Graph, inputs: DataFrame, new_ids: int) -> tuple[Graph, DataFrame]:
    """(graph with a Metric node and a DESCRIBES edge per input, inputs without their structure or with a value that isn't of their kind).

    inputs: graph, structure_id, category_id, value, created_at, input_no, and kind if values are typed: such a value is kept as text in
    ``value``, and as a number in ``value_float`` if it is one. Without a kind, values are numbers.
    """
    structures = g.nodes.where("node_type = 'STRUCTURE'").select("graph", F.col("id").alias("structure_id"))
    typed = "kind" in inputs.columns
    text = F.when(F.col("kind").isNotNull(), typed_text("value", "kind")) if typed else F.lit(None).cast("string")
    read = inputs.withColumn("_text", text)
    fine = (F.col("kind").isNull() | F.col("value").isNull() | F.col("_text").isNotNull()) if typed else F.lit(True)
    number = F.when(F.coalesce(F.col("kind"), F.lit("FLOAT")).isin("INT", "FLOAT"), F.col("value").try_cast("double")) if typed else F.col("value").cast("double")
    good = read.where(fine).join(structures, ["structure_id", "graph"], "left_semi").withColumn("id", F.lit(new_ids) + F.col("input_no"))
    nodes = _shaped(good, NODE_COLUMNS, g.nodes, label="Metric", node_type="METRIC", value_float=number, value=F.col("_text"))
    edges = _shaped(good, EDGE_COLUMNS, g.edges, label="DESCRIBES", edge_type="DESCRIPTION", src=F.col("id"), dst=F.col("structure_id"), category_id=None)
    bad = read.where(fine).join(structures, ["structure_id", "graph"], "left_anti").unionByName(read.where(~fine)).select(*inputs.columns)
    return Graph(g.nodes.select(*NODE_COLUMNS).unionByName(nodes), g.edges.select(*EDGE_COLUMNS).unionByName(edges), g.catalog), bad


def _ingest_edges(g: Graph, inputs: DataFrame, new_ids: int, edge_type: str, left: str, right: str) -> tuple[Graph, DataFrame]:
    """Edges between nodes of two types; inputs (graph, src, dst, label, category_id, valid_from?, valid_to?, input_no) without both ends are errors."""
    good, bad = inputs, []
    for end, kind in (("src", left), ("dst", right)):
        ids = g.nodes.where(F.col("node_type") == kind).select("graph", F.col("id").alias(end))
        bad.append(inputs.join(ids, [end, "graph"], "left_anti").withColumn("missing", F.lit(end)))
        good = good.join(ids, [end, "graph"], "left_semi")
    edges = _shaped(good.withColumn("id", F.lit(new_ids) + F.col("input_no")), EDGE_COLUMNS, g.edges, edge_type=edge_type)
    return g.with_edges(g.edges.select(*EDGE_COLUMNS).unionByName(edges)), bad[0].unionByName(bad[1])


def ingest_measurements(g: Graph, inputs: DataFrame, new_ids: int) -> tuple[Graph, DataFrame]:
    return _ingest_edges(g, inputs, new_ids, "MEASUREMENT", "STRUCTURE", "ENTITY")


def ingest_relations(g: Graph, inputs: DataFrame, new_ids: int) -> tuple[Graph, DataFrame]:
    return _ingest_edges(g, inputs, new_ids, "RELATION", "ENTITY", "ENTITY")


def associate_structures(g: Graph, inputs: DataFrame, new_ids: int) -> tuple[Graph, DataFrame]:
    """Measurements whose structure is given by (identifier, object); unresolved inputs are errors."""
    structures = g.nodes.where("node_type = 'STRUCTURE'").select("graph", "identifier", "object", F.col("id").alias("src"))
    return ingest_measurements(g, inputs.join(structures, ["graph", "identifier", "object"], "left"), new_ids)


def set_edge_metric(edges: DataFrame, values: DataFrame, key: str, bag: str = "props") -> tuple[DataFrame, DataFrame]:
    """(edges with one property set from values (graph, id, value), values without an edge). The largest value of an id holds."""
    one = values.groupBy("graph", "id").agg(F.max("value").alias("_value"))
    old = F.coalesce(F.col(bag), F.create_map().cast("map<string,string>"))
    new = F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), F.col("_value")))
    found = edges.join(one, ["id", "graph"], "left").withColumn(bag, F.when(F.col("_value").isNotNull(), new).otherwise(F.col(bag))).select(*edges.columns)
    return found, values.join(edges, ["id", "graph"], "left_anti")


def event_edges(rows: DataFrame, direction: str) -> DataFrame:
    """Participant rows of one direction as edges: into the event from its members, or out of it to them."""
    ends = ("member_id", "event_id") if direction == "in" else ("event_id", "member_id")
    return rows.where(F.col("direction") == direction).select("graph", F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst"), F.col("role").alias("label"), "role", "quantity")


def in_edges_for_event(rows: DataFrame) -> DataFrame:
    return event_edges(rows, "in")


def out_edges_for_event(rows: DataFrame) -> DataFrame:
    return event_edges(rows, "out")


def _event_nodes(g: Graph, events: DataFrame, counted: DataFrame, defs: DataFrame, node_type: str, reagent_id: Column | None) -> DataFrame:
    """The events without an error, and the reagents that are new for their roles."""
    good = events.join(counted.where("faulty").select("event_id", "graph"), ["event_id", "graph"], "left_anti")
    label = "ProtocolEvent" if node_type == "PROTOCOL_EVENT" else "NaturalEvent"
    nodes = _shaped(good.withColumn("id", F.col("event_id")), NODE_COLUMNS, g.nodes, label=label, node_type=node_type)
    return nodes.unionByName(_shaped(counted_reagents(counted, defs, reagent_id), NODE_COLUMNS, g.nodes, label="Reagent", node_type="REAGENT"))


def _counted(g: Graph, events: DataFrame, fillers: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """``counted_roles``, stored: a row per event, not one per role."""
    counted, defs = counted_roles(events, fillers, g.catalog["role_defs"], active_reagent(g), key)
    return checkpointed(counted), defs


def record_events(g: Graph, events: DataFrame, fillers: DataFrame, node_type: str = "PROTOCOL_EVENT", reagent_id: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, participant edges, errors). Roles are resolved first; an event with an error is not written.

    events: graph, event_id, category_id, external_id, valid_from, and valid_to, name, created_at, variables, local_seq if there are any.
    fillers: graph, event_id, direction, role, member_id, quantity. nodes: the events, and the reagents that are new for their roles,
    with ids as ``roles.new_reagents`` gives them.
    """
    counted, defs = _counted(g, events, fillers)
    rows, errors = counted_edges(counted, defs, fillers, reagent_id)
    return _event_nodes(g, events, counted, defs, node_type, reagent_id), in_edges_for_event(rows).unionByName(out_edges_for_event(rows)), errors


def _met_events(g: Graph, inputs: DataFrame, new_ids: int, node_type: str) -> DataFrame:
    """The last input of each external id, with the event that is known by it (``_known``, ``_seq``) and the id that it has or gets."""
    key = ["external_id", "graph", "category_id"]
    last = latest_per_external_id(inputs, key, ["created_at", "input_no"])
    known = g.nodes.where((F.col("node_type") == node_type) & F.col("external_id").isNotNull()).select(*key, F.col("id").alias("_known"), F.col("local_seq").alias("_seq"), "category_type")
    return checkpointed(last.join(known, key, "left").withColumn("event_id", F.coalesce("_known", F.lit(new_ids) + F.col("input_no"))))


def _upserted_nodes(g: Graph, met: DataFrame, counted: DataFrame, defs: DataFrame, node_type: str, sequence: dict | None, reagent_id: Column | None) -> DataFrame:
    events = met.withColumn("local_seq", F.col("_seq"))
    if sequence is not None:
        asks = F.col("_known").isNull() & F.col("category_id").isNotNull() & F.col("input_no").isNotNull()
        events = events.where(~asks).unionByName(numbered(met.where(asks), "category_id", "input_no", given=_given(g, node_type), **sequence))
    return _event_nodes(g, events, counted, defs, node_type, reagent_id)


def _with_event_nodes(g: Graph, nodes: DataFrame, node_type: str) -> Graph:
    """The graph with events and new reagents in place of those with their ids; nodes of other types aren't compared."""
    mine = F.coalesce(F.col("node_type").isin(node_type, "REAGENT"), F.lit(False))
    kept = g.nodes.where(mine).join(nodes.select("graph", "id"), ["id", "graph"], "left_anti")
    return g.with_nodes(g.nodes.where(~mine).select(*NODE_COLUMNS).unionByName(kept.select(*NODE_COLUMNS)).unionByName(nodes))


def _with_event_edges(g: Graph, edges: DataFrame) -> Graph:
    """The graph with those of the edges that it hasn't yet. Both are counted together, after they are dealt: hardly any repeats, so counting before that would hold nearly all of them."""
    alike = ["src", "dst", "graph", "role", "quantity"]
    both = g.edges.where("edge_type = 'PARTICIPANT'").select(*alike, F.lit(0).alias("_new")).unionByName(edges.select(*alike, F.lit(1).alias("_new")))
    counts = both.repartition("src", "dst").groupBy(*alike).agg(F.sum("_new").alias("_n"), (F.count("*") - F.sum("_new")).alias("_there"))
    more = counts.where("_n > _there").withColumn("nth", F.explode(F.sequence(F.col("_there") + 1, F.col("_n")).cast("array<int>"))).withColumn("label", F.col("role"))
    amount = F.coalesce(F.col("quantity").cast("string"), F.lit(""))
    hashed = F.xxhash64("graph", "src", "dst", "role", amount, "nth").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    added = checkpointed(_shaped(more.withColumn("id", hashed), EDGE_COLUMNS, g.edges, edge_type="PARTICIPANT", category_id=None))  # read by either end
    return g.with_edges(g.edges.select(*EDGE_COLUMNS).unionByName(added))


def upsert_event_nodes(g: Graph, inputs: DataFrame, fillers: DataFrame, new_ids: int, node_type: str = "PROTOCOL_EVENT", sequence: dict | None = None, reagent_id: Column | None = None) -> tuple[Graph, DataFrame]:
    """As ``upsert_events``, for whom nodes and errors are enough: no edge is looked up or made, the graph keeps those that it has."""
    met = _met_events(g, inputs, new_ids, node_type)
    counted, defs = _counted(g, met, fillers, "input_no")
    _, errors = counted_edges(counted, defs, fillers, reagent_id, "input_no")
    return _with_event_nodes(g, _upserted_nodes(g, met, counted, defs, node_type, sequence, reagent_id), node_type), errors


def upsert_event_edges(g: Graph, inputs: DataFrame, fillers: DataFrame, new_ids: int, node_type: str = "PROTOCOL_EVENT", reagent_id: Column | None = None) -> tuple[Graph, DataFrame]:
    """As ``upsert_events``, for whom edges and errors are enough: no node is made, the graph keeps those that it has."""
    counted, defs = _counted(g, _met_events(g, inputs, new_ids, node_type), fillers, "input_no")
    rows, errors = counted_edges(counted, defs, fillers, reagent_id, "input_no")
    return _with_event_edges(g, in_edges_for_event(rows).unionByName(out_edges_for_event(rows))), errors


def upsert_events(g: Graph, inputs: DataFrame, fillers: DataFrame, new_ids: int, node_type: str = "PROTOCOL_EVENT", sequence: dict | None = None, reagent_id: Column | None = None) -> tuple[Graph, DataFrame]:
    """(graph with the events and their participant edges, errors). An event whose external id its category has already is updated: name, times, window and variables.

    inputs: graph, category_id, external_id, name, created_at, valid_from, valid_to, variables, input_no; the last of an external id
    holds. fillers: graph, input_no, direction, role, member_id, quantity. An event keeps the participant edges it has and gets those that it hasn't:
    the nth filler of a role, member and quantity is the nth such edge. Its id is a hash of all that, so ids differ, and a repeat changes nothing.
    """
    met = _met_events(g, inputs, new_ids, node_type)
    counted, defs = _counted(g, met, fillers, "input_no")
    rows, errors = counted_edges(counted, defs, fillers, reagent_id, "input_no")
    nodes = checkpointed(_upserted_nodes(g, met, counted, defs, node_type, sequence, reagent_id))
    return Graph(_with_event_nodes(g, nodes, node_type).nodes, _with_event_edges(g, in_edges_for_event(rows).unionByName(out_edges_for_event(rows))).edges, g.catalog), errors


def catalog_upsert(categories: DataFrame, inputs: DataFrame, keys: tuple[str, ...] = ("graph", "kind", "name")) -> DataFrame:
    """Bulk update-or-create: new values over old, old ones where the new are null; ids of new rows come with the inputs."""
    rest = [c for c in categories.columns if c not in keys]
    new = inputs.select(*keys, *[F.col(c).alias(f"in_{c}") for c in rest])
    met = categories.join(new, list(keys), "full_outer")
    return met.select(*keys, *[F.coalesce(c, f"in_{c}").alias(c) if c.endswith("_id") else F.coalesce(f"in_{c}", c).alias(c) for c in rest])


def drop_graph_partition(g: Graph, graph: str) -> Graph:
    """All facts but those of one graph."""
    return Graph(g.nodes.where(F.col("graph") != graph), g.edges.where(F.col("graph") != graph), g.catalog)


def drop_stored_graph(spark: SparkSession, path: str, graph: str) -> None:
    """Deletes the partitions of one graph from what ``sink_parquet`` has written; nothing else is touched, and a repeat does no harm."""
    for name in ("nodes", "edges"):
        Folder(spark, path).delete(f"{name}/graph={graph}")


def sink_parquet(g: Graph, path: str) -> None:
    """Nodes and edges as Parquet, partitioned by graph and type, so that scans prune by both."""
    g.nodes.write.mode("overwrite").partitionBy("graph", "node_type").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").partitionBy("graph", "edge_type").parquet(f"{path}/edges")


def read_parquet(spark, path: str, catalog: dict[str, DataFrame] | None = None) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes").select(*NODE_COLUMNS), spark.read.parquet(f"{path}/edges").select(*EDGE_COLUMNS), catalog or {})


def snapshot_view(result: DataFrame, path: str, name: str, as_of: str, valid_from: str | None = None, valid_to: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Stores a query's result as of a time, as a version of its own, and returns it as read from there. A repeat makes the next version; those before stay readable.

    Files of a version are written first, into a folder that no other has, and its row of the manifest last, by a rename: what was begun and not
    ended isn't seen. With ``keys``, which tell rows apart, only what differs from the newest snapshot of the view with such keys is stored: rows that are
    new or changed, and keys that are gone. ``snapshot_manifest`` lists the newest versions, ``read_snapshot`` reads any.
    """
    spark, folder = result.sparkSession, Folder(result.sparkSession, path)
    known = _snapshots(folder, name)
    base = max((s for s in known if s.get("keys") == keys and s["columns"] == result.columns), key=lambda s: s["number"], default=None) if keys else None
    number = max((s["number"] for s in known), default=-1) + 1
    files = f"views/{name}/{number}-{uuid.uuid4().hex}"
    if base is None:
        result.write.parquet(f"{path}/{files}/rows")
    else:
        before, now = read_snapshot(spark, path, name, base["as_of"], base["version"]), checkpointed(result)
        rest = [c for c in result.columns if c not in keys]
        told = before.select(*keys, F.struct(*rest).alias("_before") if rest else F.lit(1).alias("_before"))
        changed = now.join(told, keys, "left").where(F.col("_before").isNull() | (~F.col("_before").eqNullSafe(F.struct(*rest)) if rest else F.lit(False)))
        changed.select(*result.columns).write.parquet(f"{path}/{files}/rows")
        before.join(now, keys, "left_anti").select(*keys).write.parquet(f"{path}/{files}/gone")
    same = [s for s in known if s["as_of"] == as_of]
    row = {"view": name, "as_of": as_of, "valid_from": valid_from, "valid_to": valid_to, "number": number, "version": len(same), "files": files, "keys": keys, "columns": result.columns}
    row |= {"base": base and [base["as_of"], base["version"]], "depth": base["depth"] + 1 if base else 0, "schema": result.schema.json(), "materialized_at": datetime.now(timezone.utc).isoformat()}
    row["n_rows"] = _snapshot_rows(spark, path, row, {(s["as_of"], s["version"]): s for s in known}).count()
    folder.publish(f"manifest/{name}/{number}", json.dumps(row))
    return read_snapshot(spark, path, name, as_of)


def _snapshots(folder: Folder, name: str) -> list[dict]:
    return [json.loads(folder.read(f"manifest/{name}/{n}")) for n in folder.names(f"manifest/{name}")]


def _snapshot_rows(spark: SparkSession, path: str, row: dict, known: dict[tuple, dict]) -> DataFrame:
    """The rows of a version: its own, and of the one that it differs from those with other keys, unless they are gone."""
    schema = StructType.fromJson(json.loads(row["schema"]))
    rows = spark.read.schema(schema).parquet(f"{path}/{row['files']}/rows")
    if row["base"] is None:
        return rows
    keys = row["keys"]
    gone = spark.read.schema(StructType([schema[k] for k in keys])).parquet(f"{path}/{row['files']}/gone")
    kept = _snapshot_rows(spark, path, known[tuple(row["base"])], known).join(rows.select(*keys).unionByName(gone), keys, "left_anti")
    return kept.select(*row["columns"]).unionByName(rows.select(*row["columns"]))


def read_snapshot(spark: SparkSession, path: str, name: str, as_of: str, version: int | None = None) -> DataFrame:
    """A version of a view as of a time, counted from 0; the newest, unless one is given."""
    known = {(s["as_of"], s["version"]): s for s in _snapshots(Folder(spark, path), name)}
    if version is None:
        version = max((v for t, v in known if t == as_of), default=0)
    if (as_of, version) not in known:
        raise KeyError(f"no version {version} of {name} as of {as_of}")
    return _snapshot_rows(spark, path, known[as_of, version], known)


def snapshot_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(view, as_of, valid_from, valid_to, n_rows, version, materialized_at) of the newest version of all stored snapshots."""
    folder = Folder(spark, path)
    newest = {(s["view"], s["as_of"]): s for view in folder.names("manifest") for s in sorted(_snapshots(folder, view), key=lambda s: s["number"])}
    text = "view string, as_of string, valid_from string, valid_to string, n_rows long, version long, materialized_at string"
    names = [c.split()[0] for c in text.split(", ")]
    rows = spark.createDataFrame([tuple(s[c] for c in names) for s in newest.values()], text)
    return rows.withColumns({"valid_from": F.col("valid_from").cast("timestamp_ntz"), "valid_to": F.col("valid_to").cast("timestamp_ntz"), "materialized_at": F.col("materialized_at").cast("timestamp")})
