"""A graph of six nodes and six edges, with results worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import aggregate, expand, paging, pattern, roles, scan, temporal
from weftgraph.plans import catalogue
from weftgraph.schema import EDGE_COLUMNS, NODE_COLUMNS, Graph
from weftgraph.sources import ingest

T = [datetime(2024, 1, d) for d in (1, 2, 3, 4)]
NODE_SCHEMA = "graph string, id long, label string, node_type string, category_id long, category_type string, external_id string, name string, identifier string, object string, active boolean, value_float double, created_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, local_seq long, value string, variables array<struct<key:string,value:string>>"
EDGE_SCHEMA = "graph string, id long, label string, edge_type string, category_id long, src long, dst long, role string, quantity double, valid_from timestamp_ntz, valid_to timestamp_ntz"


@pytest.fixture(scope="module")
def g(spark):
    nodes = [("t", i, "Entity", "ENTITY", 1, "thing", f"x{i}", f"Node {i}", None, None, None, None, T[0], None, None, None, None, None) for i in range(1, 7)]
    ends = [(1, 2, T[1], T[3]), (2, 3, T[2], None), (3, 1, None, T[2]), (1, 1, None, None), (1, 2, None, None), (4, 5, None, None)]
    edges = [("t", i, "KNOWS", "RELATION", 9, a, b, None, None, x, y) for i, (a, b, x, y) in enumerate(ends, 1)]
    return Graph(spark.createDataFrame(nodes, NODE_SCHEMA).cache(), spark.createDataFrame(edges, EDGE_SCHEMA).cache())


def one(spark, *ids):
    return spark.createDataFrame([("t", i) for i in ids], "graph string, id long")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_columns(g):
    assert tuple(g.nodes.columns) == NODE_COLUMNS and tuple(g.edges.columns) == EDGE_COLUMNS


def test_incident_edges(spark, g):
    assert ids(expand.out_edges(g, one(spark, 1))) == [1, 4, 5]
    assert ids(expand.in_edges(g, one(spark, 1))) == [3, 4]
    assert ids(expand.incident_edges(g, one(spark, 1))) == [1, 3, 4, 5]


def test_neighbors(spark, g):
    assert sorted((r.edge_id, r.neighbor_id) for r in expand.neighbors(g, one(spark, 1)).collect()) == [(1, 2), (3, 3), (5, 2)]


def test_pages(g):
    assert paging.page_edges(g, "t").count() == 10
    assert paging.page_edges(g, "t", with_self=True).count() == 11
    first, second = paging.page_nodes(g, "t", limit=2), paging.page_nodes(g, "t", offset=2, limit=2)
    assert ids(first) + ids(second) == ids(paging.page_nodes(g, "t", limit=4))


def test_self_loops(g):
    assert ids(expand.self_loop_metrics(g)) == [4]


def test_pattern(g):
    found = pattern.match_pattern(g, [pattern.Node(x) for x in "abc"], [pattern.Edge("e"), pattern.Edge("f")])
    rows = {(r.e, r.f) for r in found.collect()}
    assert found.count() == 8 and (4, 4) not in rows


def test_variable_length_uses_an_edge_once(spark, g):
    walks = pattern.match_variable_length(g, one(spark, 1), 1, 4)
    assert all(len(set(r.edge_ids)) == len(r.edge_ids) for r in walks.collect())
    nodes, edges = pattern.path_graph(walks, g)
    assert ids(nodes) == [1, 2, 3] and ids(edges) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize(("start", "reached"), [(1, [2, 3]), (4, [5]), (6, [])])
def test_lineage(spark, g, start, reached):
    assert ids(pattern.lineage(g, one(spark, start)), "node_id") == reached


def test_degree(g):
    r = expand.degree(g).where("id = 1").first()
    assert (r.out_degree, r.in_degree, r.incident) == (3, 2, 4)
    assert expand.degree(g).where("id = 6").first().incident == 0


def test_validity(g):
    bounded = g.edges.where("valid_from IS NOT NULL OR valid_to IS NOT NULL")
    assert [ids(temporal.valid_at(bounded, t)) for t in T[1:]] == [[1, 3], [1, 2], [2]]


def test_upsert_twice_is_upsert_once(spark, g):
    rows = [("t", 1, "new", "x1", T[3], 1), ("t", 1, "newer", "x1", T[3], 2), ("t", 1, "fresh", "y", T[3], 3), ("t", 1, "loose", None, T[3], 4)]
    inputs = spark.createDataFrame(rows, "graph string, category_id long, name string, external_id string, created_at timestamp_ntz, input_no long")
    once = ingest.ingest_entities(g, inputs, 100)
    names = {r.id: r.name for r in once.nodes.collect()}
    assert names[1] == "newer" and names[103] == "fresh" and names[104] == "loose" and len(names) == 8
    keyed = inputs.where("external_id IS NOT NULL")
    assert sorted(ingest.ingest_entities(once, keyed, 100).nodes.collect()) == sorted(once.nodes.collect())


def test_relations_need_both_ends(spark, g):
    inputs = spark.createDataFrame([("t", 1, 2, "R", 9, 1), ("t", 1, 99, "R", 9, 2)], "graph string, src long, dst long, label string, category_id long, input_no long")
    made, bad = ingest.ingest_relations(g, inputs, 100)
    assert ids(made.edges)[-1] == 101 and [(r.input_no, r.missing) for r in bad.collect()] == [(2, "dst")]


def test_numbers_don_t_depend_on_stretches(g):
    for width in (1, 2, 1 << 20):
        rows = aggregate.numbered(g.nodes, "category_id", "id", start=10, step=5, width=width).collect()
        assert {r.id: r.local_seq for r in rows} == {i: 5 + 5 * i for i in range(1, 7)}


def test_numbers_of_a_bounded_sequence(spark, g):
    given = spark.createDataFrame([(1, 2)], "category_id long, n_given long")
    seq = lambda **x: [r.local_seq for r in aggregate.numbered(g.nodes, "category_id", "id", start=10, step=5, **x).orderBy("id").collect()]
    assert seq(given=given) == [20, 25, 30, 35, 40, 45]
    assert seq(most=22) == [10, 15, 20, None, None, None]
    assert seq(most=22, least=2, given=given) == [20, 2, 7, 12, 17, 22]


def test_new_entities_go_on_with_the_numbers_of_their_category(spark, g):
    numbered_ = g.with_nodes(g.nodes.withColumn("local_seq", F.when(F.col("id") <= 4, F.col("id"))))
    rows = [("t", 1, None, "x1", T[3], 1), ("t", 1, "fresh", "y", T[3], 3), ("t", 1, "loose", None, T[3], 4)]
    inputs = spark.createDataFrame(rows, "graph string, category_id long, name string, external_id string, created_at timestamp_ntz, input_no long")
    got = {r.id: (r.name, r.local_seq) for r in ingest.ingest_entities(numbered_, inputs, 100, {"start": 1}).nodes.collect()}
    assert got[1] == (None, 1) and got[103] == ("fresh", 5) and got[104] == ("loose", 6) and got[5] == ("Node 5", None)


def test_windows_close_whatever_their_stretch(spark, g):
    rows = [(1, 1, T[0]), (2, 1, T[0]), (3, 1, T[2]), (4, 1, None), (5, 1, None), (6, 2, T[1]), (7, 2, T[3]), (8, 3, None)]
    edges = spark.createDataFrame([("t", i, "m", "MEASUREMENT", 1 if i % 2 else None, 9, d, None, None, t, None) for i, d, t in rows], EDGE_SCHEMA)
    key = lambda r: (r[1], r[0] % 2)
    expected = {}
    for r in rows:
        later = sorted((x for x in rows if key(x) == key(r)), key=lambda x: (x[2] is not None, x[2] or T[0], x[0]))
        after = later[later.index(r) + 1 :]
        expected[r[0]] = after[0][2] if after else None
    for days in (1, 32):
        assert {r.id: r.valid_to for r in aggregate.close_open_windows(g.with_edges(edges), days).collect()} == expected


def test_measurements_at_events(spark, g):
    windows = [(1, T[0], T[1]), (2, T[1], None), (3, None, T[2]), (4, None, None), (5, T[0], T[3])]
    edges = [("t", i, "m", "MEASUREMENT", 1, 50 + i, 1, None, None, a, b) for i, a, b in windows] + [("t", 10 + k, "p", "PARTICIPANT", None, 1, 20 + k, "p", None, None, None) for k in range(4)]
    events = [("t", 20 + k, "E", "NATURAL_EVENT", 2, "e", None, None, None, None, None, None, None, T[k], None, None, None, None) for k in range(4)]
    both = Graph(g.nodes.unionByName(spark.createDataFrame(events, NODE_SCHEMA)), spark.createDataFrame(edges, EDGE_SCHEMA))
    expected = {(20 + k, 50 + i) for k in range(4) for i, a, b in windows if (a is None or a <= T[k]) and (b is None or b > T[k])}
    rows = temporal.measurement_at_event(both).collect()
    assert {(r.event_id, r.structure_id) for r in rows} == expected and len(rows) == len(expected)


def test_events_are_updated_by_their_external_id(spark, g):
    defs = [(6, "in", "a", False, False, None, None), (6, "in", "n", False, True, None, 201)]
    catalog = {"role_defs": spark.createDataFrame(defs, "event_category_id int, direction string, role string, optional boolean, variable_amount boolean, default_use_active int, default_use_new int")}
    known = spark.createDataFrame([("t", 30, "ProtocolEvent", "PROTOCOL_EVENT", 6, "order", "e1", "old", None, None, None, None, T[0], T[0], T[1], 4, None, None)], NODE_SCHEMA)
    both = Graph(g.nodes.unionByName(known), g.edges, catalog)
    rows = [("t", 6, "e1", "new", T[2], T[2], None, [("k", "v")], 1), ("t", 6, "e2", "fresh", T[2], T[2], T[3], None, 2), ("t", 6, "e3", "bad", T[2], T[2], None, None, 3)]
    inputs = spark.createDataFrame(rows, "graph string, category_id long, external_id string, name string, created_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, variables array<struct<key:string,value:string>>, input_no long")
    fillers = spark.createDataFrame([("t", 1, "in", "a", 1, None), ("t", 2, "in", "a", 2, 1.5)], "graph string, input_no long, direction string, role string, member_id long, quantity double")
    made, errors = ingest.upsert_events(both, inputs, fillers, 100, sequence={"start": 1}, reagent_id=F.lit(900) + F.col("event_id"))
    events = {r.id: (r.external_id, r.name, r.valid_to, r.local_seq, r.variables and r.variables[0].value) for r in made.nodes.where("node_type = 'PROTOCOL_EVENT'").collect()}
    assert events == {30: ("e1", "new", None, 4, "v"), 102: ("e2", "fresh", T[3], 2, None)}
    assert ids(made.nodes.where("node_type = 'REAGENT'")) == [930, 1002]
    new = made.edges.where("edge_type = 'PARTICIPANT'").collect()
    assert sorted((r.src, r.dst, r.role, r.quantity) for r in new) == [(1, 30, "a", None), (2, 102, "a", 1.5), (930, 30, "n", None), (1002, 102, "n", None)]
    assert [(r.event_id, r.role, r.outcome) for r in errors.collect()] == [(103, "a", "missing")]
    again, _ = ingest.upsert_events(made, inputs.where("input_no = 2"), fillers.where("input_no = 2"), 200, reagent_id=F.lit(900) + F.col("event_id"))
    assert again.nodes.where("node_type = 'PROTOCOL_EVENT'").count() == 2


def test_values_of_metric_kinds(spark, g):
    rows = [(1, "INT", "007"), (2, "INT", "1.5"), (3, "BOOLEAN", "TRUE"), (4, "THREE_D_VECTOR", "[1, 2, 3]"), (5, "THREE_D_VECTOR", "[1]"), (6, "N_VECTOR", "[1]"), (7, "DATETIME", "soon"), (8, "STRING", "s"), (9, "odd", "s"), (10, None, "2.5"), (11, "FLOAT", None)]
    d = spark.createDataFrame(rows, "i int, kind string, value string")
    assert {r.i: r.v for r in d.select("i", ingest.typed_text("value", "kind").alias("v")).collect() if r.v} == {1: "7", 3: "true", 4: "[1.0,2.0,3.0]", 6: "[1.0]", 8: "s"}


def test_roles(spark):
    defs = [(6, "in", "a", False, False, None, None), (6, "in", "b", True, True, None, None), (6, "in", "c", False, True, 200, None), (6, "out", "d", False, False, None, None), (6, "out", "n", False, True, None, 201)]
    role_defs = spark.createDataFrame(defs, "event_category_id int, direction string, role string, optional boolean, variable_amount boolean, default_use_active int, default_use_new int")
    events = spark.createDataFrame([("t", 1, 6), ("t", 2, 6)], "graph string, event_id long, category_id long")
    fillers = spark.createDataFrame([("t", 1, "in", "a", 50, None), ("t", 1, "out", "d", 51, 2.0), ("t", 2, "in", "a", 50, None), ("t", 2, "in", "a", 52, None)], "graph string, event_id long, direction string, role string, member_id long, quantity double")
    active = spark.createDataFrame([(200, 77)], "category_id long, reagent_id long")
    resolved = roles.resolve_roles(events, fillers, role_defs, active)
    got = {(r.event_id, r.role): r.outcome for r in resolved.collect()}
    assert got == {(1, "a"): "filled", (1, "b"): "skipped", (1, "c"): "default_active", (1, "d"): "filled", (1, "n"): "default_new", (2, "a"): "too_many", (2, "b"): "skipped", (2, "c"): "default_active", (2, "d"): "missing", (2, "n"): "default_new"}
    rows, errors = roles.resolved_edges(resolved, fillers, F.lit(500) + F.col("event_id"))
    assert {(r.event_id, r.role, r.member_id) for r in rows.collect()} == {(1, "a", 50), (1, "d", 51), (1, "c", 77), (1, "n", 501)}
    made = roles.new_reagents(resolved)
    assert [(r.category_id, r.event_id, r.role) for r in made.collect()] == [(201, 1, "n")] and made.first().id >= 1 << 62
    assert {r.event_id for r in errors.collect()} == {2}


def test_no_cartesian_products(spark, g):
    plan = expand.paired_nodes(g)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_malformed_ids(spark, g):
    gids = spark.createDataFrame([("t:1",), ("t:x",), ("t",), (None,)], "gid string")
    assert ids(scan.nodes_by_id(g, gids)) == [1]


def test_streams_of_many_batches_in_any_order_of_time(spark, g, tmp_path, monkeypatch):
    rows = [(i, i % 7 if i < 25 else i, f"2024-01-{1 + i * 11 % 29:02} 00:00:00", f"type{i}") for i in range(30)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    read = catalogue.stream.read_events
    monkeypatch.setattr(catalogue.stream, "read_events", lambda s, d: read(s, d, files_per_batch=1))
    newest = {}
    for event_id, user_id, ts, name in rows:
        newest[user_id] = max(newest.get(user_id, ("", 0, "")), (ts, event_id, name))
    assert {(r.user_id, r.name) for r in catalogue._upserted(g, spark, str(tmp_path)).collect()} == {(u, x[2]) for u, x in newest.items()}
    assert sorted((r.event_id, r.user_id) for r in catalogue._deduped(None, spark, str(tmp_path)).collect()) == [r[:2] for r in rows]
