"""What is built for size: plans without shuffles, joins that meet little more than they give, rounds and rows that stay few."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_golden import EDGE_SCHEMA, NODE_SCHEMA
from weftgraph.operators import audit, expand, paging, pattern, roles, scan, temporal
from weftgraph.schema import Graph
from weftgraph.sources import ingest
from weftgraph.sources.adjacency import is_stored, read_adjacency, store_adjacency


def node(i, label="N", kind="ENTITY", category=1, at=None):
    return ("t", i, label, kind, category, "c", None, f"n{i}", None, None, None, None, None, at, None, None, None, None)


def edge(i, src, dst, label="e", kind="RELATION", a=None, b=None):
    return ("t", i, label, kind, 1, src, dst, None, None, a, b)


def graph(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA))


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.fixture(scope="module")
def tangled(spark):
    """A random graph with a hub at either end, self loops and edges between the same nodes."""
    rng = random.Random(3)
    ends = [(rng.randrange(60), rng.randrange(60)) for _ in range(300)] + [(7, rng.randrange(60)) for _ in range(150)] + [(rng.randrange(60), 9) for _ in range(150)]
    kinds = ("ENTITY", "STRUCTURE", "METRIC")
    edges = [edge(i, a, b, f"l{i % 3}", {"METRIC": "DESCRIPTION", "STRUCTURE": "MEASUREMENT"}.get(kinds[a % 3], "RELATION")) for i, (a, b) in enumerate(ends)]
    return graph(spark, [node(i, f"L{i % 4}", kinds[i % 3], i % 5) for i in range(60)], edges)


@pytest.fixture(scope="module")
def stored(spark, tangled, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout"))
    assert not is_stored(spark, path)
    store_adjacency(tangled, path, buckets=4, hub_edges=50)
    assert is_stored(spark, path)
    return read_adjacency(spark, path), path


def test_layout_gives_the_same_rows(spark, tangled, stored):
    g, path = stored
    assert g.sides["src"].hubs.select("id" if "id" in g.sides["src"].hubs.columns else "src").collect()[0][0] == 7
    assert rows(g.edges) == rows(tangled.edges) and rows(g.nodes) == rows(tangled.nodes)
    some = lambda x: x.nodes.where("id % 2 = 1").select("graph", "id")
    a, b = pattern.Node("a", label="L1"), pattern.Node("b", category_id=2)
    for f in (
        lambda x: expand.incident_edges(x, some(x)), lambda x: expand.neighbors(x, some(x)), expand.degree, expand.paired_nodes, lambda x: expand.paired_nodes(x, with_self=True),
        pattern.measurement_path, expand.structure_measures, expand.structure_metrics, lambda x: pattern.lineage(x, some(x)), lambda x: expand.paired_nodes(x, edge="label = 'l1'", dedupe=True),
        lambda x: pattern.match_pattern(x, [a, pattern.Node("m"), b], [pattern.Edge("e", "l0"), pattern.Edge("f", direction="-")]),
        lambda x: pattern.match_variable_length(x, some(x), 1, 2, direction="-"),
    ):
        assert rows(f(g)) == rows(f(tangled))
    assert rows(expand.degree(g.of("t"))) == rows(expand.degree(tangled))
    # a session that doesn't know the tables finds them by the path alone
    for name in ("nodes", "edges_src", "edges_dst"):
        spark.sql(f"DROP TABLE {[t.name for t in spark.catalog.listTables() if t.name.startswith(f'weftgraph_{name}_')][-1]}")
    again = read_adjacency(spark, path)
    assert rows(again.edges) == rows(tangled.edges) and rows(expand.degree(again)) == rows(expand.degree(tangled))


def test_hops_shuffle_no_stored_table(spark, tangled, tmp_path):
    store_adjacency(tangled, str(tmp_path), buckets=4)
    g = read_adjacency(spark, str(tmp_path))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = g.nodes.where("category_id = 1").select("graph", "id")
        for df, most in ((expand.neighbors(g, ids), 1), (pattern.measurement_path(g), 2), (expand.degree(g), 0)):
            lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
            exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
            assert len(exchanges) <= most
            for i in exchanges:  # what is shuffled are matches, not a scan
                below = [line for line in lines[i + 1 :] if len(line) - len(line.lstrip(" :+-")) > len(lines[i]) - len(lines[i].lstrip(" :+-"))]
                assert any("Join" in line for line in below)
            assert sum("Bucketed: true" in line for line in lines) >= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_interval_join(spark):
    rng = random.Random(4)
    t0 = datetime(2024, 1, 1)
    time = lambda top: t0 + timedelta(seconds=rng.randrange(top), milliseconds=rng.choice((0, 0, 500)))
    points = [(rng.choice("ab"), i, None if i % 50 == 0 else time(100_000)) for i in range(300)]
    windows = [(rng.choice("abc"), i, *rng.choice(((time(90_000), time(110_000)), (time(90_000), None), (None, time(100_000)), (None, None), (time(1000), time(1200))))) for i in range(200)]
    p, w = spark.createDataFrame(points, "k string, p long, at timestamp_ntz"), spark.createDataFrame(windows, "k string, w long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    expected = sorted((i, j) for k, i, at in points for l, j, a, b in windows if k == l and at and (a is None or a <= at) and (b is None or at < b))
    for group in (1_000, 3):
        assert sorted((r.p, r.w) for r in temporal.interval_join(p, w, ["k"], group=group).collect()) == expected
    assert temporal.interval_join(p.where("p < 0"), w, ["k"]).count() == temporal.interval_join(p, w.where("w < 0"), ["k"]).count() == 0
    one = temporal.interval_join(p.where("p = 1"), w, ["k"])
    assert sorted((r.p, r.w) for r in one.collect()) == [x for x in expected if x[0] == 1]


def test_a_hot_entity_with_many_open_windows(spark):
    """20,000 windows, open and short ones, and 5,000 events of one entity: what meets is little more than what is found."""
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 50).cast("timestamp_ntz")
    w = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("w"), start.alias("valid_from"), F.when(F.col("id") % 100 != 0, F.timestamp_seconds(F.lit(1_700_000_007) + F.col("id") * 50).cast("timestamp_ntz")).alias("valid_to"))
    p = spark.range(5_000).select(F.lit("k").alias("k"), F.col("id").alias("p"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 203).cast("timestamp_ntz").alias("at"))
    met = temporal._meetings(p, w, ["k"], "at", "valid_from", "valid_to", 1_000).count()
    found = temporal.interval_join(p, w, ["k"]).count()
    assert found <= met <= 1.05 * found + 5_000 and found > 400_000


def test_windows_of_many_entities_are_not_cut(spark, monkeypatch):
    """1,000 entities with 5 long windows and 4 points each, half of them before all windows: no more is stored than what comes in, and points that no window can hold aren't."""
    time = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) + seconds).cast("timestamp_ntz")
    nth = F.col("id") % 5
    w = spark.range(5_000).select(F.floor(F.col("id") / 5).alias("k"), F.col("id").alias("w"), time(nth * 99_999).alias("valid_from"), F.when(nth < 4, time((nth + 1) * 99_999)).alias("valid_to"))
    p = spark.range(4_000).select(F.floor(F.col("id") / 4).alias("k"), F.col("id").alias("p"), time(F.when(F.col("id") % 2 == 0, F.col("id") * 99).otherwise(-F.col("id"))).alias("at"))
    stored, store = [], temporal.checkpointed
    monkeypatch.setattr(temporal, "checkpointed", lambda df: stored.append(store(df)) or stored[-1])
    got = sorted((r.p, r.w) for r in temporal.interval_join(p, w, ["k"]).collect())
    assert got == [(i, i // 4 * 5 + min(i * 99 // 99_999, 4)) for i in range(0, 4_000, 2)]
    assert sum(df.count() for df in stored) <= 5_000 + 2_000


def hops(edges, starts):
    out = []
    for s in starts:
        seen, frontier, n = {s: 0}, [s], 0
        while frontier:
            n += 1
            frontier = {b for a in frontier for b in edges.get(a, ())} - set(seen)
            seen |= dict.fromkeys(frontier, n)
        out += [(s, v, n) for v, n in seen.items() if n]
    return sorted(out)


def test_lineage_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    n = 10_000
    chain = [edge(i, i, i + 1) for i in range(n)]
    made = []
    cut = pattern.checkpointed
    monkeypatch.setattr(pattern, "checkpointed", lambda df: made.append(cut(df)) or made[-1])
    got = pattern.lineage(graph(spark, [node(0)], chain), spark.createDataFrame([("t", 0), ("t", 9_000)], "graph string, id long"))
    assert sorted((r.start_id, r.node_id, r.hops) for r in got.collect()) == [(0, i, i) for i in range(1, n + 1)] + [(9_000, 9_000 + i, i) for i in range(1, n - 9_000 + 1)]
    assert sum("hops" in df.columns for df in made) <= 20


@pytest.mark.parametrize("growth", [0, 2, 100])
def test_lineage_equals_going_hop_by_hop(spark, growth):
    rng = random.Random(growth)
    ends = [(i, i + 1) for i in range(40)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(50, 51), (51, 52), (52, 50), (5, 5)]
    g = graph(spark, [node(0)], [edge(i, a, b) for i, (a, b) in enumerate(ends)])
    forth, back = {}, {}
    for a, b in ends:
        forth.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)
    anchors = spark.createDataFrame([("t", 0), ("t", 50), ("t", 99)], "graph string, id long")
    both = {k: forth.get(k, set()) | back.get(k, set()) for k in {*forth, *back}}
    for direction, edges in ((">", forth), ("<", back), ("-", both)):
        found = lambda **named: sorted((r.start_id, r.node_id, r.hops) for r in pattern.lineage(g, anchors, direction, growth=growth, plain_hops=1, **named).collect())
        assert found() == hops(edges, (0, 50, 99))
        assert found(max_hops=4) == [x for x in hops(edges, (0, 50, 99)) if x[2] <= 4]


def test_patterns_grow_only_what_can_be_completed(spark, monkeypatch):
    """1,000 x 50 edges lead to nodes of which one leads on: without a reduction the second hop would make 50,000 rows."""
    nodes = [node(i, "A") for i in range(1_000)] + [node(2_000 + i, "B") for i in range(50)] + [node(3_000, "C"), node(3_001, "D"), node(3_002, "D")]
    edges = [edge(i * 50 + j, i, 2_000 + j, "ab") for i in range(1_000) for j in range(50)] + [edge(90_000 + j, 2_000 + j, 3_000 + j % 2, "bc") for j in range(50)] + [edge(99_000, 3_000, 3_002, "cd")]
    g = graph(spark, nodes, edges)
    sizes, hop = [], expand.hop
    monkeypatch.setattr(pattern, "hop", lambda *a: sizes.append(hop(*a)) or sizes[-1])
    specs = [pattern.Node("a", label="A"), pattern.Node("b", label="B"), pattern.Node("c", equals=(("name", "n3001"),)), pattern.Node("d", label="A")]
    assert pattern.match_pattern(g, specs, [pattern.Edge("x", "ab"), pattern.Edge("y", "bc"), pattern.Edge("z", "ab", direction="<")]).count() == 0
    assert max(df.count() for df in sizes) <= len(edges)
    sizes.clear()
    found = pattern.match_pattern(g, [*specs[:2], pattern.Node("c", label="C"), pattern.Node("d", label="D")], [pattern.Edge("x", "ab"), pattern.Edge("y", "bc"), pattern.Edge("z", "cd")])
    assert found.count() == 25_000 and max(df.count() for df in sizes) <= len(edges) + 25_000


def test_walks_to_given_ends_meet_in_the_middle(spark, tangled):
    starts, ends = (tangled.nodes.where(F.col("id").isin(*i)).select("graph", "id") for i in ((1, 2, 3), (9, 11)))
    for direction in "><-":
        every = pattern.match_variable_length(tangled, starts, 0, 3, direction=direction)
        to = every.join(ends.withColumnRenamed("id", "end_id"), ["graph", "end_id"], "left_semi")
        assert rows(pattern.match_variable_length(tangled, starts, 0, 3, direction=direction, ends=ends)) == rows(to)


def test_events_with_many_members_are_not_multiplied_out(spark):
    n = 10_000
    ends = [(1 + i, 0) for i in range(n)] + [(0, 1 + i) for i in range(n)]
    parts = spark.createDataFrame([("t", i, "p", "PARTICIPANT", None, a, b, "r", 0.5 if b == 0 else None, None, None) for i, (a, b) in enumerate(ends)], EDGE_SCHEMA)
    g = Graph(spark.createDataFrame([node(0, "P", "PROTOCOL_EVENT")], NODE_SCHEMA), parts)
    factors = pattern.event_factors(g)
    assert factors.select(F.max(F.size("members"))).first()[0] < 1_300
    assert [tuple(r) for r in pattern.factor_totals(factors).collect()] == [("t", 0, n, n, n * n, 0.5 * n * n)]


def test_deep_pages_are_those_of_a_full_sort(spark, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW", 20)
    monkeypatch.setattr(paging, "STRETCHES", 8)
    rng = random.Random(5)
    day = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(3)]
    ids = [*range(400), *[10**13 + rng.randrange(10**12) for _ in range(100)], -5]
    nodes = [node(i, at=rng.choice([None, *day, day[0] - timedelta(seconds=rng.randrange(10**7))])) for i in ids]
    edges = [edge(i % 90, rng.randrange(30), rng.randrange(30)) for i in range(300)]  # ids that repeat: ties on all keys
    g = graph(spark, nodes, edges)
    newest = sorted(nodes, key=lambda n: (n[12] is None, -(n[12] or day[0]).timestamp(), n[1]))
    both = sorted([(e[1], a, b) for e in edges if e[5] != e[6] for a, b in ((e[5], e[6]), (e[6], e[5]))])
    for offset in (0, 19, 21, 100, 399, 450, len(ids) - 1, len(ids), 10_000):
        assert [r.id for r in paging.page_nodes(g, "t", offset=offset, limit=7).collect()] == sorted(ids)[offset : offset + 7]
        assert [r.id for r in paging.latest_nodes(g, "t", offset=offset, limit=7).collect()] == [n[1] for n in newest][offset : offset + 7]
        assert [(r.id, r.left_id) for r in paging.page_edges(g, "t", offset=offset, limit=7).collect()] == [x[:2] for x in both][offset : offset + 7]
        sets = [g.nodes.where("id > 300"), g.nodes.where("id <= 100")]
        joined = [(0, i) for i in sorted(ids) if i > 300] + [(1, i) for i in sorted(ids) if i <= 100]
        assert [(r.set_no, r.id) for r in paging.page_concat(sets, "id", offset, 7).collect()] == joined[offset : offset + 7]
    assert [r.id for r in paging.page_nodes(g, "t", after=398, limit=2).collect()] == sorted(ids)[400:402]
    seen, last = [], None
    while page := paging.page_edges(g.with_edges(g.edges.dropDuplicates(["id"])), "t", limit=50, after=last).collect():
        seen += [(r.id, r.left_id) for r in page]
        last = seen[-1]
    assert seen == sorted(set(seen)) and len(seen) == 2 * g.edges.dropDuplicates(["id"]).where("src <> dst").count()


def test_a_deep_page_of_edges_stores_their_keys_alone(spark, monkeypatch):
    """What is located is three columns, and the page asks the edges for its own ids; other columns stay whole."""
    cuts, cut = [], paging.checkpointed
    monkeypatch.setattr(paging, "SHALLOW", 20)
    monkeypatch.setattr(paging, "checkpointed", lambda df: cuts.append(df.columns) or cut(df))
    rng = random.Random(6)
    edges = [edge(rng.randrange(10**15), rng.randrange(30), rng.randrange(30), f"l{i % 3}") for i in range(200)] + [edge(5, 7, 7)]
    g = graph(spark, [node(0)], edges)
    for with_self in (None, True):
        both = sorted({(e[1], a, b, e[2]) for e in edges if with_self or e[5] != e[6] for a, b in ((e[5], e[6]), (e[6], e[5]))})
        for offset in (25, 150, len(both) - 3, len(both)):
            found = paging.page_edges(g, "t", with_self, offset=offset, limit=9)
            assert [(r.id, r.left_id, r.right_id, r.label) for r in found.collect()] == both[offset : offset + 9]
    assert len(cuts) == 8 and all(c == ["id", "src", "dst"] for c in cuts)
    found = paging.page_edges(g, "t", offset=100, limit=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "(id" in found and "<=" in found  # bounded at both ends


def test_the_audit_of_measurements_sorts_by_id(spark):
    """Joins compare ids first, not the graph that all rows share; missing ends break the rule."""
    nodes = [node(1, kind="STRUCTURE"), node(2), node(3, kind="METRIC"), ("u", *node(2)[1:])]
    ends = [(1, 2), (2, 1), (3, 2), (1, 9), (9, 2), (1, 3)]
    g = graph(spark, nodes, [edge(i, a, b, kind="MEASUREMENT") for i, (a, b) in enumerate(ends)] + [("u", *edge(9, 1, 2, kind="MEASUREMENT")[1:]), edge(10, 2, 1)])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = audit.audit_measurement_direction(g)
        keys = re.findall(r"SortMergeJoin \[(\w+)#", found._jdf.queryExecution().executedPlan().toString())
        assert len(keys) >= 2 and "graph" not in keys
        assert sorted(map(tuple, found.collect()), key=repr) == sorted([("t", 1, "ENTITY", "STRUCTURE"), ("t", 2, "METRIC", "ENTITY"), ("t", 3, "STRUCTURE", None), ("t", 4, None, "ENTITY"), ("t", 5, "STRUCTURE", "METRIC"), ("u", 9, None, "ENTITY")], key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_search_reads_the_lists_of_its_trigrams(spark, tmp_path):
    names = [None, "", "ab", "abc", "ABCD", "xabcx", "bca", "Ünïcode ÄBC", "aaaa", "a_c%", *[f"item{i:05}" for i in range(3_000)]]
    nodes = [(*node(i)[:7], n, *node(i)[8:]) for i, n in enumerate(names)]
    plain = graph(spark, nodes, [])
    store_adjacency(plain, str(tmp_path), buckets=2)
    g = read_adjacency(spark, str(tmp_path))
    for text in ("abc", "ABC", "ab", "b", "aaa", "äbc", "_c%", "item00", "item00042", "nothing", "m0001"):
        assert rows(scan.filter_entities(g, search=text)) == rows(scan.filter_entities(plain, search=text))
    assert rows(scan.filter_entities(g, search="item0", limit=3, offset=5)) == rows(scan.filter_entities(plain, search="item0", limit=3, offset=5))
    assert g.names.candidates("item00042").count() < 50 and g.names.candidates("ab") is None
    assert scan.filter_entities(g.with_nodes(g.nodes.where("id <> 3")), search="abc").where("id = 3").count() == 0


def test_snapshots_are_versions_and_a_crash_leaves_the_old_ones(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    schema = "id long, a string, b long"
    states = [[(1, "x", 1), (2, "y", None), (3, None, 3)], [(1, "x", 1), (2, "y", 5), (4, "new", None)], [(4, "new", None)], []]
    for i, state in enumerate(states):
        got = ingest.snapshot_view(spark.createDataFrame(state, schema), path, "v", f"2024-01-0{i + 1}", keys=["id"])
        assert rows(got) == sorted(repr((a, b, i)) for i, a, b in state)
    for i, state in enumerate(states):
        assert rows(ingest.read_snapshot(spark, path, "v", f"2024-01-0{i + 1}")) == sorted(repr((a, b, i)) for i, a, b in state)
    assert spark.read.parquet(f"{path}/views/v/1-*/rows").count() == 2  # just what differs
    again = ingest.snapshot_view(spark.createDataFrame([(9, "z", 9)], schema), path, "v", "2024-01-01")
    assert again.count() == 1 and ingest.read_snapshot(spark, path, "v", "2024-01-01", version=0).count() == 3
    monkeypatch.setattr(ingest.Folder, "publish", lambda self, name, text: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.snapshot_view(spark.createDataFrame([(7, "lost", 7)], schema), path, "v", "2024-01-01")
    monkeypatch.undo()
    assert [r.id for r in ingest.read_snapshot(spark, path, "v", "2024-01-01").collect()] == [9]
    listed = {(r.as_of, r.version, r.n_rows) for r in ingest.snapshot_manifest(spark, path).collect()}
    assert listed == {("2024-01-01", 1, 1), ("2024-01-02", 0, 3), ("2024-01-03", 0, 1), ("2024-01-04", 0, 0)}
    with pytest.raises(KeyError):
        ingest.read_snapshot(spark, path, "v", "2030-01-01")


def test_drawings_can_be_merged(spark, tangled):
    whole = scan.random_nodes(tangled, 7, seed=1)
    parts = [scan.random_nodes(tangled.with_nodes(tangled.nodes.where(f"id % 3 = {i}")), 7, seed=1) for i in range(3)]
    assert rows(whole) == rows(scan.merge_drawings(parts, 7, 1)) == rows(scan.random_nodes(tangled.with_nodes(tangled.nodes.repartition(5)), 7, seed=1))
    assert rows(whole) != rows(scan.random_nodes(tangled, 7, seed=2)) and scan.random_nodes(tangled, 100).count() == 60
    often = {i: 0 for i in range(60)}
    for seed in range(20):
        for r in scan._drawn(tangled.nodes, 10, seed).select("id").toLocalIterator():
            often[r.id] += 1
    assert max(often.values()) < 14 and sum(n > 0 for n in often.values()) > 50


def test_events_are_recorded_without_what_nobody_asks_for(spark, monkeypatch):
    g = graph(spark, [(*node(i, "ProtocolEvent", "PROTOCOL_EVENT", 6)[:6], str(i), *node(i)[7:]) for i in range(5)], [])
    roles_of = "event_category_id long, direction string, role string, optional boolean, variable_amount boolean, default_use_active long, default_use_new long"
    defs = spark.createDataFrame([(6, "in", "a", False, True, None, None), (6, "out", "b", False, False, None, None), (6, "in", "c", True, False, None, None)], roles_of)
    g = Graph(g.nodes, g.edges, {"role_defs": defs})
    inputs = spark.createDataFrame([("t", 6, str(i), "x", None, None, None, None, i) for i in range(3, 9)], "graph string, category_id long, external_id string, name string, created_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, variables array<struct<key:string,value:string>>, input_no long")
    of = "graph string, input_no long, direction string, role string, member_id long, quantity double"
    fillers = spark.createDataFrame([("t", i, d, r, m, 1.0) for i in range(3, 8) for d, r, m in (("in", "a", 50), ("in", "a", 50), ("in", "odd", 52), ("out", "b", 51))] + [("t", 7, "out", "b", 53, None)], of)
    stored = []
    monkeypatch.setattr(ingest, "checkpointed", lambda df, f=ingest.checkpointed: stored.append(1) or f(df))
    made, errors = ingest.upsert_event_nodes(g, inputs, fillers, 100)
    assert len(stored) == 2 and made.edges.isEmpty()
    assert {tuple(r) for r in errors.select("event_id", "role", "n", "outcome").collect()} == {(107, "b", 2, "too_many"), (108, "a", 0, "missing"), (108, "b", 0, "missing")}
    assert sorted(r.id for r in made.nodes.collect()) == [0, 1, 2, 3, 4, 105, 106]
    whole, _ = ingest.upsert_events(g, inputs, fillers, 100)
    assert sorted((r.src, r.dst, r.label) for r in whole.edges.collect()) == sorted(x for e in (3, 4, 105, 106) for x in ((50, e, "a"), (50, e, "a"), (e, 51, "b")))
    assert {r.dst for r in roles.participants(whole, lambda id_: id_ > 100).select(F.col("event_id").alias("dst")).collect()} == {105, 106}
    events = spark.createDataFrame([("t", 1, 6)], "graph string, event_id long, category_id long")
    found = roles.resolve_roles(events, fillers.withColumnRenamed("input_no", "event_id"), defs, spark.createDataFrame([], "category_id long, reagent_id long"))
    assert all(not ("direction" in line or "role" in line) for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line and "event_id" in line)


def test_events_are_resolved_in_a_row_each(spark, monkeypatch):
    """20 events of a category with 130 roles: nothing that is stored has more rows than there are events and edges, faults are those of single roles, and a repeat adds nothing."""
    known = [(("in", "out")[i % 2], f"r{i:03d}") for i in range(130)]
    roles_of = "event_category_id long, direction string, role string, optional boolean, variable_amount boolean, default_use_active long, default_use_new long"
    defs = spark.createDataFrame([(6, *known[i], i not in (0, 64, 129), i not in (3, 70, 128), None, 9 if i == 129 else None) for i in range(130)], roles_of)
    g = Graph(spark.createDataFrame([node(1)], NODE_SCHEMA), spark.createDataFrame([edge(1, 1, 1)], EDGE_SCHEMA), {"role_defs": defs})
    inputs = spark.createDataFrame([("t", 6, str(i), "x", None, None, None, None, i) for i in range(20)], "graph string, category_id long, external_id string, name string, created_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, variables array<struct<key:string,value:string>>, input_no long")
    given = [("t", i, *known[r], 50 + r, None) for i in range(20) for r in (0, 64, 5) if (i, r) not in ((1, 0), (2, 64))] + [("t", 3 + j, *known[r], 50, 1.5) for j, r in enumerate((3, 70, 128, 4)) for _ in (1, 2)]
    fillers = spark.createDataFrame(given, "graph string, input_no long, direction string, role string, member_id long, quantity double")
    stored, store = [], ingest.checkpointed
    monkeypatch.setattr(ingest, "checkpointed", lambda df: stored.append(store(df)) or stored[-1])
    made, errors = ingest.upsert_events(g, inputs, fillers, 100)
    assert sorted(df.count() for df in stored) == [20, 20, 30, 62]  # inputs, what their roles come to, nodes with a reagent for each of 15, edges
    assert {(r.event_id, r.role, r.n, r.outcome) for r in errors.collect()} == {(101, "r000", 0, "missing"), (102, "r064", 0, "missing"), (103, "r003", 2, "too_many"), (104, "r070", 2, "too_many"), (105, "r128", 2, "too_many")}
    edges = made.edges.where("edge_type = 'PARTICIPANT'")
    assert edges.select("id").distinct().count() == edges.count() == 4 * 15 + 2
    assert rows(ingest.upsert_event_edges(made, inputs, fillers, 100)[0].edges) == rows(made.edges)


def test_walks_to_ends_derive_the_edges_once(spark, tangled, monkeypatch):
    seen = []
    monkeypatch.setattr(pattern, "hop", lambda g, *rest, f=pattern.hop: seen.append(len(g.edges.inputFiles())) or f(g, *rest))
    of = lambda i: tangled.nodes.where(f"id = {i}").select("graph", "id")
    pattern.match_variable_length(tangled, of(7), 1, 4, label="l1", ends=of(9))
    assert seen and all(seen)


def test_factors_read_each_side_once(spark, tangled):
    plan = pattern.event_factors(tangled, "METRIC", most=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 4  # nodes and edges, of either side
