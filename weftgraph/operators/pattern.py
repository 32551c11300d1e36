"""Graph patterns: fixed and variable length, the canonical paths, and lineage through events."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.expand import hop
from weftgraph.schema import Graph, checkpointed


@dataclass(frozen=True)
class Node:
    """What a pattern asks of a node: label, type, category and equal columns."""

    name: str
    label: str | None = None
    node_type: str | None = None
    category_id: int | None = None
    equals: tuple[tuple[str, object], ...] = ()

    def test(self) -> Column | None:
        tests = [F.col(c) == v for c, v in (("label", self.label), ("node_type", self.node_type), ("category_id", self.category_id), *self.equals) if v is not None]
        return reduce(Column.__and__, tests) if tests else None


@dataclass(frozen=True)
class Edge:
    """What a pattern asks of an edge; direction is > or < or - for either."""

    name: str
    label: str | None = None
    edge_type: str | None = None
    direction: str = ">"

    def test(self) -> Column:
        return reduce(Column.__and__, [F.col(c) == v for c, v in (("label", self.label), ("edge_type", self.edge_type)) if v is not None], F.lit(True))

    def turned(self) -> Edge:
        return replace(self, direction={">": "<", "<": ">"}.get(self.direction, "-"))


def step(g: Graph, rows: DataFrame, at: str, edge: Edge, to: str, id_: str | None = None) -> DataFrame:
    """``rows`` (graph, AT, ...) and what their nodes lead to: the next node as ``to``, the edge as ``id_``. Edges by source or by target are taken as they are stored."""
    found = []
    for end, other, ways in (("src", "dst", ">-"), ("dst", "src", "<-")):
        if edge.direction in ways:
            test = edge.test() & (F.col("src") != F.col("dst")) if edge.direction == "-" and end == "dst" else edge.test()
            columns = [F.col(other).alias(to)] + ([F.col("id").alias(id_)] if id_ else [])
            found.append(hop(g, rows.withColumnRenamed(at, end), end, test, columns).withColumnRenamed(end, at))
    return reduce(DataFrame.unionByName, found)


def _rarest(g: Graph, nodes: list[Node]) -> int:
    """The node of a pattern with the fewest candidates by the graph's stored counts, an equal column taken for a tenth; without counts, the one most is asked of."""

    def candidates(n: Node) -> tuple[float, int]:
        wanted = (n.label, n.node_type, n.category_id)
        held = sum(count for *of, count in g.counts if all(w is None or w == v for w, v in zip(wanted, of)))
        return held / 10 ** len(n.equals), -sum(w is not None for w in wanted) - len(n.equals)

    return min(range(len(nodes)), key=lambda i: candidates(nodes[i]))


def match_pattern(g: Graph, nodes: list[Node], edges: list[Edge], columns: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """All matches of node - edge - node - ...: a column with the id of each named part, and NAME_column for the columns asked for.

    The rarest node is the root. Semi-joins from the ends towards it leave, at each other node, only what the rest of its side can be matched from;
    then matches grow outwards, so that but for the first hop none is made that can't be completed. An edge is used once in a match.
    """
    columns = columns or {}
    if len(edges) != len(nodes) - 1:
        raise ValueError("a pattern has one edge between two nodes")
    root = _rarest(g, nodes)

    def of(i: int, *more: str) -> DataFrame:
        test = nodes[i].test()
        found = g.nodes if test is None else g.nodes.where(test)
        return found.select("graph", F.col("id").alias(f"n{i}"), *[F.col(c).alias(f"n{i}_{c}") for c in more])

    def grown(rows: DataFrame, i: int, j: int, id_: str | None = None) -> DataFrame:
        edge = edges[min(i, j)]
        return step(g, rows, f"n{i}", edge if i < j else edge.turned(), f"n{j}", id_)

    sides = [list(range(len(nodes) - 1, root, -1)), list(range(root))]
    supported: dict[int, DataFrame] = {}
    for side in sides:
        for i, j in zip(side, [*side[1:], root]):
            if j == root and not all(sides):
                break  # the first hop from the root costs no more than its edges
            here = of(i) if nodes[i].test() is not None else None
            if i in supported:
                here = supported[i] if here is None else here.join(supported[i], [f"n{i}", "graph"], "left_semi")
            if here is not None:
                reached = grown(here, i, j).select("graph", f"n{j}").distinct()
                supported[j] = reached.join(supported[j], [f"n{j}", "graph"], "left_semi") if j in supported else reached
    out = of(root, *columns.get(nodes[root].name, ()))
    if root in supported:
        out = out.join(supported[root], [f"n{root}", "graph"], "left_semi")
    used: list[str] = []
    for side in sides:
        for j, i in zip(reversed(side), [root, *side[:0:-1]]):
            id_ = f"e{min(i, j)}"
            out = grown(out, i, j, id_)
            for u in used:
                out = out.where(F.col(u) != F.col(id_))
            used.append(id_)
            if j in supported:
                out = out.join(supported[j], [f"n{j}", "graph"], "left_semi")
            # the nodes' own table is joined only where something is asked of it
            if nodes[j].test() is not None or nodes[j].name in columns:
                out = out.join(of(j, *columns.get(nodes[j].name, ())), [f"n{j}", "graph"])
    named = [F.col(f"n{i}").alias(n.name) for i, n in enumerate(nodes)] + [F.col(f"e{i}").alias(e.name) for i, e in enumerate(edges)]
    return out.select("graph", *named, *[F.col(f"n{i}_{c}").alias(f"{n.name}_{c}") for i, n in enumerate(nodes) for c in columns.get(n.name, ())])


def _walks(g: Graph, starts: DataFrame, edge: Edge, hops: int, distance: DataFrame | None = None, high: int = 0) -> list[DataFrame]:
    """(graph, start_id, end_id, edge_ids) of walks of 0 to ``hops`` edges that use none twice; where ``distance`` (graph, end_id, left) is given, only those that can still arrive within ``high``, and stored, as each is used several times."""
    walk = starts.select("graph", F.col("id").alias("start_id"), F.col("id").alias("end_id"), F.array().cast("array<bigint>").alias("edge_ids")).distinct()
    found = [walk]
    for n in range(1, hops + 1):
        walk = step(g, walk, "end_id", edge, "_to", "_edge").where(~F.array_contains("edge_ids", F.col("_edge")))
        walk = walk.select("graph", "start_id", F.col("_to").alias("end_id"), F.array_append("edge_ids", F.col("_edge")).alias("edge_ids"))
        if distance is not None:
            walk = checkpointed(walk.join(distance.where(F.col("left") <= high - n).select("graph", "end_id"), ["end_id", "graph"], "left_semi"))
        found.append(walk)
    return found


def match_variable_length(g: Graph, anchors: DataFrame, low: int, high: int, label: str | None = None, direction: str = ">", ends: DataFrame | None = None) -> DataFrame:
    """(start_id, end_id, hops, edge_ids) of all walks of low to high edges from the anchors (graph, id), to the ``ends`` if they are given, that use no edge twice.

    With ends, their distances backwards are found first, a semi-join per hop; walks from the anchors go only where they can still arrive, and
    go half the way: they meet walks of the other half, which come back from the ends to the nodes in the middle that were reached, and no others.
    """
    edge = Edge("e", label=label, direction=direction)
    if ends is None:
        made = _walks(g, anchors, edge, high)
        return reduce(DataFrame.unionByName, [walk.select("graph", "start_id", "end_id", F.lit(n).alias("hops"), "edge_ids") for n, walk in enumerate(made) if n >= low])
    if not g.sides:  # every hop reads the edges, which are derived once for all
        g, edge = g.with_edges(checkpointed(g.edges.where(edge.test()).select("graph", "id", "src", "dst"))), replace(edge, label=None)
    to_end = _distances(g, ends, edge.turned(), high - 1)
    forth = _walks(g, anchors, edge, (high + 1) // 2, to_end, high)
    middle = reduce(DataFrame.unionByName, [forth[n].select("graph", F.col("end_id").alias("id")) for n in sorted({(n + 1) // 2 for n in range(low, high + 1)})])
    from_middle = _distances(g, middle, edge, high // 2 - 1)
    back = [w.withColumnsRenamed({"start_id": "last_id", "edge_ids": "back_ids"}) for w in _walks(g, ends, edge.turned(), high // 2, from_middle, high // 2)]
    found = []
    for n in range(low, high + 1):
        met = forth[(n + 1) // 2].join(back[n // 2], ["end_id", "graph"]).where(~F.arrays_overlap("edge_ids", "back_ids"))
        found.append(met.select("graph", "start_id", F.col("last_id").alias("end_id"), F.lit(n).alias("hops"), F.concat("edge_ids", F.reverse("back_ids")).alias("edge_ids")))
    return reduce(DataFrame.unionByName, found)


def _distances(g: Graph, starts: DataFrame, edge: Edge, most: int) -> DataFrame:
    """(graph, end_id, left): the least number of edges, up to ``most``, from any of ``starts``."""
    near = starts.select("graph", F.col("id").alias("node_id")).distinct().withColumn("left", F.lit(0))
    parts = [checkpointed(near)]
    for n in range(1, most + 1):
        reached = step(g, parts[-1].select("graph", "node_id"), "node_id", edge, "_to").select("graph", F.col("_to").alias("node_id")).distinct()
        parts.append(checkpointed(reached.join(reduce(DataFrame.unionByName, parts), ["node_id", "graph"], "left_anti").withColumn("left", F.lit(n))))
        if parts[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("node_id", "end_id")


def lineage(g: Graph, anchors: DataFrame, direction: str = ">", max_hops: int | None = None, labels: list[str] | None = None, plain_hops: int = 3, growth: int = 2) -> DataFrame:
    """(start_id, node_id, hops): all nodes reachable from the anchors, at their least distance, the anchors themselves left out.

    The first ``plain_hops`` rounds go hop by hop. If there is more, hops are joined with themselves, to jumps of 2, 4, 8, ... edges, and a round goes
    on by one jump from all nodes that were reached in the last stretch of that length, which reaches each farther node at its least distance. So a
    chain of n takes O(log n) rounds. Jumps are lengthened only while there are at most ``growth`` times as many as edges, which is known from the
    degrees before they are made: where the graph branches, rounds keep to the jumps there are. Plans are cut by checkpoints.
    """
    edges = g.edges if labels is None else g.edges.where(F.col("label").isin(labels))
    ways = [edges.select("graph", F.col(a).alias("node_id"), F.col(b).alias("to")) for a, b, either in (("src", "dst", ">-"), ("dst", "src", "<-")) if direction in either]
    jumps = checkpointed(reduce(DataFrame.unionByName, ways).distinct())
    most, length, longer = None, 1, True
    parts = [checkpointed(anchors.select("graph", F.col("id").alias("start_id"), F.col("id").alias("node_id"), F.lit(0).alias("hops")).distinct())]
    done = 1  # all nodes at fewer hops are known
    for n in count(1):
        visited = reduce(DataFrame.unionByName, parts)
        near = visited.where(F.col("hops") >= done - length)
        reached = near.join(jumps, ["node_id", "graph"]).groupBy("graph", "start_id", F.col("to").alias("node_id")).agg((F.min("hops") + length).alias("hops"))
        parts.append(checkpointed(reached.join(visited, ["start_id", "graph", "node_id"], "left_anti").select("graph", "start_id", "node_id", "hops")))
        done += length
        if parts[-1].isEmpty() or max_hops is not None and done > max_hops:
            break
        if longer and n >= plain_hops:
            most = growth * jumps.count() if most is None else most
            ends = jumps.groupBy("graph", F.col("to").alias("node_id")).agg(F.count("*").alias("i"))
            pairs = ends.join(jumps.groupBy("graph", "node_id").agg(F.count("*").alias("o")), ["node_id", "graph"]).agg(F.sum(F.col("i").cast("double") * F.col("o"))).first()[0]
            longer = 0 < (pairs or 0) <= most
            if longer:
                second = jumps.select("graph", F.col("node_id").alias("to"), F.col("to").alias("_to"))
                jumps = checkpointed(jumps.join(second, ["to", "graph"]).select("graph", "node_id", F.col("_to").alias("to")).distinct())
                length *= 2
    found = reduce(DataFrame.unionByName, parts)
    return found.where((F.col("hops") > 0) & (F.col("hops") <= max_hops) if max_hops is not None else F.col("hops") > 0)


def measurement_path(g: Graph) -> DataFrame:
    """One row per chain Metric -> Structure -> Entity. Each hop goes from what is matched so far to the edges by their source."""
    metric = g.nodes.where("node_type = 'METRIC'").select("graph", F.col("id").alias("src"), F.col("category_id").alias("metric_category"), "value_float")
    described = hop(g, metric, "src", "edge_type = 'DESCRIPTION'", [F.col("dst").alias("structure_id")]).withColumnsRenamed({"src": "metric_id", "structure_id": "src"})
    measured = hop(g, described, "src", "edge_type = 'MEASUREMENT'", [F.col("dst").alias("entity_id"), "valid_from", "valid_to"]).withColumnRenamed("src", "structure_id")
    entity = g.nodes.where("node_type = 'ENTITY'").select("graph", F.col("id").alias("entity_id"), F.col("name").alias("entity_name"))
    return measured.join(entity, ["entity_id", "graph"])


def relation_path(g: Graph) -> DataFrame:
    """Entity -> Entity by relation."""
    nodes = [Node("source", node_type="ENTITY"), Node("target", node_type="ENTITY")]
    found = match_pattern(g, nodes, [Edge("relation", edge_type="RELATION")], {"source": ("name",), "target": ("name",)})
    return found.join(g.edges.select("graph", F.col("id").alias("relation"), F.col("category_id")), ["relation", "graph"])


def _took_part(g: Graph, node_type: str) -> tuple[DataFrame, DataFrame]:
    """(graph, event_id, entity_id, in_role, quantity) and (graph, event_id, made_id, out_role) of the events of a type."""
    event = g.nodes.where(F.col("node_type") == node_type).select("graph", F.col("id").alias("event_id"))
    ends = []
    for end, other in (("dst", "src"), ("src", "dst")):
        ends.append(hop(g, event.withColumnRenamed("event_id", end), end, "edge_type = 'PARTICIPANT'", [F.col(other).alias("member_id"), "role", "quantity"]).withColumnRenamed(end, "event_id"))
    return ends[0], ends[1]


def natural_event_path(g: Graph) -> DataFrame:
    """Entity -> NaturalEvent, what it created, and the structure that supports it; the last two may be null."""
    into, out = _took_part(g, "NATURAL_EVENT")
    support = g.edges.where("label = 'DETERMINES'").select("graph", F.col("src").alias("structure_id"), F.col("dst").alias("event_id"))
    key = ["event_id", "graph"]
    taken = into.select(*key, F.col("member_id").alias("entity_id"), "role")
    return taken.join(out.select(*key, F.col("member_id").alias("created_id")), key, "left").join(support, key, "left")


def protocol_event_path(g: Graph) -> DataFrame:
    """input -(role, quantity)-> event -> output, one row per pair; ``event_factors`` has them without the product."""
    into, out = _took_part(g, "PROTOCOL_EVENT")
    key = ["event_id", "graph"]
    taken = into.select(*key, F.col("member_id").alias("input_id"), F.col("role").alias("in_role"), "quantity")
    return taken.join(out.select(*key, F.col("member_id").alias("output_id"), F.col("role").alias("out_role")), key)


def event_factors(g: Graph, node_type: str = "PROTOCOL_EVENT", most: int = 1_000) -> DataFrame:
    """(graph, event_id, side, stretch, members): the inputs and outputs of each event apart, about ``most`` to a row, so that its paths needn't be multiplied out.

    members: array of (id, role, quantity). An event's members are dealt to stretches by a hash, as many as its members fill, whatever their number.
    """
    def made(part: DataFrame, side: str) -> DataFrame:
        # each side by itself stays dealt by event, as its hop has left it
        key = ["event_id", "graph"]
        stretches = F.ceil(F.count("*").over(Window.partitionBy(*key)) / most)
        dealt = part.withColumn("stretch", F.pmod(F.xxhash64("member_id", "role", "quantity"), stretches))
        gathered = dealt.groupBy(*key, "stretch").agg(F.array_sort(F.collect_list(F.struct(F.col("member_id").alias("id"), "role", "quantity"))).alias("members"))
        return gathered.select(*key, F.lit(side).alias("side"), "stretch", "members")

    return reduce(DataFrame.unionByName, [made(part, side) for side, part in zip(("in", "out"), _took_part(g, node_type))])


def factor_totals(factors: DataFrame) -> DataFrame:
    """(graph, event_id, n_inputs, n_outputs, n_paths, quantity) from the factors: the number of input-output paths of each event, and their quantities summed over all paths.

    A path's quantity is that of its input, so each counts once for every output; no path is made. Events without an input or an output have no path.
    """
    size = lambda side: F.sum(F.when(F.col("side") == side, F.size("members")).otherwise(0))
    amount = F.when(F.col("side") == "in", F.aggregate("members", F.lit(None).cast("double"), lambda x, m: F.coalesce(x + m["quantity"], x, m["quantity"])))
    found = factors.groupBy("graph", "event_id").agg(size("in").alias("n_inputs"), size("out").alias("n_outputs"), F.sum(amount).alias("_amount"))
    return found.select("graph", "event_id", "n_inputs", "n_outputs", (F.col("n_inputs") * F.col("n_outputs")).alias("n_paths"), (F.col("_amount") * F.col("n_outputs")).alias("quantity"))


def factor_paths(factors: DataFrame) -> DataFrame:
    """The paths of some events, multiplied out stretch by stretch: (graph, event_id, input_id, in_role, quantity, output_id, out_role)."""
    of = lambda side, names: factors.where(F.col("side") == side).select("graph", "event_id", F.inline("members").alias(*names))
    return of("in", ("input_id", "in_role", "quantity")).join(of("out", ("output_id", "out_role", "_")).drop("_"), ["event_id", "graph"])


def path_graph(walks: DataFrame, g: Graph) -> tuple[DataFrame, DataFrame]:
    """Node set and edge set of walks (graph, start_id, end_id, edge_ids). The walks are computed once, as ids."""
    part = lambda kind, id_: F.struct(F.lit(kind).alias("kind"), id_.alias("id"))
    parts = F.array_append(F.transform("edge_ids", lambda e: part("edge", e)), part("node", F.col("start_id")))
    ids = checkpointed(walks.select("graph", F.explode(parts).alias("p")).select("graph", "p.kind", "p.id").distinct())
    edges = g.edges.join(ids.where("kind = 'edge'").select("graph", "id"), ["id", "graph"], "left_semi")
    ends = edges.select("graph", F.explode(F.array("src", "dst")).alias("id")).unionByName(ids.where("kind = 'node'").select("graph", "id")).distinct()
    return g.nodes.join(ends, ["id", "graph"], "left_semi"), edges
