"""Role resolution of events, and which categories may fill which role.

A role definition is a row of ``role_defs``: event_category_id, direction (in, out), member_kind, role, optional,
variable_amount, needs_quantity, category_filter, tag_filter, default_use_active, default_use_new.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.expand import hop
from weftgraph.schema import Graph, checkpointed

OUTCOMES = ("filled", "skipped", "default_active", "default_new", "missing", "too_many")


def participants(g: Graph, of: Callable[[Column], Column] = lambda id_: F.lit(True)) -> DataFrame:
    """(graph, event_id, direction, role, member_id, quantity): each participant edge, seen from its event.

    Two unioned orientations, so that joins on the event keep an equality key. ``of``: what must hold of the events' ids; edges are chosen by it before they are joined.
    """
    event = g.nodes.where("node_type in ('PROTOCOL_EVENT', 'NATURAL_EVENT')").where(of(F.col("id"))).select("graph", "id")

    def seen(end: str, other: str, direction: str) -> DataFrame:
        found = hop(g, event.withColumnRenamed("id", end), end, (F.col("edge_type") == "PARTICIPANT") & of(F.col(end)), ["role", F.col(other).alias("member_id"), "quantity"])
        return found.select("graph", F.col(end).alias("event_id"), F.lit(direction).alias("direction"), "role", "member_id", "quantity")

    return seen("dst", "src", "in").unionByName(seen("src", "dst", "out"))


def counted_roles(events: DataFrame, fillers: DataFrame, role_defs: DataFrame, active: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(events, definitions), of which ``told_roles`` makes the rows of ``resolve_roles``: one row per event whose category defines roles, with the numbers of its fillers and ``faulty``; one per definition.

    key: the column, beside the graph, that fillers and events have in common. Fillers are counted for all roles of an event at once, before they meet it: one number for each role
    that the ontology has, which the driver lists. Fillers of a hot event aren't gathered. What its category defines comes to an event by a broadcast: which roles it needs, and
    which take one filler only, as bits of a few numbers; so no row of a role is made, sorted or shuffled to find the faulty ones.
    """
    known = [(r.direction, r.role) for r in role_defs.select("direction", "role").distinct().orderBy("direction", "role").collect()]
    is_role = [(F.col("direction") == direction) & (F.col("role") == role) for direction, role in known]
    words = range(len(known) // 62 + 1)
    bits = lambda tests, word: reduce(Column.bitwiseOR, [F.when(test, 1 << i % 62).otherwise(0).cast("bigint") for i, test in tests if i // 62 == word], F.lit(0).cast("bigint"))
    n = fillers.groupBy(key, "graph").agg(*[F.count_if(test).alias(f"_n{i}") for i, test in enumerate(is_role)])
    some, many = ([bits([(i, F.col(f"_n{i}") > least) for i in range(len(known))], w) for w in words] for least in (0, 1))
    n = n.select(key, "graph", F.array(*[f"_n{i}" for i in range(len(known))]).cast("array<bigint>").alias("_counts"), *[c.alias(f"_some{w}") for w, c in enumerate(some)], *[c.alias(f"_many{w}") for w, c in enumerate(many)])

    at = F.coalesce(reduce(lambda found, i: F.when(is_role[i], i).otherwise(found), range(len(known)), F.lit(None).cast("int")), F.lit(len(known)))  # the last: no filler has it
    defs = role_defs.select(F.col("event_category_id").alias("category_id"), "direction", "role", "optional", "variable_amount", "default_use_active", "default_use_new", at.alias("_at"))
    defs = defs.join(active.select(F.col("category_id").alias("default_use_active"), F.col("reagent_id").alias("default_reagent")), "default_use_active", "left")
    defs = checkpointed(defs.withColumn("first", F.row_number().over(Window.partitionBy("category_id").orderBy("_at")) == 1).repartition(1))  # as few as the ontology has
    needed = ~F.coalesce("optional", F.lit(False)) & F.col("default_reagent").isNull() & F.col("default_use_new").isNull()
    bit = lambda test, word: F.bit_or(F.when(test & (F.floor(F.col("_at") / 62) == word), F.expr("shiftleft(1L, _at % 62)")).otherwise(F.lit(0).cast("bigint")))
    rules = defs.groupBy("category_id").agg(*[bit(needed, w).alias(f"_needed{w}") for w in words], *[bit(~F.coalesce("variable_amount", F.lit(True)), w).alias(f"_single{w}") for w in words])
    met = events.select(*dict.fromkeys(("graph", "event_id", "category_id", key))).join(F.broadcast(rules), "category_id").join(n, [key, "graph"], "left")
    has = lambda name: F.coalesce(F.col(name), F.lit(0).cast("bigint"))
    faults = [F.col(f"_needed{w}").bitwiseAND(F.bitwise_not(has(f"_some{w}"))) != 0 for w in words] + [F.col(f"_single{w}").bitwiseAND(has(f"_many{w}")) != 0 for w in words]
    return met.select(*dict.fromkeys(("graph", "event_id", "category_id", key)), "_counts", reduce(Column.__or__, faults).alias("faulty")), defs


def told_roles(counted: DataFrame, defs: DataFrame) -> DataFrame:
    """A row for each event of ``counted_roles`` and definition of its category."""
    number = F.coalesce(F.get("_counts", F.col("_at")), F.lit(0)).cast("bigint")
    outcome = (
        F.when((F.col("n") > 1) & ~F.coalesce("variable_amount", F.lit(True)), "too_many")
        .when(F.col("n") > 0, "filled")
        .when(F.coalesce("optional", F.lit(False)), "skipped")
        .when(F.col("default_reagent").isNotNull(), "default_active")
        .when(F.col("default_use_new").isNotNull(), "default_new")
        .otherwise("missing")
    )
    each = counted.join(F.broadcast(defs), "category_id").withColumn("n", number).withColumn("outcome", outcome)
    return each.select("graph", "event_id", "category_id", "faulty", "first", "default_use_active", "direction", "role", "optional", "variable_amount", "default_use_new", "default_reagent", "n", "outcome")


def resolve_roles(events: DataFrame, fillers: DataFrame, role_defs: DataFrame, active: DataFrame) -> DataFrame:
    """One row per event and defined role: n fillers, outcome, the default's category and reagent, ``faulty`` (any role of the event is missing or has too many) and ``first`` (one row per event).

    events: graph, event_id, category_id. fillers: as ``participants`` gives them. active: category_id, reagent_id.
    """
    return told_roles(*counted_roles(events, fillers, role_defs, active))


def new_id() -> Column:
    """An id for the reagent that fills a role with ``default_use_new``: a hash of event and role in the upper half of the positive numbers."""
    return F.xxhash64("graph", "event_id", "direction", "role").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)


def new_reagents(resolved: DataFrame, id_: Column | None = None) -> DataFrame:
    """(graph, id, category_id, event_id, direction, role): the reagents that roles with ``default_use_new`` call for, of events without an error.

    id_: their ids, from the columns graph, event_id, direction and role; unlike for each row.
    """
    wanted = resolved.where("outcome = 'default_new' AND NOT faulty")
    return wanted.select("graph", (new_id() if id_ is None else id_).cast("bigint").alias("id"), F.col("default_use_new").cast("bigint").alias("category_id"), "event_id", "direction", "role")


def _errors(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("outcome").isin("missing", "too_many")).select("graph", "event_id", "direction", "role", "n", "outcome")


def _filled(fillers: DataFrame, sound: DataFrame, defined: DataFrame, defaults: DataFrame, made: DataFrame, key: str = "event_id") -> DataFrame:
    """Participant rows of the events of ``sound``: those of their fillers whose role is defined, active reagents and new ones."""
    row = ["graph", "event_id", "direction", "role", "member_id", "quantity"]
    given = fillers.join(sound, [key, "graph"]).join(F.broadcast(defined), ["category_id", "direction", "role"], "left_semi").select(*row)
    nothing = F.lit(None).cast("double").alias("quantity")
    added = defaults.where("outcome = 'default_active' AND NOT faulty").select(*row[:4], F.col("default_reagent").alias("member_id"), nothing)
    return given.unionByName(added).unionByName(made.select(*row[:4], F.col("id").alias("member_id"), nothing))


def resolved_edges(resolved: DataFrame, fillers: DataFrame, id_: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(participant rows, errors): only events without an error get rows. Roles that call for new reagents are filled by those of ``new_reagents``.

    In an event without an error, each role that its category defines takes whatever fills it; so fillers meet events, and the roles of categories by a broadcast.
    """
    sound = resolved.where("first AND NOT faulty").groupBy("event_id", "graph").agg(F.min("category_id").alias("category_id"))
    return _filled(fillers, sound, resolved.select("category_id", "direction", "role").distinct(), resolved, new_reagents(resolved, id_)), _errors(resolved)


def counted_edges(counted: DataFrame, defs: DataFrame, fillers: DataFrame, id_: Column | None = None, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """As ``resolved_edges``, of what ``counted_roles`` gives. Rows of roles are made only for defaults and errors; events that are told apart by a key of their own are taken to come once."""
    fine = counted.where("NOT faulty")
    sound = fine.select(key, "graph", "event_id", "category_id") if key != "event_id" else fine.groupBy("event_id", "graph").agg(F.min("category_id").alias("category_id"))
    defaults = told_roles(fine, defs.where("default_reagent IS NOT NULL"))
    return _filled(fillers, sound, defs.select("category_id", "direction", "role").distinct(), defaults, counted_reagents(counted, defs, id_), key), _errors(told_roles(counted.where("faulty"), defs))


def counted_reagents(counted: DataFrame, defs: DataFrame, id_: Column | None = None) -> DataFrame:
    """As ``new_reagents``, of what ``counted_roles`` gives."""
    return new_reagents(told_roles(counted.where("NOT faulty"), defs.where("default_use_new IS NOT NULL")), id_)


def active_reagent(g: Graph) -> DataFrame:
    """(graph, category_id, reagent_id, n): the active reagent of each category, and how many there are, which should be one."""
    return g.nodes.where("node_type = 'REAGENT' AND active").groupBy("graph", "category_id").agg(F.min("id").alias("reagent_id"), F.count("*").alias("n"))


def set_active_reagent(g: Graph, requests: DataFrame) -> Graph:
    """Activates reagents (graph, id, seq) and deactivates the others of their categories; the last request of a category holds."""
    reagents = g.nodes.where("node_type = 'REAGENT'").select("graph", "id", "category_id")
    last = requests.join(reagents, ["id", "graph"]).groupBy("graph", "category_id").agg(F.max_by("id", F.struct("seq", "id")).alias("chosen"))
    active = F.when((F.col("node_type") == "REAGENT") & F.col("chosen").isNotNull(), F.col("id") == F.col("chosen")).otherwise(F.col("active"))
    return g.with_nodes(g.nodes.join(last, ["graph", "category_id"], "left").withColumn("active", active).drop("chosen").select(*g.nodes.columns))


def role_default(g: Graph) -> DataFrame:
    """(event_category_id, role, default_category, reagent_id) of roles that fall back to an active reagent."""
    return g.catalog["role_defs"].where("default_use_active IS NOT NULL").select("event_category_id", "role", F.col("default_use_active").alias("category_id")).join(active_reagent(g), "category_id", "left")


def role_uniqueness(role_defs: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """(event_category_id, name, n) of role and variable names that a category uses more than once."""
    names = role_defs.select("event_category_id", F.col("role").alias("name"))
    names = names if variables is None else names.unionByName(variables.select("event_category_id", "name"))
    return names.groupBy("event_category_id", "name").agg(F.count("*").alias("n")).where("n > 1")


def variable_lookup(events: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each defined variable of each event: its value, else the default; missing if neither and not optional.

    events: graph, id, category_id, variables array<struct<key,value>>. definitions: category_id, key, kind, default, optional.
    """
    given = events.select("graph", "id", F.explode("variables").alias("v")).select("graph", "id", "v.key", "v.value")
    last = given.groupBy("graph", "id", "key").agg(F.max("value").alias("value"))
    wanted = events.select("graph", "id", "category_id").join(definitions, "category_id")
    value = F.coalesce("value", "default")
    return wanted.join(last, ["id", "graph", "key"], "left").select("graph", "id", "key", "kind", value.alias("value"), (value.isNull() & ~F.col("optional")).alias("missing"))


def _eligible(g: Graph, categories: DataFrame, direction: str, member_kind: str) -> DataFrame:
    """(category_id, event_category_id, role): category listed by a filter, or one of its tags; two equi-joins, unioned."""
    defs = g.catalog["role_defs"].where((F.col("direction") == direction) & (F.col("member_kind") == member_kind))
    by_category = defs.where("category_filter IS NOT NULL").select(F.col("category_filter").alias("category_id"), "event_category_id", "role")
    tags = g.catalog["category_tags"].select("category_id", F.col("tag").alias("tag_filter"))
    by_tag = defs.where("tag_filter IS NOT NULL").select("tag_filter", "event_category_id", "role").join(tags, "tag_filter").select("category_id", "event_category_id", "role")
    return by_category.unionByName(by_tag).join(categories.select("category_id"), "category_id", "left_semi").distinct()


def _of_kind(g: Graph, kind: str) -> DataFrame:
    return g.catalog["categories"].where(F.col("kind") == kind)


def subjectable_to(g: Graph) -> DataFrame:
    """For each entity category: the events and roles where it may be a source."""
    return _eligible(g, _of_kind(g, "ENTITY"), "in", "entity")


def targetable_by(g: Graph) -> DataFrame:
    return _eligible(g, _of_kind(g, "ENTITY"), "out", "entity")


def usable_in(g: Graph) -> DataFrame:
    """For each reagent category: the events and roles that may use it."""
    return _eligible(g, _of_kind(g, "REAGENT"), "in", "reagent")


def createable_from(g: Graph) -> DataFrame:
    return _eligible(g, _of_kind(g, "REAGENT"), "out", "reagent")


def match_definition(g: Graph, kind: str, tags: list[str] | None = None, categories: list[int] | None = None, not_tags: list[str] | None = None, not_categories: list[int] | None = None) -> DataFrame:
    """Categories of a kind that a definition takes: any of the tags, any of the categories; excludes win."""
    found = _of_kind(g, kind)
    tagged = lambda t: g.catalog["category_tags"].where(F.col("tag").isin(t)).select("category_id")
    if tags:
        found = found.join(tagged(tags), "category_id", "left_semi")
    if categories:
        found = found.where(F.col("category_id").isin(categories))
    if not_tags:
        found = found.join(tagged(not_tags), "category_id", "left_anti")
    return found.where(~F.col("category_id").isin(not_categories)) if not_categories else found


def knowledge_views(g: Graph, objects: DataFrame) -> DataFrame:
    """For each (identifier, object, user_id): the structure categories of that identifier in the graphs that the user pins something of, with the structure or null."""
    categories = _of_kind(g, "STRUCTURE").select("graph", F.col("category_id"), F.col("name").alias("identifier"))
    pinned = g.catalog["pins"].join(g.catalog["categories"].select("category_id", "graph"), "category_id").select("user_id", "graph").distinct()
    asked = objects.join(categories, "identifier").join(pinned, ["user_id", "graph"], "left_semi")
    structures = g.nodes.where("node_type = 'STRUCTURE'").select("graph", "identifier", "object", F.col("id").alias("structure_id"))
    return asked.join(structures, ["graph", "identifier", "object"], "left")


def relevant_queries(g: Graph, nodes: DataFrame) -> DataFrame:
    """(graph, id, query_id, query_name, pinned) for the saved queries of each node's category."""
    saved = g.catalog["saved_queries"].select("query_id", F.col("name").alias("query_name"), "category_id", "pinned")
    return nodes.select("graph", "id", "category_id").join(saved, "category_id").select("graph", "id", "query_id", "query_name", "pinned")


def rank_views(g: Graph, nodes: DataFrame) -> DataFrame:
    """Relevant queries, pinned first, then by id; rank 1 is the best view."""
    order = Window.partitionBy("graph", "id").orderBy(F.desc("pinned"), "query_id")
    return relevant_queries(g, nodes).withColumn("rank", F.row_number().over(order))


def best_view(g: Graph, nodes: DataFrame) -> DataFrame:
    return rank_views(g, nodes).where("rank = 1").drop("rank")
