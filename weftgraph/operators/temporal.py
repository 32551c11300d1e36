"""Validity windows are half-open, [valid_from, valid_to); a null bound is unbounded."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.expand import edges_by
from weftgraph.schema import Graph, checkpointed


def _at(t: datetime | str) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def valid_at(edges: DataFrame, t: datetime | str) -> DataFrame:
    return edges.where((F.col("valid_from").isNull() | (F.col("valid_from") <= _at(t))) & (F.col("valid_to").isNull() | (F.col("valid_to") > _at(t))))


def valid_during(edges: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Edges whose window overlaps [start, end)."""
    return edges.where((F.col("valid_from").isNull() | (F.col("valid_from") < _at(end))) & (F.col("valid_to").isNull() | (F.col("valid_to") > _at(start))))


def entities_active_in(g: Graph, start: datetime | str, end: datetime | str) -> DataFrame:
    """Entities that a measurement or relation points at in the window."""
    pointing = valid_during(edges_by(g, "dst").where("edge_type IN ('MEASUREMENT', 'RELATION')"), start, end)
    return g.nodes.where("node_type = 'ENTITY'").join(pointing.select("graph", F.col("dst").alias("id")), ["graph", "id"], "left_semi")


def graph_as_of(g: Graph, t: datetime | str) -> Graph:
    """Nodes created at or before t (a null time is the beginning), and edges that began by then and have both ends."""
    nodes = g.nodes.where(F.col("created_at").isNull() | (F.col("created_at") <= _at(t)))
    edges = edges_by(g, "dst").where(F.col("valid_from").isNull() | (F.col("valid_from") <= _at(t)))
    for end in ("dst", "src"):
        edges = edges.join(nodes.select("graph", F.col("id").alias(end)), ["graph", end], "left_semi")
    return Graph(nodes, edges.select(*g.edges.columns), g.catalog)


def _covered(ranged: DataFrame, levels: int) -> DataFrame:
    """The stretches that make up the seconds from ``_low`` to before ``_high``: (level, stretch) is 2^level seconds from stretch * 2^level.

    On each level, those that lie within but whose double doesn't: an odd one at the start, an even one at the end; the last level is all of time.
    """
    each = ranged.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    each = each.withColumns({"_first": F.expr("shiftright(_low + shiftleft(1L, level) - 1L, level)"), "_end": F.expr("shiftright(_high, level)")}).where("_first < _end")
    top = F.col("level") == levels
    ends = F.array(F.when(top | (F.col("_first") % 2 == 1), F.col("_first")), F.when(~top & (F.col("_end") % 2 == 1), F.col("_end") - 1))
    return each.withColumn("stretch", F.explode(F.array_compact(ends))).drop("_low", "_high", "_first", "_end")


def _meetings(points: DataFrame, windows: DataFrame, keys: list[str], at: str, low: str, high: str, group: int) -> DataFrame:
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    first, last = (n or 0 for n in points.agg(F.min(second(at)), F.max(second(at))).first())
    levels, key = (last - first).bit_length(), [*keys, "level", "stretch"]
    end = F.lit(1 << levels)
    ranged = windows.withColumns({"_low": F.greatest(F.coalesce(second(low) - first, F.lit(0)), F.lit(0)), "_high": F.least(F.coalesce(second(high) - first + 1, end), end)})
    cut = checkpointed(_covered(ranged, levels))
    crowded = cut.groupBy(*key).agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
    used = crowded.groupBy(*keys).agg(F.collect_set("level").alias("levels"))
    asked = points.where(F.col(at).isNotNull()).join(used, keys).withColumn("level", F.explode("levels")).drop("levels")
    asked = asked.withColumn("stretch", F.expr(f"shiftright(unix_seconds(CAST(`{at}` AS TIMESTAMP)) - {first}L, level)")).join(crowded, key)
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    dealt = cut.join(crowded, key).withColumn("group", F.pmod(F.xxhash64(*windows.columns), F.col("groups")).cast("int")).drop("groups")
    return asked.join(dealt, [*key, "group"]).drop("level", "stretch", "group")


def interval_join(points: DataFrame, windows: DataFrame, keys: list[str], at: str = "at", low: str = "valid_from", high: str = "valid_to", group: int = 1_000) -> DataFrame:
    """Points joined with the windows [low, high) of the same keys that hold their time; a null bound is open, a null time is in no window.

    Points outside of all that the windows of their keys span are left out first. Where the rows of a key meet at most ``group`` others each, on average, they
    are joined by their key and compared. In other, crowded keys a window is cut into O(log n) stretches of 2^level seconds, those of open ends being long; a point
    lies in one stretch of each level, and looks only at those that some window of its keys has. So a pair meets just once, at one stretch, and what meets without being
    a result is at most the points in the seconds that a window begins or ends in. A stretch with more than ``group`` windows is dealt in groups, and its points are copied to each.
    """
    holds = (F.col(low).isNull() | (F.col(low) <= F.col(at))) & (F.col(high).isNull() | (F.col(high) > F.col(at)))
    windows = checkpointed(windows.where(F.col(low).isNull() | F.col(high).isNull() | (F.col(low) < F.col(high))))
    spans = windows.groupBy(*keys).agg(F.count("*").alias("_windows"), F.min(low).alias("_low"), F.max(high).alias("_high"), F.bool_or(F.col(low).isNull()).alias("_ever"), F.bool_or(F.col(high).isNull()).alias("_on"))
    spanned = F.col(at).isNotNull() & (F.col("_ever") | (F.col("_low") <= F.col(at))) & (F.col("_on") | (F.col("_high") > F.col(at)))
    near = checkpointed(points.join(spans, keys).where(spanned).select(*points.columns, "_windows"))
    met = near.groupBy(*keys).agg(F.count("*").alias("_points"), F.max("_windows").alias("_windows"))
    crowded = checkpointed(met.where(F.expr(f"1D * _points * _windows > {group}D * (_points + _windows)")).select(*keys))
    near = near.drop("_windows")
    if crowded.isEmpty():
        return near.join(windows, keys).where(holds)
    hot_points, hot_windows = (rows.join(crowded, keys, "left_semi") for rows in (near, windows))
    return near.join(crowded, keys, "left_anti").join(windows, keys).where(holds).unionByName(_meetings(hot_points, hot_windows, keys, at, low, high, group).where(holds))


def measurement_at_event(g: Graph) -> DataFrame:
    """(event_id, entity_id, structure_id, at): the measurements of an entity whose window holds the time of an event it took part in.

    It starts at the entities that are measured: edges of no other are joined with events.
    """
    windows = edges_by(g, "dst").where("edge_type = 'MEASUREMENT'").select("graph", F.col("dst").alias("entity_id"), F.col("src").alias("structure_id"), "valid_from", "valid_to")
    measured = checkpointed(windows.select("graph", F.col("entity_id").alias("src")).distinct())
    took_part = edges_by(g, "src").where("edge_type = 'PARTICIPANT'").join(measured, ["src", "graph"], "left_semi").select("graph", F.col("src").alias("entity_id"), F.col("dst").alias("event_id"))
    events = g.nodes.where("node_type IN ('NATURAL_EVENT', 'PROTOCOL_EVENT')").select("graph", F.col("id").alias("event_id"), F.col("valid_from").alias("at"))
    return interval_join(took_part.join(events, ["event_id", "graph"]), windows, ["entity_id", "graph"]).select("graph", "event_id", "entity_id", "structure_id", "at")


def entity_timeline(g: Graph) -> DataFrame:
    """(entity_id, at, fact, fact_id): dated measurements and events of each entity; sort by (entity_id, at, fact_id) to read it."""
    measured = edges_by(g, "dst").where("edge_type = 'MEASUREMENT' AND valid_from IS NOT NULL").select("graph", F.col("dst").alias("entity_id"), F.col("valid_from").alias("at"), F.lit("measurement").alias("fact"), F.col("id").alias("fact_id"))
    events = g.nodes.where("node_type IN ('NATURAL_EVENT', 'PROTOCOL_EVENT') AND valid_from IS NOT NULL").select("graph", F.col("id").alias("fact_id"), F.col("valid_from").alias("at"), F.lower("node_type").alias("fact"))
    part = g.edges.where("edge_type = 'PARTICIPANT'")
    entity = g.nodes.where("node_type = 'ENTITY'").select("graph", F.col("id").alias("entity_id"))
    took = [part.select("graph", F.col(a).alias("entity_id"), F.col(b).alias("fact_id")) for a, b in (("src", "dst"), ("dst", "src"))]
    dated = took[0].unionByName(took[1]).join(events, ["graph", "fact_id"]).join(entity, ["graph", "entity_id"], "left_semi")
    return measured.unionByName(dated.select(*measured.columns))


def catalog_as_of(history: DataFrame, keys: list[str], t: datetime | str) -> DataFrame:
    """Rows as of t from a history with history_date, history_id and history_type (+ created, ~ changed, - deleted)."""
    rest = [c for c in history.columns if c not in keys]
    past = history.where(F.col("history_date") <= _at(t))
    last = past.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("history_date", "history_id")).alias("x"))
    return last.where("x.history_type <> '-'").select(*keys, "x.*").drop("history_date", "history_id", "history_type")


def relative_window(rows: DataFrame, anchor: str, low: str = "valid_rel_from", high: str = "valid_rel_to") -> DataFrame:
    """valid_from and valid_to from offsets in milliseconds to an anchor time; a null offset is unbounded."""
    moved = lambda c: F.timestamp_micros((F.unix_micros(F.col(anchor).cast("timestamp")) + F.col(c) * 1000).cast("bigint")).cast("timestamp_ntz")
    return rows.withColumns({"valid_from": moved(low), "valid_to": moved(high)})
