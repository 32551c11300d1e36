"""Aggregations and windows over nodes, edges and paths.

Sums are of exact integers (hundredths), so that a result doesn't depend on the order of addition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.expand import edges_by, hop
from weftgraph.operators.pattern import measurement_path
from weftgraph.schema import Graph


def cents(value: str) -> Column:
    return F.sum(F.round(F.col(value) * 100).cast("bigint"))


def match_count(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("n"))


def category_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("graph", "category_id").agg(F.count("*").alias("n"))


def entity_metric_summary(g: Graph) -> DataFrame:
    """Count, average, least and largest metric value of each entity and metric category, along the measurement path."""
    by = measurement_path(g).groupBy("graph", "entity_id", "entity_name", "metric_category")
    made = by.agg(F.count("*").alias("n"), cents("value_float").alias("c"), F.min("value_float").alias("min_value"), F.max("value_float").alias("max_value"))
    return made.withColumn("avg_value", F.col("c").cast("double") / (100 * F.col("n"))).drop("c")


def scalar_metric(g: Graph, category_id: int) -> DataFrame:
    """One number per graph: a metric category's total."""
    return g.nodes.where((F.col("node_type") == "METRIC") & (F.col("category_id") == category_id)).groupBy("graph").agg(cents("value_float").alias("total_cents"), F.count("*").alias("n"))


def collect_measures(g: Graph, width: int = 1 << 20) -> DataFrame:
    """(entity_id, metric_category, stretch, values): an entity's metric values in order of metric id.

    A list holds the metrics of one category and of ``width`` ids; in order of category and stretch, an entity's
    lists make up the whole one. So no row grows with a hot entity.
    """
    by = measurement_path(g).withColumn("stretch", F.floor(F.col("metric_id") / width)).groupBy("graph", "entity_id", "metric_category", "stretch")
    listed = by.agg(F.array_sort(F.collect_list(F.struct("metric_id", "value_float"))).alias("m"))
    return listed.select("graph", "entity_id", "metric_category", "stretch", F.transform("m", lambda x: x["value_float"]).alias("values"))


def pivot_metrics(g: Graph, categories: dict[int, str]) -> DataFrame:
    """One row per entity, one column per metric category: the sum of its values in hundredths. The list is explicit, so there is one pass."""
    return measurement_path(g).groupBy("graph", "entity_id").agg(*[F.sum(F.when(F.col("metric_category") == c, F.round(F.col("value_float") * 100).cast("bigint"))).alias(name) for c, name in categories.items()])


def informed_measurements(g: Graph, identifier: str) -> DataFrame:
    """Measurement edges that come from structures of an identifier, with both ends."""
    structure = g.nodes.where((F.col("node_type") == "STRUCTURE") & (F.col("identifier") == identifier)).select("graph", F.col("id").alias("src"), "object")
    entity = g.nodes.where("node_type = 'ENTITY'").select("graph", F.col("id").alias("dst"), F.col("name").alias("entity_name"))
    return hop(g, structure, "src", "edge_type = 'MEASUREMENT'", ["id", "dst"]).join(entity, ["graph", "dst"]).select("graph", "dst", "src", "id", "object", "entity_name")


def distinct_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst)."""
    return edges.select("graph", "src", "dst").dropDuplicates(["graph", "src", "dst"])


def quantity_totals(fillers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summed quantities, in hundredths, per (event, role) and per reagent."""
    some = fillers.where("quantity IS NOT NULL")
    return (
        some.groupBy("graph", "event_id", "role").agg(cents("quantity").alias("total_cents"), F.count("*").alias("n")),
        some.groupBy("graph", F.col("member_id").alias("reagent_id")).agg(cents("quantity").alias("total_cents"), F.count("*").alias("n")),
    )


def latest_per_external_id(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; rows with a null key are all kept."""
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    last = rows.where(keyed).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where("_n = 1").drop("_n")
    return last.unionByName(rows.where(~keyed))


def latest_measurement(g: Graph) -> DataFrame:
    """The newest metric of each entity and metric category, by its measurement's start; ties to the larger id. Partially aggregated."""
    newest = F.struct("valid_from", "metric_id")
    by = measurement_path(g).where("valid_from IS NOT NULL").groupBy("graph", "entity_id", "metric_category")
    return by.agg(F.max(newest).alias("top"), F.max_by("value_float", newest).alias("value")).select("graph", "entity_id", "metric_category", "top.valid_from", "top.metric_id", "value")


def close_open_windows(g: Graph, days: int = 32) -> DataFrame:
    """Measurements whose open window ends where the next of the same entity and category begins; those without a begin come first.

    The next one is sought within a stretch of ``days``, and after the last of a stretch it is the first of the next stretch that
    has one, which a small table of firsts gives; so no task sorts all of a hot entity.
    """
    key = ["graph", "dst", "category_id"]
    rows = edges_by(g, "dst").where("edge_type = 'MEASUREMENT'").select(*key, "id", "valid_from", "valid_to")
    rows = rows.withColumn("_stretch", F.floor(F.unix_seconds(F.col("valid_from").cast("timestamp")) / (86_400 * days)))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}"))
    firsts = rows.where("valid_from IS NOT NULL").groupBy(*key, "_stretch").agg(F.min("valid_from").alias("_first"))
    next_first = firsts.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("_stretch").alias("_of"), F.lead("_first").over(Window.partitionBy(*key).orderBy("_stretch")).alias("_next"))
    dated = rows.where("valid_from IS NOT NULL").withColumn("_then", F.lead("valid_from").over(Window.partitionBy(*key, "_stretch").orderBy("valid_from", "id")))
    dated = dated.join(next_first, reduce(Column.__and__, [*map(same, key), F.col("_stretch") == F.col("_of")]), "left")
    first = firsts.groupBy(*key).agg(F.min("_first").alias("_next"))
    last = rows.where("valid_from IS NULL").groupBy(*key).agg(F.max("id").alias("_last")).join(first.select(*[F.col(c).alias(f"_{c}") for c in key], "_next"), reduce(Column.__and__, map(same, key)), "left")
    last = last.select(F.col("graph").alias("_in"), "_last", "_next")
    undated = rows.where("valid_from IS NULL").join(last, (F.col("graph") == F.col("_in")) & (F.col("id") == F.col("_last")), "left").withColumn("_then", F.lit(None).cast("timestamp_ntz"))
    made = [d.select("graph", "id", "dst", "category_id", "valid_from", F.coalesce("valid_to", "_then", "_next").alias("valid_to")) for d in (dated, undated)]
    return made[0].unionByName(made[1])


def numbered(
    rows: DataFrame,
    category: str,
    key: str,
    start: int = 1,
    step: int = 1,
    cycle: int | None = None,
    width: int = 1 << 20,
    least: int | None = None,
    most: int | None = None,
    given: DataFrame | None = None,
) -> DataFrame:
    """Running numbers ``local_seq`` per category in order of a whole-number key: start + step * (n - 1), with n modulo ``cycle`` if given.

    With ``most`` (and a positive step), numbers beyond it go on from ``least`` if that is given, and are null otherwise, which is the
    error of a used-up sequence. given: (category, n_given), how many numbers each category has already; it goes on from there.

    Rows are counted by category and stretch of ``width`` keys; a small table of running totals then shifts numbers
    that are made within each stretch, so no task sorts a whole category.
    """
    staged = rows.withColumn("_stretch", F.floor(F.col(key) / width))
    sizes = staged.groupBy(category, "_stretch").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(category).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(category, "_stretch", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    if given is not None:
        shifts = shifts.join(given.select(category, "n_given"), category, "left").select(category, "_stretch", (F.col("_shift") + F.coalesce("n_given", F.lit(0))).alias("_shift"))
    n = F.row_number().over(Window.partitionBy(category, "_stretch").orderBy(key)) + F.col("_shift") - 1
    n = F.pmod(n, F.lit(cycle)) if cycle else n
    number = F.lit(start) + F.lit(step) * n
    if most is not None:
        once = (most - start) // step + 1
        again = None if least is None else F.lit(least) + F.lit(step) * F.pmod(n - once, F.lit((most - least) // step + 1))
        number = F.when(n < once, number).otherwise(again)
    return staged.join(shifts, [category, "_stretch"]).withColumn("local_seq", number.cast("bigint")).drop("_stretch", "_shift")
