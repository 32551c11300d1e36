"""Column functions for names, references, times and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.schema import VECTOR_SIZES

# How names of each kind are made from labels: case, and what is put before and after. Fixed values.
NAME_RULES = {
    "GRAPH": ("lower", "", ""),
    "ENTITY": ("lower", "", ""),
    "METRIC": ("lower", "", ""),
    "STRUCTURE": ("lower", "", ""),
    "RELATION": ("upper", "", ""),
    "MEASUREMENT": ("lower", "", ""),
    "PROTOCOL_EVENT": ("lower", "", "Event"),
    "NATURAL_EVENT": ("lower", "", "NaturalEvent"),
    "REAGENT": ("lower", "", "Event"),
    "PARTICIPANT": ("upper", "AS_", ""),
}


def normalized_name(label: str | Column, kind: str | Column) -> Column:
    """A category's name from its label. Names keep letters only: spaces, underscores and digits go."""
    label = F.col(label) if isinstance(label, str) else label
    kind = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(None).cast("string")
    for k, (case, before, after) in NAME_RULES.items():
        text = F.regexp_replace(F.lower(label) if case == "lower" else F.upper(label), "[^a-zA-Z]", "")
        out = F.when(kind == k, F.concat(F.lit(before), text, F.lit(after))).otherwise(out)
    return out


def category_name_collisions(categories: DataFrame) -> DataFrame:
    """(graph, age_name, n) of names that several labels normalize to."""
    named = categories.select("graph", normalized_name("name", "kind").alias("age_name"), "name")
    return named.groupBy("graph", "age_name").agg(F.count_distinct("name").alias("n")).where("n > 1")


#: @ext/name:object, each separator once; text may follow.
REFERENCE = r"^@([^@/:]+)/([^@/:]+):([^@/:]+)"


def parse_structure_refs(refs: DataFrame, column: str = "ref") -> tuple[DataFrame, DataFrame]:
    """(ext, ref_name, identifier, object, graph_name) of well-formed references, and the malformed rows."""
    once = F.lit(True)
    for c in "@/:":
        once = once & (F.length(column) - F.length(F.replace(F.col(column), F.lit(c), F.lit(""))) == 1)
    good = F.coalesce(once & F.col(column).rlike(REFERENCE), F.lit(False))
    part = lambda i: F.regexp_extract(column, REFERENCE, i)
    parsed = refs.where(good).select(column, part(1).alias("ext"), part(2).alias("ref_name"), F.concat(F.lit("@"), part(1), F.lit("/"), part(2)).alias("identifier"), part(3).alias("object"), F.upper(part(1)).alias("graph_name"))
    return parsed, refs.where(~good)


def split_global_ids(rows: DataFrame, column: str = "gid") -> DataFrame:
    parts = F.split(F.col(column), ":", 2)
    return rows.withColumns({"gid_graph": parts[0], "gid_id": F.try_element_at(parts, F.lit(2)).try_cast("bigint")})


def parse_iso_times(rows: DataFrame, column: str) -> DataFrame:
    """ISO text -> timestamp; what isn't one becomes null."""
    return rows.withColumn(f"{column}_at", F.col(column).try_cast("timestamp_ntz"))


def vector_values(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """JSON lists -> arrays; a list of another length than the kind's becomes null."""
    v, size = F.from_json(column, "array<double>"), VECTOR_SIZES[kind]
    return rows.withColumn("vector", F.when(F.size(v) == size, v) if size else v)
