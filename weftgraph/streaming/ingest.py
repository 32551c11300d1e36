"""Structured Streaming: facts as they arrive.

Projections are stateless. Upserts and the dropping of repeats hold each micro-batch against a table by key (``streaming.keyed``), which
it then changes under the batch's id, once. Streams read folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.schema import NODE_COLUMNS, Graph, checkpointed
from weftgraph.sources.ingest import ingest_entities
from weftgraph.streaming.keyed import KeyedRuns


def read_events(spark: SparkSession, folder: str, name: str = "event*.parquet", schema: StructType | None = None, files_per_batch: int = 100) -> DataFrame:
    """A stream of the event files in a folder; name is a glob, since a stream takes no single file."""
    schema = schema or spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def fact_rows(events: DataFrame) -> DataFrame:
    """An event -> its structure, metric and measurement as (kind, id, src, dst, value, at); works on streams and tables alike."""
    base = 1_000_000_000_000
    row = lambda kind, id_, src, dst, value: F.struct(F.lit(kind).alias("kind"), id_.alias("id"), src.alias("src"), dst.alias("dst"), value.alias("value"))
    none, key = F.lit(None).cast("bigint"), F.col("event_id")
    rows = F.array(
        row("structure", 7 * base + key, none, none, F.lit(None).cast("double")),
        row("metric", 8 * base + key, none, none, F.col("value")),
        row("measurement", 7 * base + key, 7 * base + key, 3 * base + F.col("user_id"), F.lit(None).cast("double")),
        row("description", 8 * base + key, 8 * base + key, 7 * base + key, F.lit(None).cast("double")),
    )
    return events.select(F.explode(rows).alias("r"), F.col("ts").alias("at")).select("r.*", "at")


def stream_ingest_facts(events: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends facts to Parquet, partitioned by kind; the checkpoint makes it exactly-once."""
    return fact_rows(events).writeStream.format("parquet").partitionBy("kind").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


#: Keys of an entity in the store of a stream; those without an external id are keyed by their id.
ENTITY_KEYS = ["graph", "category_id", "entity_key"]


def entity_store(g: Graph, path: str, buckets: int = 64, fan: int = 8) -> KeyedRuns:
    """The entities of a graph as a table by key that a stream keeps up to date; loaded, as version -1, if ``path`` holds nothing yet."""
    entities = g.nodes.where("node_type = 'ENTITY'").select(*NODE_COLUMNS).withColumns({"entity_key": _entity_key(), "order_no": F.lit(None).cast("long")})
    store = KeyedRuns(g.nodes.sparkSession, path, ENTITY_KEYS, entities.schema, buckets, fan)
    if store.version() is None:
        store.commit(-1, entities)
    return store


def _entity_key() -> Column:
    return F.coalesce(F.concat(F.lit("x"), F.col("external_id")), F.concat(F.lit("i"), F.col("id").cast("string")))


def upsert_entities(store: KeyedRuns, inputs: DataFrame, version: int, new_ids: int) -> None:
    """One batch: ``ingest_entities`` on the entities that the batch has keys of, and no others; then they are committed as ``version``.

    inputs: graph, category_id, external_id, name, created_at, order_no, input_no. Of a key's inputs the last by created_at and order_no holds, in
    whichever batch it comes: one that is older than what is held changes nothing. A version that is committed already is left as it is.
    """
    done = store.version()
    if done is not None and done >= version:
        return
    keyed = inputs.withColumn("entity_key", F.coalesce(F.concat(F.lit("x"), F.col("external_id")), F.concat(F.lit("i"), (F.lit(new_ids) + F.col("input_no")).cast("string"))))
    last = checkpointed(_last(keyed, ENTITY_KEYS, F.struct("created_at", "order_no")))
    held = checkpointed(store.held(last))
    before = held.select(*ENTITY_KEYS, F.struct("created_at", "order_no").alias("before"))
    newer = last.join(before, ENTITY_KEYS, "left").where(F.col("before").isNull() | (F.struct("created_at", "order_no") > F.col("before"))).drop("before")
    made = ingest_entities(Graph(held.select(*NODE_COLUMNS), held.select(*NODE_COLUMNS)), newer, new_ids).nodes.withColumn("entity_key", _entity_key())
    store.commit(version, made.join(newer.select(*ENTITY_KEYS, "order_no"), ENTITY_KEYS))


def stream_upsert_entities(inputs: DataFrame, store: KeyedRuns, new_ids: int, checkpoint: str):
    """Starts a query that upserts each micro-batch (``upsert_entities``) under its id, so that the graph is up to date after each, and a repeated batch does no harm."""
    return inputs.writeStream.foreachBatch(lambda batch, n: upsert_entities(store, batch, n, new_ids)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(g: Graph, store: KeyedRuns, version: int | None = None) -> Graph:
    """The graph with its entities as the store has them, after a version or the newest one."""
    others = g.nodes.where("node_type IS NULL OR node_type <> 'ENTITY'").select(*NODE_COLUMNS)
    return g.with_nodes(others.unionByName(store.rows(version).select(*NODE_COLUMNS)))


def _last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("x")).select(*keys, "x.*")


def stream_history_events(events: DataFrame, user_id: int) -> DataFrame:
    """The changes that one user made, as a stream."""
    return events.where(F.col("user_id") == user_id).select(F.col("event_id"), "user_id", F.col("event_type").alias("change"), "ts")


def dedupe_store(spark: SparkSession, path: str, rows: StructType, key: str = "event_id", buckets: int = 64, fan: int = 8) -> KeyedRuns:
    """The rows that a stream has let through, by key."""
    return KeyedRuns(spark, path, [key], rows, buckets, fan)


def add_unseen(store: KeyedRuns, batch: DataFrame, version: int) -> None:
    """Commits the rows of a batch whose key no earlier batch has had, one for each key; rows without a key are left out."""
    done = store.version()
    if done is not None and done >= version:
        return
    one = checkpointed(batch.where(" AND ".join(f"`{k}` IS NOT NULL" for k in store.keys)).dropDuplicates(store.keys))
    store.commit(version, one.join(store.held(one).select(*store.keys), store.keys, "left_anti"))


def stream_dedupe(rows: DataFrame, store: KeyedRuns, checkpoint: str):
    """Starts a query that lets the first row of each key through, however late a repeat comes. The stream keeps no state: a batch is held against what is committed."""
    return rows.writeStream.foreachBatch(lambda batch, n: add_unseen(store, batch, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
