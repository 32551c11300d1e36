"""The property graph that the queries run on, derived from the star-schema and corpus tables.

The same SQL text runs in Spark and in an oracle database. Node and edge ids are ordinal * 10^12 + key, or, for the two kinds of
edges with a key of two parts, 10^18 or 5 * 10^18 + order * 10^8 + part or supplier: apart for orders under 4 * 10^10.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schema import VARIABLES, Graph, checkpointed, shared_folder
from weftgraph.sources.adjacency import is_stored, read_adjacency, store_adjacency

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

FACTS = """plain_nodes AS (
  SELECT 'trade' AS graph, 1000000000000 + r_regionkey AS id, 'Entity' AS label, 'ENTITY' AS node_type, CAST(1 AS BIGINT) AS category_id, 'region' AS category_type, CAST(NULL AS STRING) AS external_id, r_name AS name, CAST(NULL AS STRING) AS identifier, CAST(NULL AS STRING) AS object, CAST(NULL AS BOOLEAN) AS active, CAST(NULL AS DOUBLE) AS value_float, (SELECT min(o_orderdate) FROM orders) AS created_at, (SELECT min(o_orderdate) FROM orders WHERE 1 = 0) AS valid_from FROM region
  UNION ALL SELECT 'trade', 2000000000000 + n_nationkey, 'Entity', 'ENTITY', 2, 'nation', NULL, n_name, NULL, NULL, NULL, NULL, (SELECT min(o_orderdate) FROM orders), NULL FROM nation
  UNION ALL SELECT 'trade', 3000000000000 + c_custkey, 'Entity', 'ENTITY', 3, 'customer', c_name, c_name, NULL, NULL, NULL, NULL, (SELECT min(o_orderdate) FROM orders), NULL FROM customer
  UNION ALL SELECT 'trade', 4000000000000 + s_suppkey, 'Entity', 'ENTITY', 4, 'supplier', s_name, s_name, NULL, NULL, NULL, NULL, (SELECT min(o_orderdate) FROM orders), NULL FROM supplier
  UNION ALL SELECT 'trade', 5000000000000 + p_partkey, 'Reagent', 'REAGENT', 200 + CAST(substr(p_brand, 7) AS BIGINT), p_brand, NULL, p_name, NULL, NULL, p_partkey = first_key, NULL, (SELECT min(o_orderdate) FROM orders), NULL FROM part LEFT JOIN (SELECT p_brand AS brand, min(p_partkey) AS first_key FROM part GROUP BY p_brand) b ON b.brand = p_brand
  UNION ALL SELECT 'trade', 6000000000000 + o_orderkey, 'ProtocolEvent', 'PROTOCOL_EVENT', 6, 'order', CAST(o_orderkey AS STRING), NULL, NULL, NULL, NULL, NULL, o_orderdate, o_orderdate FROM orders
  UNION ALL SELECT 'trade', 7000000000000 + event_id, 'Structure', 'STRUCTURE', 7, '@trade/event', NULL, NULL, '@trade/event', CAST(event_id AS STRING), NULL, NULL, ts, NULL FROM events
  UNION ALL SELECT 'trade', 8000000000000 + event_id, 'Metric', 'METRIC', CASE event_type WHEN 'click' THEN 8 WHEN 'error' THEN 9 WHEN 'purchase' THEN 10 WHEN 'signup' THEN 11 ELSE 12 END, event_type, NULL, NULL, NULL, NULL, NULL, value, ts, NULL FROM events
  UNION ALL SELECT 'trade', 9000000000000 + event_id, 'NaturalEvent', 'NATURAL_EVENT', 13, 'signup', NULL, NULL, NULL, NULL, NULL, NULL, ts, ts FROM events WHERE event_type = 'signup'
  UNION ALL SELECT 'corpus', 10000000000000 + doc_id, 'Structure', 'STRUCTURE', 14, '@corpus/document', NULL, NULL, '@corpus/document', CAST(doc_id AS STRING), NULL, NULL, NULL, NULL FROM documents
  UNION ALL SELECT 'corpus', 11000000000000 + doc_id, 'Metric', 'METRIC', 15, 'n_chars', NULL, NULL, NULL, NULL, NULL, CAST(n_chars AS DOUBLE), NULL, NULL FROM documents
  UNION ALL SELECT 'corpus', 12000000000000 + doc_id, 'Metric', 'METRIC', 16, 'quality', NULL, NULL, NULL, NULL, NULL, CAST(quality AS DOUBLE), NULL, NULL FROM labels
  UNION ALL SELECT 'corpus', 13000000000000 + doc_id, 'Metric', 'METRIC', 17, 'toxic', NULL, NULL, NULL, NULL, NULL, CAST(toxic AS DOUBLE), NULL, NULL FROM labels
  UNION ALL SELECT DISTINCT 'corpus', 14000000000000 + CAST(substr(source, 4) AS BIGINT), 'Entity', 'ENTITY', 18, 'source', source, source, NULL, NULL, NULL, NULL, NULL, NULL FROM documents
),
nodes AS (
  SELECT *, CASE WHEN node_type = 'PROTOCOL_EVENT' THEN valid_from + INTERVAL 1 DAY END AS valid_to, CASE WHEN node_type IN ('ENTITY', 'REAGENT') THEN id % 1000000000000 END AS local_seq, CASE WHEN node_type = 'METRIC' AND category_id >= 16 THEN CAST(CAST(value_float AS BIGINT) AS STRING) END AS value FROM plain_nodes
),
edges AS (
  SELECT 'trade' AS graph, 1000000000000 + n_nationkey AS id, 'PART_OF' AS label, 'RELATION' AS edge_type, CAST(101 AS BIGINT) AS category_id, 2000000000000 + n_nationkey AS src, 1000000000000 + n_regionkey AS dst, CAST(NULL AS STRING) AS role, CAST(NULL AS DOUBLE) AS quantity, (SELECT min(ts) FROM events WHERE 1 = 0) AS valid_from, (SELECT min(ts) FROM events WHERE 1 = 0) AS valid_to FROM nation
  UNION ALL SELECT 'trade', 2000000000000 + c_custkey, 'LOCATED_IN', 'RELATION', 102, 3000000000000 + c_custkey, 2000000000000 + c_nationkey, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'trade', 3000000000000 + s_suppkey, 'BASED_IN', 'RELATION', 103, 4000000000000 + s_suppkey, 2000000000000 + s_nationkey, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'trade', 4000000000000 + o_orderkey, 'buyer', 'PARTICIPANT', NULL, 3000000000000 + o_custkey, 6000000000000 + o_orderkey, 'buyer', NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'trade', 1000000000000000000 + l_orderkey * 100000000 + l_partkey, 'consumed', 'PARTICIPANT', NULL, 5000000000000 + l_partkey, 6000000000000 + l_orderkey, 'consumed', sum(l_quantity), NULL, NULL FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'trade', 5000000000000000000 + l_orderkey * 100000000 + l_suppkey, 'shipped_by', 'PARTICIPANT', NULL, 6000000000000 + l_orderkey, 4000000000000 + l_suppkey, 'shipped_by', NULL, NULL, NULL FROM lineitem
  UNION ALL SELECT 'trade', 7000000000000 + event_id, 'observes', 'MEASUREMENT', 106, 7000000000000 + event_id, 3000000000000 + user_id, NULL, NULL, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) FROM events
  UNION ALL SELECT 'trade', 8000000000000 + event_id, 'DESCRIBES', 'DESCRIPTION', NULL, 8000000000000 + event_id, 7000000000000 + event_id, NULL, NULL, NULL, NULL FROM events
  UNION ALL SELECT 'trade', 9000000000000 + event_id, 'UNDERWENT', 'PARTICIPANT', NULL, 3000000000000 + user_id, 9000000000000 + event_id, 'UNDERWENT', NULL, NULL, NULL FROM events WHERE event_type = 'signup'
  UNION ALL SELECT 'trade', 10000000000000 + event_id, 'DETERMINES', 'RELATION', 105, 7000000000000 + event_id, 9000000000000 + event_id, NULL, NULL, NULL, NULL FROM events WHERE event_type = 'signup' AND value >= 50
  UNION ALL SELECT 'corpus', 11000000000000 + doc_id, 'sampled_from', 'MEASUREMENT', 107, 10000000000000 + doc_id, 14000000000000 + CAST(substr(source, 4) AS BIGINT), NULL, NULL, NULL, NULL FROM documents
  UNION ALL SELECT 'corpus', 12000000000000 + doc_id, 'DESCRIBES', 'DESCRIPTION', NULL, 11000000000000 + doc_id, 10000000000000 + doc_id, NULL, NULL, NULL, NULL FROM documents
  UNION ALL SELECT 'corpus', 13000000000000 + doc_id, 'DESCRIBES', 'DESCRIPTION', NULL, 12000000000000 + doc_id, 10000000000000 + doc_id, NULL, NULL, NULL, NULL FROM labels
  UNION ALL SELECT 'corpus', 14000000000000 + doc_id, 'DESCRIBES', 'DESCRIPTION', NULL, 13000000000000 + doc_id, 10000000000000 + doc_id, NULL, NULL, NULL, NULL FROM labels
  UNION ALL SELECT 'trade', 15000000000000 + event_id, 'retried', 'DESCRIPTION', NULL, 7000000000000 + event_id, 7000000000000 + event_id, NULL, NULL, NULL, NULL FROM events WHERE event_type = 'error'
)
"""

CATALOG = """categories AS (
  SELECT * FROM (VALUES (1, 'trade', 'ENTITY', 'region'), (2, 'trade', 'ENTITY', 'nation'), (3, 'trade', 'ENTITY', 'customer'), (4, 'trade', 'ENTITY', 'supplier'), (6, 'trade', 'PROTOCOL_EVENT', 'order'), (7, 'trade', 'STRUCTURE', '@trade/event'), (8, 'trade', 'METRIC', 'click'), (9, 'trade', 'METRIC', 'error'), (10, 'trade', 'METRIC', 'purchase'), (11, 'trade', 'METRIC', 'signup'), (12, 'trade', 'METRIC', 'view'), (13, 'trade', 'NATURAL_EVENT', 'signup event'), (14, 'corpus', 'STRUCTURE', '@corpus/document'), (15, 'corpus', 'METRIC', 'n_chars'), (16, 'corpus', 'METRIC', 'quality'), (17, 'corpus', 'METRIC', 'toxic'), (18, 'corpus', 'ENTITY', 'source'), (101, 'trade', 'RELATION', 'part of'), (102, 'trade', 'RELATION', 'located in'), (103, 'trade', 'RELATION', 'based in'), (105, 'trade', 'RELATION', 'determines'), (106, 'trade', 'MEASUREMENT', 'observes'), (107, 'corpus', 'MEASUREMENT', 'sampled from')) AS t(category_id, graph, kind, name)
  UNION ALL SELECT DISTINCT 200 + CAST(substr(p_brand, 7) AS INT), 'trade', 'REAGENT', p_brand FROM part
),
category_tags AS (
  SELECT * FROM (VALUES (1, 'place'), (2, 'place'), (3, 'party'), (4, 'party'), (18, 'provenance')) AS t(category_id, tag)
  UNION ALL SELECT category_id, 'material' FROM categories WHERE kind = 'REAGENT'
),
role_defs AS (
  SELECT * FROM (VALUES
    (6, 'in', 'entity', 'buyer', false, false, false, 3, CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS INT)),
    (6, 'in', 'entity', 'witness', true, false, false, NULL, 'party', NULL, NULL),
    (6, 'in', 'reagent', 'consumed', false, true, true, NULL, 'material', NULL, NULL),
    (6, 'out', 'entity', 'shipped_by', false, false, false, 4, NULL, NULL, NULL),
    (6, 'out', 'reagent', 'produced', true, true, false, NULL, 'material', NULL, NULL),
    (13, 'in', 'entity', 'UNDERWENT', false, false, false, 3, NULL, NULL, NULL)
  ) AS t(event_category_id, direction, member_kind, role, optional, variable_amount, needs_quantity, category_filter, tag_filter, default_use_active, default_use_new)
  UNION ALL SELECT 6, 'in', 'reagent', 'packaging', false, true, false, NULL, 'material', min(category_id), NULL FROM categories WHERE kind = 'REAGENT'
  UNION ALL SELECT 13, 'in', 'reagent', 'swab', false, true, false, NULL, 'material', NULL, max(category_id) FROM categories WHERE kind = 'REAGENT'
),
pins AS (SELECT * FROM (VALUES (1, 106), (2, 107), (2, 3)) AS t(user_id, category_id)),
saved_queries AS (SELECT * FROM (VALUES (1, 'metrics', 3, true), (2, 'lineage', 3, false), (3, 'documents', 14, false)) AS t(query_id, name, category_id, pinned))
"""

#: Parts of ``FACTS`` as Spark had better compute them: rows are told apart by their key before the other columns are made.
_FOR_SPARK = {
    "SELECT DISTINCT 'trade', 5000000000000000000 + l_orderkey": "SELECT 'trade', 5000000000000000000 + l_orderkey",
    "'shipped_by', NULL, NULL, NULL FROM lineitem": "'shipped_by', NULL, NULL, NULL FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)",
}

CATALOG_TABLES = ("categories", "category_tags", "role_defs", "pins", "saved_queries")


def _bodies() -> dict[str, str]:
    """The derived tables' SQL by name."""
    _, *parts = re.split(r"(?m)^(\w+) AS (?=\()", f"{FACTS.rstrip()},\n{CATALOG}")
    return {name: body.rstrip().removesuffix(",") for name, body in zip(parts[::2], parts[1::2])}


def _needed(sql: str, bodies: dict[str, str]) -> dict[str, str]:
    """Those of the derived tables that a query names, or that these are derived from, in their order."""
    words = lambda text: set(re.findall(r"\w+", text)) & bodies.keys()
    needed, todo = set(), words(sql)
    while todo:
        needed |= todo
        todo = set().union(*(words(bodies[name]) for name in todo)) - needed
    return {name: body for name, body in bodies.items() if name in needed}


def with_for(sql: str) -> str:
    """``sql`` behind a WITH clause of just those derived tables that it names, or that these are derived from; nodes and edges are derived once. It may go on with the clause, by a comma."""
    clauses = ",\n".join(f"{name} AS {'MATERIALIZED ' * (name in ('nodes', 'edges'))}{body}" for name, body in _needed(sql, _bodies()).items())
    if sql.startswith(","):
        return f"WITH {clauses}{sql}" if clauses else f"WITH {sql[1:].lstrip()}"
    return f"WITH {clauses}\n{sql}" if clauses else sql


def derived_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph as a query over the tables: nothing is stored, and each use derives it anew, of what it asks for. The session's views stay as they are."""
    bodies, read = _bodies(), {}
    for given_form, form in _FOR_SPARK.items():
        bodies["edges"] = bodies["edges"].replace(given_form, form)

    def derived(name: str) -> DataFrame:
        clauses = ",\n".join(f"{n} AS {body}" for n, body in _needed(name, bodies).items())
        sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", f"WITH {clauses} SELECT * FROM {name}")
        given = set(re.findall(r"{(\w+)}", sql))
        for table in given - read.keys():
            read[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return spark.sql(sql, **{table: read[table] for table in given})

    tables = {name: derived(name) for name in ("nodes", "edges", *CATALOG_TABLES)}
    return Graph(tables.pop("nodes").withColumn("variables", F.lit(None).cast(VARIABLES)), tables.pop("edges"), tables)


#: Where an application has stored the graph of a folder, by the state of the folder's tables.
_STORED: dict[tuple, str] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """What a stored graph belongs to: the application, the folder, and when each of its tables was changed."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path
    files = folder(sf_dir).getFileSystem(context._jsc.hadoopConfiguration())
    return (context.applicationId, sf_dir, *(files.getFileStatus(folder(f"{sf_dir}/{t}.parquet")).getModificationTime() for t in TABLES))


def _read(spark: SparkSession, path: str) -> Graph:
    return read_adjacency(spark, path, {name: spark.read.parquet(f"{path}/{name}") for name in CATALOG_TABLES})


def build_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder's tables: derived and stored in adjacency layout once in an application, then read from there.

    It is stored anew when a table has changed, or when what was stored is gone."""
    state = _state(spark, sf_dir)
    path = _STORED.get(state)
    if path is None or not is_stored(spark, path):
        path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
        g = derived_graph(spark, sf_dir)
        for name, table in g.catalog.items():
            table.coalesce(1).write.parquet(f"{path}/{name}")
        store_adjacency(Graph(checkpointed(g.nodes), checkpointed(g.edges)), path)
        _STORED[state] = path
    return _read(spark, path)


def open_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph as ``build_graph`` has stored it, if it has in this application, else derived: a question then reads just those tables, columns and kinds
    of nodes and edges that it asks for. Storing pays for many questions on one graph; for one, it costs several times what the answer does."""
    path = _STORED.get(_state(spark, sf_dir)) if _STORED else None
    return _read(spark, path) if path is not None and is_stored(spark, path) else derived_graph(spark, sf_dir)
