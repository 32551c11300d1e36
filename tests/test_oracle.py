"""Registered graph queries against DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from weftgraph.operators import paging
from weftgraph.plans import catalogue
from weftgraph.sources import fixture

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that cover each family; all are compared by the driver.
CHECKED = "scan_nodes edges_by_id filter_entities filter_reagents project_edge_public cast_columns incident_edges neighbors paired_nodes degree measurement_path match_pattern match_variable_length resolve_roles set_active_reagent subjectable_to knowledge_views best_view entity_metric_summary pivot_metrics latest_measurement close_open_windows assign_local_ids page_edges page_concat valid_at graph_as_of_edges catalog_as_of scatter_points normalize_names parse_structure_refs ingest_entities ingest_metrics catalog_upsert decode_graph_values stream_ingest_facts stream_upsert_entities audit_edge_definitions project_node_public collect_measures measurement_at_event resolve_roles_default_new resolve_roles_edges record_protocol_events_upsert record_protocol_events_edges record_protocol_events_edges_updated record_protocol_events_repeat event_factors factor_totals factor_paths match_pattern_rare_end match_variable_length_ends random_nodes lineage ingest_entities_sequence ingest_metrics_kinds stream_upsert_graph drop_stored_graph snapshot_manifest".split()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_matches(spark, duck, name):
    got = catalogue.queries()[name](spark, str(SF))
    rows = duck.execute(catalogue.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in duck.description]
    assert sorted(columns) == sorted(got.columns)
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert mine == sorted(map(repr, rows))


def test_views_of_the_session_stay(spark):
    spark.range(3).createOrReplaceTempView("orders")
    try:
        g = fixture.derived_graph(spark, str(SF))
        assert g.nodes.where("category_type = 'order'").count() == spark.read.parquet(f"{SF}/orders.parquet").count()
        assert g.edges.columns and spark.table("orders").columns == ["id"]
        assert "part" not in {t.name for t in spark.catalog.listTables()}
    finally:
        spark.catalog.dropTempView("orders")


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_a_question_stores_no_graph(spark, monkeypatch):
    def stores(*_):
        raise AssertionError("a single query stored the whole graph")

    monkeypatch.setattr(fixture, "_STORED", {})
    with monkeypatch.context() as m:
        m.setattr(fixture, "store_adjacency", stores)
        assert catalogue.queries()["usable_in"](spark, str(SF)).count() > 0


def test_stored_and_derived_graph_agree(spark, monkeypatch):
    monkeypatch.setattr(fixture, "_STORED", {})
    names = ("resolve_roles", "close_open_windows")
    derived = [sorted(map(repr, catalogue.queries()[n](spark, str(SF)).collect())) for n in names]
    fixture.build_graph(spark, str(SF))  # from here on, queries read what is stored
    assert fixture.open_graph(spark, str(SF)).sides
    assert derived == [sorted(map(repr, catalogue.queries()[n](spark, str(SF)).collect())) for n in names]


def test_a_distinct_edge_is_told_by_its_key(spark):
    """The forms for Spark replace parts that are there, and give the same edges."""
    bodies = fixture._bodies()
    assert all(bodies["edges"].count(given) == 1 for given in fixture._FOR_SPARK)
    plan = fixture.derived_graph(spark, str(SF)).edges.where("label = 'shipped_by'")
    assert plan.count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct().count()


def test_roles_are_resolved_once(spark, monkeypatch):
    """What a query makes of resolved roles reads them, and doesn't derive their participants for each use."""
    monkeypatch.setattr(fixture, "_STORED", {})
    plan = catalogue.queries()["resolve_roles_default_new"](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "default_use_new" in plan


def test_a_deep_page_derives_the_edges_once(spark, duck, monkeypatch):
    """They are counted and paged as they were cut, with the columns that are asked for."""
    cuts, cut = [], paging.checkpointed
    monkeypatch.setattr(fixture, "_STORED", {})
    monkeypatch.setattr(paging, "checkpointed", lambda df: cuts.append(df.columns) or cut(df))
    got = catalogue.queries()["page_edges_deep"](spark, str(SF))
    assert cuts == [["graph", "id", "label", "src", "dst"]]
    assert "lineitem" not in "".join(got.inputFiles())
    assert [tuple(r) for r in got.collect()] == duck.execute(catalogue.oracle_sql()["page_edges_deep"]).fetchall()


@pytest.mark.parametrize("name, tables", (("close_open_windows", {"documents", "events"}), ("usable_in", {"part"})))
def test_windows_and_roles_read_what_they_ask_for(spark, duck, monkeypatch, name, tables):
    """They read these given tables, and neither a stored graph nor any other table."""
    monkeypatch.setattr(fixture, "_STORED", {})
    got = catalogue.queries()[name](spark, str(SF))
    assert {Path(f).name for f in got.inputFiles()} == {f"{t}.parquet" for t in tables}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, duck.execute(catalogue.oracle_sql()[name]).fetchall()))
