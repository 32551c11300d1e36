"""Streams that hold batches against a table by key: equal to one upsert of everything, once for each batch, and in proportion to it."""

import os
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_golden import EDGE_SCHEMA, NODE_SCHEMA
from weftgraph.schema import Graph
from weftgraph.streaming import ingest as stream
from weftgraph.streaming.keyed import KeyedRuns, _bits

INPUTS = "graph string, category_id long, external_id string, name string, created_at timestamp_ntz, order_no long, input_no long"
T = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(40)]


@pytest.fixture(scope="module")
def base(spark):
    nodes = [("t", i, "Entity", "ENTITY", 1, "c", f"k{i}" if i < 8 else None, f"old{i}", None, None, None, None, T[0], None, None, 7, None, None) for i in range(10)]
    nodes.append(("t", 50, "Structure", "STRUCTURE", 2, "c", "k1", "s", None, None, None, None, None, None, None, None, None, None))
    return Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))


def size_of(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_the_graph_is_right_after_each_batch(spark, base, tmp_path):
    rng = random.Random(1)
    store = stream.entity_store(base, str(tmp_path), buckets=4, fan=3)
    state = {("k%d" % i): (i, f"old{i}", T[0], -1) for i in range(8)}
    loose, number = {(8, "old8"), (9, "old9")}, 0
    for version in range(8):
        batch = []
        for _ in range(rng.randint(0, 6)):
            number += 1
            key = rng.choice([*[f"k{i}" for i in range(12)], None])
            at = rng.choice([None, T[0], *T[5:30]])
            batch.append(("t", 1, key, f"new{number}", at, number, number))
        if version == 3:
            batch = []
        stream.upsert_entities(store, spark.createDataFrame(batch, INPUTS), version, 1_000)
        ranked = lambda r: (r[4] is not None, r[4] or T[0], r[5])
        for key in {r[2] for r in batch if r[2]}:
            last = max((r for r in batch if r[2] == key), key=ranked)
            known = state.get(key)
            if known is None or ranked(last) > (known[2] is not None, known[2] or T[0], known[3]):
                state[key] = (known[0] if known else 1_000 + last[6], last[3], last[4], last[5])
        loose |= {(1_000 + r[6], r[3]) for r in batch if r[2] is None}
        got = stream.upserted(base, store).nodes.where("node_type = 'ENTITY'").collect()
        assert {(r.external_id, r.id, r.name, r.created_at) for r in got if r.external_id} == {(k, *v[:3]) for k, v in state.items()}
        assert {(r.id, r.name) for r in got if r.external_id is None} == loose
        assert {r.local_seq for r in got if r.id < 10} == {7} and len(got) == len(state) + len(loose)
        before = rows = sorted(map(repr, got))
        stream.upsert_entities(store, spark.createDataFrame([("t", 1, "k1", "again", T[39], 99, 99)], INPUTS), version, 1_000)  # the batch comes once more
        rows = sorted(map(repr, stream.upserted(base, store).nodes.where("node_type = 'ENTITY'").collect()))
        assert rows == before
    assert stream.upserted(base, store).nodes.where("node_type = 'STRUCTURE'").count() == 1
    assert len(store._runs(store.version())) <= 3 * 3
    names = {r.name for r in stream.upserted(base, store).nodes.collect()}
    store.clean()
    assert {r.name for r in stream.upserted(base, store).nodes.collect()} == names and len(store._versions()) == 2


def test_a_crash_before_the_version_is_published_leaves_the_one_before(spark, base, tmp_path, monkeypatch):
    store = stream.entity_store(base, str(tmp_path), buckets=2)
    batch = spark.createDataFrame([("t", 1, "k1", "new", T[3], 1, 1)], INPUTS)
    publish = KeyedRuns._publish

    def broken(self, version, runs):
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedRuns, "_publish", broken)
    with pytest.raises(RuntimeError):
        stream.upsert_entities(store, batch, 0, 100)
    monkeypatch.setattr(KeyedRuns, "_publish", publish)
    name = lambda: stream.upserted(base, store).nodes.where("external_id = 'k1' AND node_type = 'ENTITY'").first().name
    assert name() == "old1"
    stream.upsert_entities(store, batch, 0, 100)
    assert name() == "new" and stream.upserted(base, store, -1).nodes.where("name = 'new'").count() == 0


def test_a_batch_writes_and_reads_in_proportion_to_itself(spark, tmp_path):
    store = stream.dedupe_store(spark, str(tmp_path), spark.range(1).select(F.col("id").alias("event_id"), F.lit("x").alias("text")).schema, buckets=4, fan=50)
    wide = lambda a, b: spark.range(a, b).select(F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    stream.add_unseen(store, wide(0, 50_000), 0)
    first = size_of(tmp_path)
    stream.add_unseen(store, wide(50_000, 50_100), 1)
    assert size_of(tmp_path) - first < first / 50
    # keys that nobody had: the filters answer nearly all, and hardly a bucket is read
    asked = store.held(wide(900_000, 900_200)).select("event_id")
    assert asked.count() == 0
    again = store.held(wide(0, 300))
    assert again.count() == 300 and sorted(r.event_id for r in again.collect()) == list(range(300))
    filters = store._filters(store._runs(1))
    probed = wide(900_000, 920_000).withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int")).join(filters, "bucket")
    share = probed.where(F.forall(_bits(["event_id"], F.size("words")), lambda x: F.getbit(F.element_at("words", x["word"] + 1), x["bit"]) == 1)).count()
    assert share < 0.02 * 40_000


def test_repeats_are_dropped_however_late_and_no_state_is_kept(spark, tmp_path):
    rows = [(i % 60, i) for i in range(120)] + [(None, 7)]
    random.Random(2).shuffle(rows)
    events = spark.createDataFrame(rows, "event_id long, user_id long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    events.repartition(12).write.parquet(f"{tmp_path}/events.parquet")
    source = stream.read_events(spark, str(tmp_path), files_per_batch=1).select("event_id", "user_id")
    store = stream.dedupe_store(spark, f"{tmp_path}/seen", source.schema, buckets=2, fan=4)
    query = stream.stream_dedupe(source, store, f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert len(query.recentProgress) >= 12 and not any(p["stateOperators"] for p in query.recentProgress)
    assert not os.path.exists(f"{tmp_path}/checkpoint/state")
    got = store.rows().collect()
    assert sorted(r.event_id for r in got) == list(range(60)) and all((r.event_id, r.user_id) in rows for r in got)
