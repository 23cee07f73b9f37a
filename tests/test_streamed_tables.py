"""Queries that stream a table: it may be one file or a folder of them, and the rows are the same."""

import os
from datetime import datetime, timedelta

import pytest

from sparkfolio.plans import registry

DATA = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def documents(spark):
    return spark.createDataFrame([(k, f" text\n{k} ", "en") for k in range(9)], "doc_id long, text string, lang string")


def test_documents_in_a_folder(spark, tmp_path):
    documents(spark).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["incremental_results"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.raw_md5 is not None) for r in got) == [(k, k % 3 == 0) for k in range(9)]


def test_conversations_in_a_folder(spark, tmp_path):
    rows = [(k // 3, k % 3, "user", f"said {k}") for k in range(9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["ndjson_results"](spark, str(tmp_path)).collect()
    assert sorted((r.problemId, r.modelId) for r in got) == [(str(c), f"{t}-user") for c, t, *_ in rows]


def events(spark):
    """A user's chunks in three files, the later ones first."""
    moment = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    rows = [(k, moment(k), 5, "view" if k < 3 else "click" if k < 27 else "purchase", 0.0, "") for k in range(30)]
    return [spark.createDataFrame(rows[k : k + 10], EVENTS).coalesce(1) for k in (20, 10, 0)]


@pytest.fixture
def small_frames(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "4")
    yield
    spark.conf.set(key, was)


def test_chain_over_events_in_a_folder(spark, tmp_path, small_frames):
    for part in events(spark):
        part.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["stream_chain"](spark, str(tmp_path)).collect()
    assert sorted((r.problem, r.stage, r.status) for r in got) == [(5, "map", "done"), (5, "results", "done"), (5, "summary", "done")]


def test_states_over_events_in_a_folder(spark, tmp_path, small_frames):
    for part in events(spark):
        part.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {r.model: r for r in registry.QUERIES["stream_state_fold_live"](spark, str(tmp_path)).collect()}
    assert {m: (r.status, r.text) for m, r in got.items()} == {m: ("done", "".join(f"t{k}" for k in range(3, 27) if k % 3 == m)) for m in range(3)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_solver_states_of_events_whose_ids_are_not_in_the_order_of_time(spark, tmp_path):
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"create view events as select e.* replace ((event_id + x * 100000)::bigint as event_id, (user_id + x * 1500)::bigint as user_id) from '{DATA}/events.parquet' e, range(2) r(x)")
    os.mkdir(f"{tmp_path}/events.parquet")
    con.execute(f"copy events to '{tmp_path}/events.parquet/part-0.parquet' (format parquet)")
    name, columns = "stream_solver_states", ("problem", "model", "status", "started", "finished", "text")
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.sql(registry.ORACLES[name]).select(*columns).fetchall(), key=repr)
