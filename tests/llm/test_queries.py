"""Registered queries: the columns of their contracts, and the SQL of those that have one."""

import os

import pytest

from sparkfolio.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")

COLUMNS = {
    "op1_": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op2_": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op3_": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_": {"doc_id": "bigint", "tokens": "bigint", "probability": "double", "weight": "double", "sampled": "boolean"},
    "op5_": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op7_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_": {"doc_id": "bigint", "perplexity": "double", "kept": "boolean"},
    "op9_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op11_": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op12_": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op13_": {"nation_id": "int", "from_s": "bigint", "to_s": "bigint", "n_open": "bigint", "open_cents": "bigint", "high_open": "bigint", "is_peak": "boolean"},
}


@pytest.mark.parametrize("prefix", COLUMNS)
def test_columns_of_the_contract(spark, prefix):
    (name,) = [q for q in queries.QUERIES if q.startswith(prefix)]
    assert COLUMNS[prefix].items() <= dict(queries.QUERIES[name](spark, DATA).dtypes).items()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    got = queries.QUERIES[name](spark, DATA)
    order = sorted(got.columns)
    want = con.sql(queries.ORACLES[name]).select(*(f'"{c}"' for c in order)).fetchall()
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(want)
