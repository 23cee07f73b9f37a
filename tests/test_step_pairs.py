"""Pairs of steps: dealt by problem once, and equal to the SQL where steps repeat, share nothing or lack a text."""

import pytest

from sparkfolio.operators import align
from sparkfolio.plans import registry

ROWS = [
    (0, 0, "solve x = 2. then add"), (0, 1, "solve x = 2. then add"), (0, 1, "solve x = 2. then add"), (1, 0, "add both sides. x = 2"), (1, 1, ""), (2, 0, None), (2, 1, "!!!"),
    (3, 0, "nothing alike"), (4, 2, "solve x = 2. then add"), (5, 0, "alone in its problem"), (10, 0, "x"), (11, 0, "x"), (None, 0, "x"),
]


@pytest.mark.parametrize("name", ["step_pair_score", "step_pair_cosine", "tfidf_weights"])
def test_odd_steps_equal_sql(spark, tmp_path, name):
    con = pytest.importorskip("duckdb").connect()
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(c, t, "user", x) for c, t, x in ROWS], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(path)
    con.execute(f"create view conversations as select * from read_parquet('{path}/*.parquet')")
    got, want = registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.ORACLES[name])
    order = sorted(got.columns)
    assert sorted(map(tuple, got.select(*order).collect()), key=repr) == sorted(want.select(*(f'"{c}"' for c in order)).fetchall(), key=repr)


def test_scores_shuffle_steps_once(spark):
    steps = spark.createDataFrame([(0, s, i, f"title {i}", f"body {s} {i}") for s in range(3) for i in range(3)], "problem long, solver long, idx int, title string, body string")
    scored = align.scores(steps)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert scored.count() == 27
