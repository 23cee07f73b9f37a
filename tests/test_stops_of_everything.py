"""Stops of everything over many problems: rows a group, not a problem, and the same states as a fold."""

import random

import pytest
from test_solver_state import DELAY, IDLE, SCHEMA, folded

from sparkfolio.streaming import solver_state as S


def made(seed, problems=30, n=500):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        draw, at = rng.random(), 10_000 + seq * 20
        if draw < 0.1:
            rows.append((None, None, seq, "event", "stop", None, at))
        elif draw < 0.15:
            rows.append((rng.randrange(problems), None, seq, "event", "stop", None, at))
        elif draw < 0.5:
            rows.append((rng.randrange(problems), rng.randrange(3), seq, "event", rng.choice(("start", "start", "start", "done", "error", "what", "stop")), None, at))
        else:
            rows.append((rng.randrange(problems), rng.randrange(3), seq, "text", None, f"<{seq}>", at))
    return rows + [(problems, 1, n, "event", "start", None, 10_000 + n * 20 + 2 * DELAY)]


@pytest.mark.parametrize(("cuts", "groups"), [((), 512), ((200, 230), 2)])
def test_states_of_known_problems(spark, tmp_path, monkeypatch, cuts, groups):
    monkeypatch.setattr(S, "GROUPS", groups)
    rows = made(len(cuts))
    edges = [0, *cuts, len(rows)]
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        spark.createDataFrame(rows[a:b], SCHEMA.rsplit(",", 1)[0]).selectExpr("*", "timestamp_millis(at) as time").coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = S.run(stream, str(tmp_path), IDLE, f"{DELAY} milliseconds", S.KNOWN).collect()
    assert {(r.problem, r.model): (r.status, r.started, r.finished, r.text) for r in got} == folded(rows)


def test_a_stop_is_a_row_a_group(spark):
    """5 stops and 2,000 problems made 10,000 rows."""
    one = [(p, 0, p, "event", "start", None, p) for p in range(2000)] + [(None, None, 3000 + k, "event", "stop", None, 3000 + k) for k in range(5)]
    chunks = spark.createDataFrame(one, SCHEMA.rsplit(",", 1)[0]).selectExpr("*", "timestamp_millis(at) as time")
    assert S.grouped(chunks, S.KNOWN).count() == 2000 + 5 * S.GROUPS
    assert S.grouped(chunks).count() == 2000
    few = S.grouped(chunks, spark.createDataFrame([(7,), (7,), (8,)], "problem long"))
    assert few.where("every").count() == 5 * S.GROUPS and sorted(r.problem for r in few.where("listed").collect()) == [7, 8]
