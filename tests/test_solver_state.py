"""The stateful operator against a fold of the same chunks, whatever triggers cut the stream."""

import random
from pathlib import Path

import pytest

from sparkfolio.streaming import solver_state as S

SCHEMA = "problem long, model long, seq long, kind string, event string, text string, at long, time timestamp"
IDLE, DELAY = 1000, 5000


def folded(rows, idle=IDLE, delay=DELAY):
    """What the rules say of all chunks in order of seq."""
    states, texts = {}, {}
    for problem, model, _, kind, event, text, at in sorted(rows, key=lambda r: r[2]):
        for k in states:
            if problem is None or k[0] == problem:
                states[k] = S.expired(states[k], at, idle)
                if event == "stop" and model is None:
                    states[k] = S.stopped(states[k], at)
        if model is None:
            continue
        k = (problem, model)
        now = states.get(k, S.NEW)
        if not now[4]:
            states[k] = S.advanced(now, kind, event, at)
            if kind == "text":
                texts[k] = texts.get(k, "") + (text or "")
    end = max(r[6] for r in rows) - delay
    states = {k: S.expired(s, end, idle) for k, s in states.items()}
    return {k: (*s[:3], texts.get(k, "") if s[0] in S.TERMINAL else None) for k, s in states.items()}


def streamed(spark, folder, parts):
    for n, part in enumerate(parts):
        rows = spark.createDataFrame(part, SCHEMA.rsplit(",", 1)[0]).selectExpr("*", "timestamp_millis(at) as time")
        rows.coalesce(1).write.parquet(f"{folder}/in/part={n}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    problems = spark.createDataFrame([(p,) for p in range(1, 9)], "problem long")
    got = S.run(stream, str(folder), IDLE, f"{DELAY} milliseconds", problems).collect()
    return {(r.problem, r.model): (r.status, r.started, r.finished, r.text) for r in got}


def made(seed, n=160):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        problem = rng.randrange(1, 6)
        kind = rng.choice(("text", "text", "event"))
        event = rng.choice(("start", "start", "done", "error", "what", "stop")) if kind == "event" else None
        model = None if event == "stop" and rng.random() < 0.6 else rng.randrange(3)
        rows.append((None if model is None and rng.random() < 0.3 else problem, model, seq, kind, event, f"<{seq}>" if kind == "text" else None, 10_000 + seq * 60))
    return rows + [(7, 1, n, "event", "start", None, 10_000 + n * 60 + 2 * DELAY)]


@pytest.mark.parametrize("cuts", [(), (70,), (20, 90, 130)])
def test_states_equal_a_fold(spark, tmp_path, cuts):
    rows = made(len(cuts))
    edges = [0, *cuts, len(rows)]
    got = streamed(spark, tmp_path, [rows[a:b] for a, b in zip(edges, edges[1:], strict=False)])
    assert got == folded(rows)
    assert {s[0] for s in got.values()} >= {"streaming", "stopped", "error"}


def test_state_grows_by_what_comes(spark, tmp_path):
    """A trigger's state writes follow its own chunks, however long the text is by then."""
    long = "x" * 20_000
    parts = [[(1, 1, n * 100 + k, "text", None, long, 10_000 + n * 100 + k) for k in range(1, 11)] for n in range(4)]
    parts.append([(1, 1, 900, "event", "done", None, 10_900)])
    got = streamed(spark, tmp_path, parts)
    assert got[1, 1][0] == "done" and len(got[1, 1][3]) == 40 * 20_000
    sizes = [sum(f.stat().st_size for f in Path(tmp_path).rglob(f"state/0/*/{v}.changelog")) or sum(f.stat().st_size for f in Path(tmp_path).rglob(f"state/0/*/{v}_*.changelog")) for v in range(1, 5)]
    if all(sizes):
        assert max(sizes) < 3 * min(sizes)


def test_rules_of_a_state():
    state = S.advanced(S.NEW, "event", "start", 5)
    assert state == ("streaming", 5, None, 5, False)
    assert S.expired(state, 1004, IDLE) == state
    assert S.expired(state, 1005, IDLE) == ("error", 5, 1005, 5, False)
    assert S.advanced(S.expired(state, 2000, IDLE), "text", None, 2000)[0] == "error"
    assert S.advanced(S.stopped(state, 9), "event", "start", 10) == ("streaming", 10, None, 10, False)
    assert S.advanced(state, "event", "stop", 7)[4] is True
    assert S.advanced(state, "event", "unknown", 8) == ("streaming", 5, None, 8, False)
