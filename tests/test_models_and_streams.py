"""Back-off and failures of models, salvage of broken replies, expiry and readiness of streams."""

import pandas as pd

from sparkfolio.operators import models, solve
from sparkfolio.streaming import fold


def test_waits_between_attempts_and_keeps_failures():
    slept, calls = [], []

    def flaky(batch):
        calls.append(len(batch))
        if len(calls) < 3:
            raise RuntimeError("busy")
        return batch["stored"].str.upper()

    batch = pd.DataFrame({"stored": ["a", "b"]})
    got = models.attempted(flaky, batch, 3, 2.0, slept.append)
    assert list(got.reply) == ["A", "B"] and got.error.isna().all() and slept == [2.0, 4.0]
    calls.clear()
    got = models.attempted(flaky, batch, 2, 2.0, slept.append)
    assert got.reply.isna().all() and list(got.error) == ["RuntimeError: busy"] * 2


def test_salvage_reads_members_of_cut_replies():
    text = 'x {"steps": [{"step_idx": 1, "title": "a \\"q\\"", "content": "b } c"}, {"step_idx": 2, "title": "t"}, {"step_idx": 3, "title": "u", "content": "\\frac v"'
    got = solve.repaired(text + ', "final_answer": "7')
    assert [(s["step_idx"], s["title"]) for s in got["steps"]] == [(1, 'a "q"'), (3, "u")]
    assert got["steps"][0]["content"] == "b } c" and got["final_answer"] == "" and got["confidence"] == "low"
    assert solve.repaired(text + ', "final_answer" : "7", {')["final_answer"] == "7"
    assert solve.repaired("nothing")["steps"] == []


def test_expiry_ends_only_what_has_not_ended():
    assert fold.expired(("streaming", "ab", 1, None), 9) == ("error", "ab", 1, 9)
    for status in fold.TERMINAL:
        assert fold.expired((status, "ab", 1, 2), 9) == (status, "ab", 1, 2)


def test_problem_is_ready_once(spark, tmp_path):
    schema = "problem long, model long, seq long, kind string, event string, text string, at long"
    rows = [[(1, 1, 1, "event", "start", None, 1), (1, 2, 2, "event", "start", None, 1), (2, 1, 3, "event", "done", None, 2)], [(1, 1, 4, "event", "done", None, 3), (1, 2, 5, "event", "error", None, 3)], [(1, 1, 6, "event", "start", None, 4), (1, 1, 7, "event", "done", None, 5)]]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    query = fold.barrier_stream(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).start()
    query.awaitTermination()
    assert sorted(seen) == [(1, 2, 1), (2, 1, 1)]


def test_idle_keys_expire(spark, tmp_path):
    schema = "problem long, model long, seq long, kind string, event string, text string, at long"
    spark.createDataFrame([(1, 1, 1, "event", "start", None, 1), (1, 2, 2, "event", "done", None, 1)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = fold.fold_stream(stream, idle_ms=1000).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").foreachBatch(lambda df, n: seen.extend((r.problem, r.model, r.status) for r in df.collect())).start()
    try:
        for _ in range(40):
            query.awaitTermination(1)
            if (1, 1, "error") in seen:
                break
    finally:
        query.stop()
    assert seen.count((1, 1, "error")) == 1 and (1, 2, "done") in seen and (1, 2, "error") not in seen


def test_streams_of_which_nothing_has_come(spark, tmp_path):
    schema = "problem long, model long, seq long, kind string, event string, text string, at long"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert fold.run_available(stream, str(tmp_path)).count() == 0
    assert fold.run_chain(stream, str(tmp_path), []).count() == 0
