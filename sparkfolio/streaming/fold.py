"""Solver streams: chunks folded into one state a key, in batch and as a Structured Streaming query.

Chunks are (problem, model, seq, kind, event, text, at): kind is event or text, event is start, done, error or stop.
start begins and clears an error but keeps the text so far; text is appended and does not change the status; after a
stop nothing counts; an unknown event changes nothing.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import exists

KEY = ["problem", "model"]
STATE = "status string, text string, started long, finished long"
OUT = f"problem long, model long, {STATE}"
TERMINAL = ("done", "error", "stopped")


def fold_batch(chunks: DataFrame) -> DataFrame:
    """The final state of each key, by one aggregation: the last event that counts, texts in order."""
    stop = F.min(F.when(F.col("event") == "stop", F.col("seq"))).over(Window.partitionBy(*KEY))
    live = chunks.withColumn("stop_at", stop).where(F.col("stop_at").isNull() | (F.col("seq") <= F.col("stop_at")))
    known = F.col("event").isin("start", "done", "error", "stop")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("seq", "text")))), lambda x: x["text"]), "")
    last = F.max_by(F.when(known, F.col("event")), F.when(known, F.col("seq")))
    status = F.create_map(*[F.lit(x) for x in ("start", "streaming", "done", "done", "error", "error", "stop", "stopped")])
    ended = F.max_by(F.when(known, F.col("at")), F.when(known, F.col("seq")))
    rows = live.groupBy(*KEY).agg(last.alias("last"), texts.alias("text"), F.max(F.when(F.col("event") == "start", F.struct("seq", "at"))).alias("begun"), ended.alias("ended"))
    now = F.coalesce(F.element_at(status, F.col("last")), F.lit("idle"))
    return rows.select(*KEY, now.alias("status"), "text", F.col("begun.at").alias("started"), F.when(now.isin(*TERMINAL), F.col("ended")).alias("finished"))


def advance(state: tuple, chunks: pd.DataFrame) -> tuple:
    """state (status, text, started, finished) after chunks, in order of seq."""
    status, text, started, finished = state
    for kind, event, piece, at in chunks.sort_values("seq")[["kind", "event", "text", "at"]].itertuples(index=False):
        if status == "stopped":
            break
        if kind == "text":
            text += piece or ""
        elif event == "start":
            status, started, finished = "streaming", int(at), None
        elif event in ("done", "error", "stop"):
            status, finished = {"stop": "stopped"}.get(event, event), int(at)
    return status, text, started, finished


def expired(state: tuple, at: int) -> tuple:
    """state after nothing came for too long: a key that had not ended is an error."""
    status, text, started, finished = state
    return (status, text, started, finished) if status in TERMINAL else ("error", text, started, at)


def _stepped(idle_ms: int | None):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("idle", "", None, None)
        if state.hasTimedOut:
            now = expired(now, state.getCurrentProcessingTimeMs())
        else:
            # Spark cuts a key's rows into frames anywhere and in no order, so they are sorted together; their texts are in its state anyway.
            now = advance(now, pd.concat(list(frames)))
        state.update(now)
        if idle_ms and now[0] not in TERMINAL:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(*key, *now)], columns=["problem", "model", "status", "text", "started", "finished"]).astype({"started": "Int64", "finished": "Int64"})

    return step


def fold_stream(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A streaming frame of states that changed; order within a key is seq within a trigger, arrival across triggers.

    With idle_ms a key that has not ended becomes an error when nothing comes for so long.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy(*KEY).applyInPandasWithState(_stepped(idle_ms), OUT, STATE, "update", timeout)


def spread_stops(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """chunks in which a stop without a model is one for each model of its problem, and one without a problem one for every
    key. keys (problem, model) may be a table beside a stream.
    """
    wide = (F.col("event") == "stop") & F.col("model").isNull()
    own = keys.select(F.col("problem").alias("k_problem"), F.col("model").alias("k_model")).distinct()
    one = chunks.where(wide & F.col("problem").isNotNull()).join(own, F.col("problem") == F.col("k_problem"))
    # The few rows that stop everything are the side that is broadcast; the keys stay where they are.
    stops = chunks.where(wide & F.col("problem").isNull()).withColumn("all", F.lit(1))
    every = own.withColumn("all", F.lit(1)).join(F.broadcast(stops), "all").drop("all")
    back = lambda df: df.withColumns({"problem": F.col("k_problem"), "model": F.col("k_model")}).select(*chunks.columns)
    return chunks.where(~F.coalesce(wide, F.lit(False))).unionByName(back(one)).unionByName(back(every))


READY = "problem long, models long, done long"


def _ready(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    told, known = state.get if state.exists else (False, "{}")
    statuses = {int(m): s for m, s in json.loads(known).items()}
    # The frames of a trigger are sorted together, as in fold_stream(); of texts only their models are held.
    held = pd.concat([frame[["model", "seq", "kind", "event", "at"]] for frame in frames]).assign(text="")
    for model, own in held.groupby("model"):
        statuses[int(model)] = advance((statuses.get(int(model), "idle"), "", None, None), own[own["kind"] == "event"])[0]
    ended = bool(statuses) and all(s in TERMINAL for s in statuses.values())
    state.update((told or ended, json.dumps(statuses)))
    if ended and not told:
        yield pd.DataFrame({"problem": [key[0]], "models": [len(statuses)], "done": [sum(s == "done" for s in statuses.values())]})


def barrier_stream(chunks: DataFrame) -> DataFrame:
    """A streaming frame (problem, models, done) with a row for each problem whose models have all ended: once, whatever comes later."""
    return chunks.groupBy("problem").applyInPandasWithState(_ready, READY, "told boolean, statuses string", "append", GroupStateTimeout.NoTimeout)


Stage = Callable[[DataFrame], DataFrame]


def run_chain(stream: DataFrame, folder: str, stages: list[tuple[str, Stage]]) -> DataFrame:
    """(problem, stage, status, message) of stages run once for each problem that becomes ready, one after the other.

    A stage takes the problems of a trigger that its predecessor did, as (problem, models, done), and returns (problem,
    message), message being null where it succeeded. What fails is not tried again, and no later stage sees it.
    """
    spark, out = stream.sparkSession, f"{folder}/chain-{uuid.uuid4().hex}"

    def each(ready: DataFrame, n: int) -> None:
        ready.write.mode("overwrite").parquet(f"{out}/ready/batch={n}")
        live = spark.read.schema(READY).parquet(f"{out}/ready/batch={n}")
        for name, stage in stages:
            path = f"{out}/data/batch={n}/stage={name}"
            stage(live).select("problem", "message").write.mode("overwrite").parquet(path)
            said = spark.read.schema("problem long, message string").parquet(path)
            live = live.join(said.where("message is null"), "problem", "left_semi")

    query = barrier_stream(stream).writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    said = "problem long, message string, batch long, stage string"
    rows = spark.read.schema(said).parquet(f"{out}/data") if exists(spark, f"{out}/data") else spark.createDataFrame([], said)
    return rows.select("problem", "stage", F.when(F.col("message").isNull(), "done").otherwise("error").alias("status"), "message")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Fold all that is there now; states are appended trigger by trigger under `folder`, and the latest of each key is returned."""
    spark, out = stream.sparkSession, f"{folder}/states-{uuid.uuid4().hex}"
    write = lambda df, n: df.withColumn("trigger", F.lit(n)).write.mode("overwrite").parquet(f"{out}/data/batch={n}")
    query = fold_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    held = f"{OUT}, trigger long"
    rows = spark.read.schema(held).parquet(f"{out}/data") if exists(spark, f"{out}/data") else spark.createDataFrame([], held)
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("status", "text", "started", "finished"), "trigger").alias("s")).select(*KEY, "s.*")


def own_folder(spark: SparkSession) -> str:
    """A folder for a local session in which spark.checkpoint.dir is unset; on a cluster no such folder is shared."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="folio-stream-")


def barrier(states: DataFrame) -> DataFrame:
    """Problems whose models have all ended: those whose results can be built, once."""
    return states.groupBy("problem").agg(F.bool_and(F.col("status").isin(*TERMINAL)).alias("ready"), F.count(F.lit(1)).alias("models"), F.sum((F.col("status") == "done").cast("long")).alias("done")).where("ready").drop("ready")
