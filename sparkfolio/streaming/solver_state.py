"""The solvers' state machine as one stateful operator over a stream: texts appended to state, timers, stops in the stream.

Chunks are (problem, model, seq, kind, event, text, at, time): kind is event or text, at and time are one moment in milliseconds and
as a timestamp with a watermark. State is kept by group of problems: a list of its models' states, to which a trigger appends those
that it touches (it is written anew once most of it no longer counts), and a list of pieces of text, which is only ever appended to. A text is put together when its model
ends (and again if more of it comes later), not at every trigger. A stop of everything is one row a group and meets a problem only
where the problem's chunks leave it something to stop, so the work grows with the chunks and not with stops times problems.

Rules: start begins and clears an end but keeps the text; text is appended whatever the status; done and error end; an
unknown event changes nothing. A stop of a model ends it for good and later chunks of it are dropped. A stop of a problem (model
null) stops its models that are streaming, a stop of everything (problem null) those of all problems. A model that has not ended
and of which nothing comes for `idle_ms` of event time is an error as of then: the next chunk of its problem says so,
or else a timer once the watermark has passed. So the outcome does not depend on where triggers cut the stream.

Chunks of a problem that one trigger brings are sorted by time, then seq, together; across triggers they count as they arrive. Rows
later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import exists

TERMINAL = ("done", "error", "stopped")
OUT = "problem long, model long, status string, started long, finished long, text string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEW = ("idle", None, None, None, False)


def expired(state: tuple, at: int, idle_ms: int) -> tuple:
    """state at a moment, before anything that happens then."""
    status, started, finished, last, dropped = state
    if status not in TERMINAL and last is not None and at - last >= idle_ms:
        return "error", started, last + idle_ms, last, dropped
    return state


def stopped(state: tuple, at: int) -> tuple:
    """state after its problem was stopped."""
    status, started, finished, last, dropped = state
    return ("stopped", started, at, last, dropped) if status == "streaming" else state


def advanced(state: tuple, kind: str, event: str | None, at: int) -> tuple:
    """state after one chunk of its own, which counts."""
    status, started, finished, last, dropped = state
    if kind == "event":
        if event == "start":
            status, started, finished = "streaming", at, None
        elif event in ("done", "error"):
            status, finished = event, at
        elif event == "stop":
            status, finished, dropped = "stopped", at, True
    return status, started, finished, at, dropped


#: Problems are dealt to so many groups of one state each, so that a stop of everything is as many rows, however many problems there are.
GROUPS = 512
#: In place of a table of problems: stops of everything are for each problem that has come.
KNOWN = "known"
NONE = -(1 << 62)


class SolverStates(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.models = handle.getListState("models", "problem long, model long, status string, started long, finished long, last long, dropped boolean, listed boolean")
        self.texts = handle.getListState("texts", "problem long, model long, text string")

    def _known(self) -> tuple[dict[int, dict[int, tuple]], dict[int, bool]]:
        """States by problem and model, and whether stops of everything are for a problem; of a model's rows the last one counts."""
        known, listed, self.held = {}, {}, 0
        if self.models.exists():
            none = lambda x: None if x == NONE else int(x)
            for problem, model, status, started, finished, last, dropped, own in self.models.get():
                known.setdefault(int(problem), {})[int(model)] = (status, none(started), none(finished), none(last), bool(dropped))
                listed[int(problem)] = bool(own)
                self.held += 1
        return known, listed

    def _keep(self, known: dict[int, dict[int, tuple]], listed: dict[int, bool], touched: set[tuple[int, int]]) -> None:
        """Append what was touched, or write all anew once over half of the rows no longer count."""
        whole = self.held + len(touched) > 2 * sum(map(len, known.values())) + 100
        keys = ((p, m) for p, own in known.items() for m in own) if whole else sorted(touched)
        some = lambda x: NONE if x is None else x
        rows = [(p, m, s[0], some(s[1]), some(s[2]), some(s[3]), s[4], listed[p]) for p, m in keys for s in (known[p][m],)]
        if rows:
            (self.models.put if whole else self.models.appendList)(rows)

    def _timer(self, known: dict[int, dict[int, tuple]]) -> None:
        """One timer a group, at the first moment at which one of its models may be idle too long."""
        due = min((s[3] + self.idle_ms for own in known.values() for s in own.values() if s[0] not in TERMINAL and s[3] is not None), default=None)
        there = list(self.handle.listTimers())
        for at in there:
            if at != due:
                self.handle.deleteTimer(at)
        if due is not None and due not in there:
            self.handle.registerTimer(due)

    def _rows(self, known: dict[int, dict[int, tuple]], touched: set[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        if not touched:
            return
        ended, texts = {(p, m) for p, m in touched if known[p][m][0] in TERMINAL}, {}
        if ended and self.texts.exists():
            for problem, model, piece in self.texts.get():
                if (problem, model) in ended:
                    texts.setdefault((int(problem), int(model)), []).append(piece)
        rows = [(p, m, *known[p][m][:3], "".join(texts.get((p, m), ())) if (p, m) in ended else None) for p, m in sorted(touched)]
        yield pd.DataFrame(rows, columns=["problem", "model", "status", "started", "finished", "text"]).astype({"started": "Int64", "finished": "Int64"})

    def _expire(self, states: dict[int, tuple], at: int) -> None:
        states.update({m: expired(s, at, self.idle_ms) for m, s in states.items() if s[0] not in TERMINAL})

    def _stop(self, states: dict[int, tuple], at: int) -> None:
        states.update({m: stopped(expired(s, at, self.idle_ms), at) for m, s in states.items() if s[0] not in TERMINAL})

    def _between(self, states: dict[int, tuple], stops: list[int]) -> None:
        """Stops of everything with no chunk of the problem between them: the first one stops what is streaming, which leaves the others
        nothing but models to find idle, and the last one finds all of those.
        """
        if stops and states:
            self._stop(states, stops[0])
            self._expire(states, stops[-1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, listed = self._known()
        before, was, pieces = {p: dict(own) for p, own in known.items()}, dict(listed), []
        frame = pd.concat(list(rows)).sort_values(["at", "seq"], ignore_index=True)
        stops = frame.loc[frame["every"], "at"]
        own, ats = frame[~frame["every"]], stops.tolist()
        # How many stops of everything come before each chunk.
        own = own.assign(after=stops.index.searchsorted(own.index)).sort_values("problem", kind="stable")
        listed |= dict(zip(own["problem"].tolist(), own["listed"].tolist(), strict=True))
        names = ["problem", "model", "wide", "kind", "event", "text", "at", "after"]
        problem, states, seen, last = None, {}, 0, 0

        def finish() -> None:
            self._expire(states, last)
            if problem is not None and listed[problem]:
                self._between(states, ats[seen:])

        for p, model, wide, kind, event, text, at, after in zip(*(own[c].tolist() for c in names), strict=True):
            if p != problem:
                finish()
                problem, states, seen = p, known.setdefault(p, {}), 0
            if after > seen:
                if listed[p]:
                    self._between(states, ats[seen:after])
                seen = after
            last = at
            if wide:
                if kind == "event" and event == "stop":
                    self._stop(states, at)
                continue
            now = expired(states.get(model, NEW), at, self.idle_ms)
            if now[4]:
                continue
            states[model] = advanced(now, kind, event, at)
            if kind == "text" and text:
                pieces.append((p, model, text))
        finish()
        came = set(own["problem"].tolist())
        for p, states in known.items() if ats else ():
            if p not in came and listed[p]:
                self._between(states, ats)
        if pieces:
            self.texts.appendList(pieces)
        changed = {(p, m) for p, states in known.items() for m, s in states.items() if before.get(p, {}).get(m) != s} | {piece[:2] for piece in pieces}
        self._keep(known, listed, changed | {(p, m) for p in came if was.get(p) != listed[p] for m in known[p]})
        self._timer(known)
        yield from self._rows(known, changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, listed = self._known()
        before, at = {p: dict(own) for p, own in known.items()}, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for states in known.values():
            self._expire(states, at)
        changed = {(p, m) for p, states in known.items() for m, s in states.items() if before[p][m] != s}
        self._keep(known, listed, changed)
        self._timer(known)
        yield from self._rows(known, changed)

    def close(self) -> None:
        pass


def grouped(chunks: DataFrame, problems: DataFrame | str | None = None) -> DataFrame:
    """chunks with the group of their problem; a stop of everything is one row a group, or none without problems. Whether such stops are
    for a problem (listed) is asked of the table when a chunk of the problem comes.
    """
    # A stop of everything is `every`, a chunk without a model `wide`; their keys are 0, as no column may hold nulls.
    every = (F.col("kind") == "event") & (F.col("event") == "stop") & F.col("problem").isNull()
    rows = chunks.withColumn("every", F.coalesce(every, F.lit(False)) & F.lit(problems is not None)).where("every or problem is not null")
    if isinstance(problems, DataFrame):
        rows = rows.join(problems.select("problem").distinct().withColumn("listed", F.lit(True)), "problem", "left")
    else:
        rows = rows.withColumn("listed", F.lit(problems == KNOWN))
    group = F.when(F.col("every"), F.sequence(F.lit(0), F.lit(GROUPS - 1))).otherwise(F.array(F.pmod(F.xxhash64("problem"), F.lit(GROUPS)).cast("int")))
    key = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select(F.explode(group).alias("bucket"), key("problem"), key("model"), F.col("model").isNull().alias("wide"), "every", F.coalesce("listed", F.lit(False)).alias("listed"), "seq", "kind", "event", "text", "at", "time")


def states(chunks: DataFrame, idle_ms: int, delay: str, problems: DataFrame | str | None = None) -> DataFrame:
    """A streaming frame (problem, model, status, started, finished, text) of the models that changed; text only of those that have ended."""
    rows = grouped(chunks.withWatermark("time", delay), problems)
    return rows.groupBy("bucket").transformWithStateInPandas(SolverStates(idle_ms), OUT, "Update", "EventTime")


def go_on(chunks: DataFrame, out: str, idle_ms: int, delay: str, problems: DataFrame | str | None = None) -> None:
    """Take in all that is there now; called again with the same out, what has come since. Each trigger writes its rows under its
    own number, so a trigger that is repeated writes the same rows in the same place.
    """
    spark, key = chunks.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        write = lambda df, n: df.withColumn("trigger", F.lit(n)).write.mode("overwrite").parquet(f"{out}/data/batch={n}")
        query = states(chunks, idle_ms, delay, problems).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, was)


def run(chunks: DataFrame, folder: str, idle_ms: int, delay: str, problems: DataFrame | str | None = None) -> DataFrame:
    """The latest state of each model after all that is there now."""
    out = f"{folder}/solver-states-{uuid.uuid4().hex}"
    go_on(chunks, out, idle_ms, delay, problems)
    return latest(chunks.sparkSession, f"{out}/data")


def latest(spark: SparkSession, path: str) -> DataFrame:
    held = f"{OUT}, trigger long, batch int"
    rows = spark.read.schema(held).parquet(path) if exists(spark, path) else spark.createDataFrame([], held)
    return rows.groupBy("problem", "model").agg(F.max_by(F.struct("status", "started", "finished", "text"), "trigger").alias("s")).select("problem", "model", "s.*")
