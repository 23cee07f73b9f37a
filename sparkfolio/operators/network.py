"""Step networks, votes, timings: what is read off the solvers' steps and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def step_flows(steps: DataFrame) -> DataFrame:
    """Edges between a solver's consecutive steps, in list order."""
    w = Window.partitionBy("problem", "solver").orderBy("idx")
    return steps.select("problem", "solver", F.col("idx").alias("from_step"), F.lead("idx").over(w).alias("to_step")).where("to_step is not null")


def group_refs(refs: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group references (problem, group_no, solver, idx) joined with steps; and those that name no step."""
    on = ["problem", "solver", "idx"]
    return refs.join(steps, on), refs.join(steps, on, "left_anti")


def shared_layers(steps: DataFrame) -> DataFrame:
    """(problem, idx, solvers, shared, mean_solver): the solvers that have a step at a place."""
    g = steps.groupBy("problem", "idx").agg(F.countDistinct("solver").alias("solvers"), F.floor(F.avg("solver") * 1000 + 0.5).cast("long").alias("mean_solver_milli"))
    return g.withColumn("shared", F.col("solvers") >= 2)


def group_transitions(cells: DataFrame) -> DataFrame:
    """cells (model, grp, n): edges between consecutive groups a model appears in. Groups are rows in order of name."""
    rows = cells.select("grp").distinct().withColumn("row_no", F.dense_rank().over(Window.orderBy("grp")).cast("long"))
    placed = cells.join(rows, "grp")
    w = Window.partitionBy("model").orderBy("row_no")
    return placed.select("model", F.col("row_no").alias("from_row"), F.lead("row_no").over(w).alias("to_row")).where("to_row is not null").groupBy("from_row", "to_row").agg(F.count(F.lit(1)).alias("models"))


def row_offsets(cells: DataFrame, unit: int = 24, pad: int = 10) -> DataFrame:
    """(grp, height, top): a group's height is that of its fullest cell; tops add up heights and paddings above. One row a group."""
    rows = cells.groupBy("grp").agg((F.greatest(F.max("n"), F.lit(1)) * unit).alias("height"))
    above = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("top", F.coalesce(F.sum(F.col("height") + pad).over(above), F.lit(0)))


def answer_votes(answers: DataFrame) -> DataFrame:
    """answers (problem, solver, answer) -> (problem, answer_key, shown, votes, place): groups of equal answers, largest first.

    shown is the first solver's own wording; empty answers and dashes do not vote.
    """
    key = T.normalize_answer(F.col("answer"))
    kept = answers.where(F.col("answer").isNotNull() & ~F.trim("answer").isin("", "-", "—")).withColumn("answer_key", key)
    groups = kept.groupBy("problem", "answer_key").agg(F.min_by("answer", "solver").alias("shown"), F.count(F.lit(1)).alias("votes"), F.min("solver").alias("first"))
    place = F.row_number().over(Window.partitionBy("problem").orderBy(F.desc("votes"), "first"))
    return groups.withColumn("place", place.cast("long")).select("problem", "answer_key", "shown", "votes", "place")


def agreement(answers: DataFrame) -> DataFrame:
    """(problem, n_answers, n_agree, unanimous): solvers whose answer equals the most frequent one."""
    top = answer_votes(answers).where("place = 1").select("problem", "answer_key")
    rows = answers.join(top, "problem").withColumn("agrees", (T.normalize_answer(F.col("answer")) == F.col("answer_key")).cast("int"))
    out = rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n_answers"), F.sum("agrees").alias("n_agree"))
    return out.withColumn("unanimous", F.col("n_answers") == F.col("n_agree"))


def colour_index(rows: DataFrame, key: str, value: str, colours: int = 5) -> DataFrame:
    w = Window.partitionBy(key).orderBy(value)
    return rows.select(key, value).distinct().withColumn("colour", (F.dense_rank().over(w) - 1).cast("long") % colours)


def latency_badges(spans: DataFrame) -> DataFrame:
    """spans (problem, model, started, finished, status; milliseconds) -> duration, badge.

    Fastest and slowest are over all models with a positive duration, badges only for those that are done.
    """
    took = F.col("finished") - F.col("started")
    rows = spans.withColumn("duration", F.when(took > 0, took))
    w = Window.partitionBy("problem")
    low, high = F.min("duration").over(w), F.max("duration").over(w)
    ratio = F.col("duration") / low
    badge = F.when((F.col("status") != "done") | F.col("duration").isNull(), None).when(ratio <= 1.05, "fastest").when(F.col("duration") >= high * 0.95, "slowest").otherwise(F.concat(F.floor(ratio * 10 + 0.5).cast("string"), F.lit("/10x")))
    return rows.select("problem", "model", "duration", badge.alias("badge"))


def problem_status(models: DataFrame) -> DataFrame:
    """models (problem, model, status) -> status of the problem: streaming if any is; when all have ended error if any failed; else idle."""
    s = F.col("status")
    ended = F.bool_and(s.isin("done", "error", "stopped"))
    return models.groupBy("problem").agg(F.when(F.bool_or(s == "streaming"), "streaming").when(ended & F.bool_or(s == "error"), "error").when(ended, "done").otherwise("idle").alias("status"))


def template_match(texts: DataFrame, templates: DataFrame, least: int = 2) -> DataFrame:
    """texts (id, body) and templates (title, keywords): the title with the most keyword hits, the first of equals, if `least` at least.

    templates is a small fixed table and is broadcast.
    """
    body = T.normalize_for_match(F.col("body"))
    hits = F.size(F.filter("keywords", lambda k: (T.normalize_for_match(k) != "") & F.col("norm").contains(T.normalize_for_match(k))))
    pairs = texts.withColumn("norm", body).join(F.broadcast(templates), hits >= least).withColumn("hits", hits)
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("hits"), "place"))
    return pairs.withColumn("rank", best).where("rank = 1").select("id", "title", F.col("hits").cast("long").alias("hits"))
