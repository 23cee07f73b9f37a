"""The drawing of a problem's solutions as a layered graph: problem, models, strategies, steps, answers, and each model's way through them.

Models are numbered by their solver's number within the problem. A cluster of steps stands at the height of its mean step; clusters that
models share take turns in the slots of a band about the middle, clusters of one model stand at that model's side. Depth 1
shows no steps, depth 2 a node a cluster, depth 3 a node a step around its cluster's place. Coordinates are doubles, with the jitter that
a node's key hashes to. All windows are within a problem.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Places and sizes of the nodes, in the drawing's units, and the models' colours.
CARD, GAP, SIDE, LEAST_WIDTH, PROBLEM_WIDTH = 176, 16, 34, 980, 320
PROBLEM_Y, PROBLEM_HEIGHT, MODEL_Y, MODEL_HEIGHT = 36, 96, 186, 104
STRATEGY_Y, STRATEGY_HEIGHT, STRATEGY_JITTER_X, STRATEGY_JITTER_Y = 330, 84, 28, 18
ANSWER_BELOW, ANSWER_WIDTH, ANSWER_GAP, ANSWER_HEIGHT, ANSWER_LEFT = 170, 246, 24, 118, 24
EMPTY = "(empty)"


class Level(NamedTuple):
    """How clusters stand at a depth; fixed values."""

    seed: str
    top: int
    gap: int
    slots: tuple[int, ...]
    band_x: int
    band_y: int
    jitter_y: int
    jitter_shared: int
    jitter_solo: int
    solo: int
    solo_step: int
    row: int
    height: int
    by_stage: bool


LEVELS = {
    2: Level("title", 468, 142, (-220, -80, 80, 220), 36, 24, 40, 54, 96, 330, 82, 34, 82, False),
    3: Level("detail", 498, 176, (-250, -90, 90, 250), 40, 34, 42, 66, 128, 430, 95, 58, 118, True),
}
STEP_WIDTH = 236
#: Gaps between a cluster's steps, across and down: where it is shared, and where it is not.
SPREAD = {True: (42, 30), False: (16, 18)}


def numbered(results: DataFrame) -> DataFrame:
    """results with no (0, 1, ..), n (models of the problem), flow (the drawing's width) and centre."""
    every = Window.partitionBy("problem")
    out = results.withColumns({"no": (F.row_number().over(every.orderBy("solver")) - 1).cast("long"), "n": F.count(F.lit(1)).over(every)})
    flow = F.greatest(F.lit(LEAST_WIDTH), 2 * SIDE + F.col("n") * CARD + F.greatest(F.lit(0), F.col("n") - 1) * GAP)
    return out.withColumns({"flow": flow, "centre": flow / 2})


def placed(clusters: DataFrame, models: DataFrame, depth: int) -> DataFrame:
    """clusters (problem, key, place, shared, members, mean_idx) with x and y. members: array of (solver, idx), the owner's first."""
    level = LEVELS[depth]
    owner = models.select("problem", F.col("solver").alias("owner"), "no", "n", "centre")
    rows = clusters.withColumns({"owner": F.col("members")[0]["solver"], "stage": F.floor(F.col("mean_idx") + 0.5)}).join(owner, ["problem", "owner"])
    by = lambda *cols: (F.row_number().over(Window.partitionBy("problem", "shared", *cols).orderBy("place")) - 1).cast("long")
    row, solo_row = by("stage"), by("owner", "stage") if level.by_stage else by("owner")
    rows = rows.withColumns({"row": row, "solo_row": solo_row})
    shake = lambda what, amount: T.jitter(F.concat(F.lit(f"{level.seed}-{what}-"), F.col("key")), float(amount))
    count, mid = len(level.slots), (F.col("n") - 1) / 2
    slot, band = F.element_at(F.array(*map(F.lit, level.slots)), (F.col("row") % count + 1).cast("int")), F.floor(F.col("row") / count)
    side = F.when(F.col("no") <= mid, -1).otherwise(1)
    shared_x = F.col("centre") + slot + band * level.band_x + shake("shared-x", level.jitter_shared)
    solo_x = F.col("centre") + side * (level.solo + F.abs(F.col("no") - mid) * level.solo_step) + shake("solo-x", level.jitter_solo)
    y = level.top + F.col("stage") * level.gap + shake("y", level.jitter_y) + F.when(F.col("shared"), band * level.band_y).otherwise(F.col("solo_row") * level.row)
    return rows.withColumns({"x": F.when(F.col("shared"), shared_x).otherwise(solo_x), "y": y}).drop("owner", "stage", "no", "n", "centre", "row", "solo_row")


def _node(node: Column, kind: str, x: Column, y: Column, width: int, height: int, shared: Column | None = None) -> list[Column]:
    return [node.alias("node"), F.lit(kind).alias("kind"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(width).alias("width"), F.lit(height).alias("height"), (F.lit(False) if shared is None else shared).alias("shared")]


def drawn(results: DataFrame, clusters: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes (problem, node, kind, x, y, width, height, shared), edges (problem, model, at, from_node, to_node)) of results (problem, solver,
    model, answer) and their clusters. at numbers a model's edges.
    """
    models = numbered(results)
    card = F.lit(SIDE) + F.col("no") * (CARD + GAP)
    named = lambda what: F.concat(F.lit(f"{what}-"), F.col("model"))
    nodes = models.where("no = 0").select("problem", *_node(F.lit("problem"), "problem", (F.col("flow") - PROBLEM_WIDTH) / 2, F.lit(PROBLEM_Y), PROBLEM_WIDTH, PROBLEM_HEIGHT))
    nodes = nodes.unionByName(models.select("problem", *_node(named("model"), "model", card, F.lit(MODEL_Y), CARD, MODEL_HEIGHT)))
    if depth >= 2:
        x, y = card + T.jitter(named("strategy"), float(STRATEGY_JITTER_X)), STRATEGY_Y + T.jitter(named("strategy-y"), float(STRATEGY_JITTER_Y))
        nodes = nodes.unionByName(models.select("problem", *_node(named("strategy"), "strategy", x, y, CARD, STRATEGY_HEIGHT)))
    # A model's way: (order, node) from the problem to its last step.
    way = models.select("problem", "solver", "model", F.explode(F.array(*(F.struct(F.lit(k - 9).cast("long").alias("at"), n.alias("node")) for k, n in enumerate((F.lit("problem"), named("model"), *([named("strategy")] if depth >= 2 else [])))))).alias("w")).select("problem", "solver", "model", "w.*")
    if depth >= 2:
        stood, level = placed(clusters, models, depth), LEVELS[depth]
        each = stood.select("problem", "key", "shared", "x", "y", F.size("members").alias("count"), F.posexplode("members").alias("pos", "m")).select("*", "m.solver", "m.idx").join(models.select("problem", "solver", "model"), ["problem", "solver"])
        if depth == 2:
            step = F.concat(F.lit("cluster-title-"), F.translate("key", ":", "-"))
            nodes = nodes.unionByName(stood.select("problem", *_node(step, "step", F.col("x"), F.col("y"), STEP_WIDTH, level.height, F.col("shared"))))
        else:
            step = F.concat_ws("-", F.lit("step"), "model", F.col("idx").cast("string"))
            cols = F.ceil(F.sqrt("count"))
            rows, at = F.ceil(F.col("count") / cols), F.col("pos")
            gap = lambda i: F.when(F.col("shared"), SPREAD[True][i]).otherwise(SPREAD[False][i])
            x, y = F.col("x") + (at % cols - (cols - 1) / 2) * gap(0), F.col("y") + (F.floor(at / cols) - (rows - 1) / 2) * gap(1)
            nodes = nodes.unionByName(each.select("problem", *_node(step, "step", x, y, STEP_WIDTH, level.height, F.col("shared"))))
        way = way.unionByName(each.select("problem", "solver", "model", F.col("idx").cast("long").alias("at"), step.alias("node")))
    # Answers stand below the lowest node, in order of the models that give them first.
    key = F.coalesce(F.nullif(T.normalize_answer(F.coalesce("answer", F.lit(""))), F.lit("")), F.lit(EMPTY))
    given = models.withColumn("key", key)
    groups = given.groupBy("problem", "key").agg(F.min("no").alias("first"), F.first("flow").alias("flow"))
    every = Window.partitionBy("problem")
    groups = groups.withColumns({"i": F.row_number().over(every.orderBy("first")) - 1, "g": F.count(F.lit(1)).over(every)})
    low = nodes.groupBy("problem").agg(F.max(F.col("y") + F.col("height")).alias("low"))
    left = F.greatest(F.lit(ANSWER_LEFT), (F.col("flow") - F.col("g") * ANSWER_WIDTH - (F.col("g") - 1) * ANSWER_GAP) / 2)
    answer = F.concat(F.lit("answer-"), F.col("key"))
    nodes = nodes.unionByName(groups.join(low, "problem").select("problem", *_node(answer, "answer", left + F.col("i") * (ANSWER_WIDTH + ANSWER_GAP), F.col("low") + ANSWER_BELOW, ANSWER_WIDTH, ANSWER_HEIGHT)))
    way = way.unionByName(given.select("problem", "solver", "model", F.lit(1 << 40).alias("at"), answer.alias("node")))
    w = Window.partitionBy("problem", "model").orderBy("at", "node")
    edges = way.select("problem", "model", F.lag("node").over(w).alias("from_node"), F.col("node").alias("to_node"), (F.row_number().over(w) - 2).cast("long").alias("at"))
    return nodes, edges.where("at >= 0")
