"""Uploads to the known page that looks most alike, over an index of pivots.

The mean absolute difference of two thumbnails is a metric, so the difference of their distances to any pivot is at most
their own distance. Known pages fall into bands twice as wide as the largest limit, by their distances to the first four
pivots, and into bands of their shape; an upload meets only the pages of the bands that its limits touch, two of a kind. All
pivots, the shapes and at last the thumbnails themselves are compared for what is left. Equal looks are compared
once, whatever number of uploads or pages has them.

Pivots come from at most `SAMPLE` known pages; which ones decides how many pairs are compared, never which are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import mean_abs_diff

# The largest difference for pages of one size and of one shape, and how far shapes may differ.
SAME_SIZE, RESIZED, SHAPE = 0.35, 0.20, 0.005
PIVOTS, SAMPLE, BANDED = 6, 64, 4
#: Above the rounding errors of a mean of absolute differences of bytes.
SLACK = 1e-6
WIDE = SAME_SIZE + SLACK


def aspect(width: str = "width", height: str = "height") -> Column:
    return F.col(width) / F.greatest(F.col(height), F.lit(1))


def pivots(known: DataFrame) -> list[list[float]]:
    """Thumbnails far from one another, picked one by one among SAMPLE looks of the known pages."""
    held = known.select("thumb").where(F.size("thumb") > 0).distinct().orderBy(F.xxhash64("thumb"), "thumb").limit(SAMPLE).collect()
    most = max((len(r.thumb) for r in held), default=0)
    looks = np.array([r.thumb for r in held if len(r.thumb) == most], np.float64)
    if not len(looks):
        return []
    far, chosen = np.full(len(looks), np.inf), [0]
    while len(chosen) < min(PIVOTS, len(looks)):
        far = np.minimum(far, np.abs(looks - looks[chosen[-1]]).mean(axis=1))
        chosen.append(int(far.argmax()))
    return looks[chosen].tolist()


def with_distances(looks: DataFrame, found: list[list[float]]) -> DataFrame:
    """looks with `away`: the distance to each pivot, cut or filled with zeros to the thumbnail's length."""
    fixed = np.array(found or [[0.0]], np.float64)

    @F.pandas_udf("array<double>")
    def away(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for thumbs in frames:
            out = []
            for t in thumbs:
                own = np.zeros(fixed.shape[1])
                n = min(len(t), len(own))
                own[:n] = np.asarray(t[:n], np.float64)
                out.append(np.abs(fixed[:, :n] - own[:n]).mean(axis=1) if n else np.zeros(len(fixed)))
            yield pd.Series(out)

    return looks.withColumn("away", away("thumb"))


#: By thumbnails' length, bands of shape and of the distances to the first pivots.
CELLS = ["long", "shape", *(f"near{i}" for i in range(BANDED))]


def _measured(looks: DataFrame, found: list[list[float]]) -> tuple[DataFrame, dict[str, tuple[Column, float]]]:
    """looks with their distances, and for each kind of band its measure and how far two looks that are alike may differ in it."""
    near = {f"near{i}": (F.coalesce(F.get("away", i), F.lit(0.0)), WIDE) for i in range(BANDED)}
    return with_distances(looks, found).withColumn("long", F.size("thumb")), {"shape": (aspect(), SHAPE + SLACK), **near}


def compared(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """(look, page_id, same_size): the pairs of looks that the index leaves to be compared. Both sides: looks of looks_of()."""
    return _left(met(uploads, known))


def met(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads beside the known looks of their bands. A band is twice as wide as looks may differ, so what is near a look lies in the bands of
    its measure less and plus that width, two at most.
    """
    found = pivots(known)
    asked, measures = _measured(uploads, found)
    theirs, _ = _measured(known, found)
    for name, (value, wide) in measures.items():
        band = lambda v, w=wide: F.floor(v / (2 * w)).cast("long")
        asked = asked.withColumn(name, F.explode(F.array_distinct(F.array(band(value - wide), band(value + wide)))))
        theirs = theirs.withColumn(name, band(value))
    held = theirs.select(*CELLS, F.col("look").alias("page_id"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("away").alias("away_"))
    return asked.drop("thumb").join(held, CELLS)


def _left(pairs: DataFrame) -> DataFrame:
    same = (F.col("width") == F.col("w")) & (F.col("height") == F.col("h"))
    limit = F.when(same, SAME_SIZE).otherwise(RESIZED) + SLACK
    apart = F.aggregate(F.zip_with("away", "away_", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda m, x: F.greatest(m, x))
    alike = same | (F.abs(aspect() - aspect("w", "h")) <= SHAPE)
    return pairs.where(alike & (apart <= limit)).select("look", "page_id", same.alias("same_size"))


def looks_of(pages: DataFrame, name: str) -> DataFrame:
    """(look, width, height, thumb): each look once, named by the least of its pages."""
    return pages.groupBy("width", "height", "thumb").agg(F.min(name).alias("look"))


def nearest_pages(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """(id, page_id, off, same_size) of uploads (id, width, height, thumb) that look like a known page (page_id, width,
    height, thumb): the page of the least difference, the first of equals. Pages of one size may differ by SAME_SIZE, others must
    have nearly one shape and may differ by RESIZED. Thumbnails of different lengths, empty ones and nulls are alike to none.
    """
    whole = "width is not null and height is not null and size(thumb) > 0"
    mine, theirs = looks_of(uploads.where(whole), "id"), looks_of(known.where(whole), "page_id")
    pairs = compared(mine, theirs)
    shown = pairs.join(mine.select("look", "thumb"), "look").join(theirs.select(F.col("look").alias("page_id"), F.col("thumb").alias("other")), "page_id")
    off = shown.withColumn("off", mean_abs_diff(F.col("thumb"), F.col("other"))).where(F.col("off") <= F.when(F.col("same_size"), SAME_SIZE).otherwise(RESIZED))
    best = off.groupBy("look").agg(F.min(F.struct("off", "page_id", "same_size")).alias("best"))
    named = mine.join(best, "look").select("width", "height", "thumb", "best")
    return uploads.join(named, ["width", "height", "thumb"]).select("id", F.col("best.page_id").alias("page_id"), F.col("best.off").alias("off"), F.col("best.same_size").alias("same_size"))
