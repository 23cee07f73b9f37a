"""Mixing by iterative proportional fitting (native: DataFrame operations only).

Documents fall into cells (source, language, topic) whose mass is their tokens. Raking scales the cells' weights
until the sums over each of the three equal its target shares; what a cell gained or lost is its ratio. A document is
sampled with probability min(1, scale * ratio of its cell), the scale being such that the expected tokens are
`fraction` of all; where a probability is capped, `weight` makes up for it, so that the weighted sample meets
the targets. Whether a document is drawn depends on its doc_id and the seed alone.

Tokens are runs of other characters than white space. The topic is an expression over the text; by default it tells
tables, markup, notes (under 600 characters), long reads (over 8000) and prose apart. Targets default to each value's
share to the power TEMPER, normalised, which raises what is rare.

Defined cases: a null source or language is the value "" of its own; null and empty texts have no tokens and take
their cell's ratio, or 1 where the whole cell has none; a target without any tokens is left out and the others
scaled; equal doc_ids (null among them) are drawn alike; a very
long text only adds its number of tokens; other columns are not read; an empty table gives an empty
result. The table of cells stays distributed and is broadcast only under the planner's own size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, text_or_empty, unused

FRACTION, TEMPER, ROUNDS, CLOSE, SEED = 0.8, 0.7, 25, 1e-6, 17
SIDES = ("source", "lang", "topic")


def default_topic(text: Column) -> Column:
    n = F.length(text)
    mark = text.contains("###") | text.contains("$$$") | text.contains("%%%")
    return F.when(text.contains(" | "), "table").when(mark, "markup").when(n < 600, "note").when(n > 8000, "long read").otherwise("prose")


def featured(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens."""
    text = text_or_empty()
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    side = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select("doc_id", side("source"), side("lang"), (default_topic(text) if topic is None else topic).alias("topic"), tokens.alias("tokens"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """cells (source, lang, topic, mass) -> with `fitted`, of the same sum, and `ratio` = fitted / mass."""
    spark = cells.sparkSession
    wanted = {}
    for side in SIDES:
        sums = cells.where("mass > 0").groupBy(side).agg(F.sum("mass").alias("had"))
        if targets and side in targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[side].items()] or [("", 0.0)], f"{side} string, share double")
            sums = sums.join(given, side, "left").select(side, F.coalesce("share", F.lit(0.0)).alias("share"), "had")
        else:
            sums = sums.select(side, F.pow("had", F.lit(temper)).alias("share"), "had")
        sums = stored(sums, f"sums-{side}")
        shares, total = sums.agg(F.sum("share"), F.sum("had")).head()
        wanted[side] = sums.select(side, (F.col("share") * F.lit((total or 0) / (shares or 1))).alias("want"))
    now = stored(cells.withColumn("fitted", F.col("mass").cast("double")), "fit")
    for _ in range(rounds):
        new = now
        for side in SIDES:
            factor = new.groupBy(side).agg(F.sum("fitted").alias("is")).join(wanted[side], side).select(side, F.when(F.col("is") > 0, F.col("want") / F.col("is")).otherwise(1.0).alias("by"))
            new = new.join(factor, side, "left").withColumn("fitted", F.col("fitted") * F.coalesce("by", F.lit(1.0))).select(*SIDES, "mass", "fitted")
        new = stored(new, "fit")
        moved = new.alias("n").join(now.alias("o"), list(SIDES)).agg(F.max(F.abs(F.col("n.fitted") - F.col("o.fitted")) / F.greatest(F.col("o.fitted"), F.lit(1e-9)))).head()[0]
        dropped(now)
        now = new
        if moved is None or moved < close:
            break
    return now.withColumn("ratio", F.when(F.col("mass") > 0, F.col("fitted") / F.col("mass")).otherwise(1.0))


def capped_scale(ratios: DataFrame, fraction: float) -> float:
    """The scale at which sum(mass * min(1, scale * ratio)) is `fraction` of all mass."""
    total = ratios.agg(F.sum("mass")).head()[0] or 0
    scale = fraction
    for _ in range(60):
        row = ratios.agg(
            F.sum(F.when(F.col("ratio") * scale >= 1, F.col("mass")).otherwise(0)).alias("full"),
            F.sum(F.when(F.col("ratio") * scale < 1, F.col("mass") * F.col("ratio")).otherwise(0.0)).alias("rest"),
        ).head()
        if not row["rest"]:
            return scale
        new = (fraction * total - row["full"]) / row["rest"]
        if abs(new - scale) <= 1e-12 * scale:
            return new
        scale = new
    return scale


def drawn(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1) from doc_id and seed."""
    return F.xxhash64(F.lit(seed), doc_id.cast("string")).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))


def chances(features: DataFrame, targets: dict | None = None, fraction: float = FRACTION) -> DataFrame:
    """(source, lang, topic, probability, weight) of every cell."""
    cells = stored(features.groupBy(*SIDES).agg(F.sum("tokens").alias("mass")), "cells")
    ratios = stored(rake(cells, targets), "ratios")
    scale = F.col("ratio") * capped_scale(ratios, fraction)
    probability = F.least(F.lit(1.0), scale)
    return stored(ratios.select(*SIDES, probability.alias("probability"), F.when(probability > 0, scale / probability).otherwise(0.0).alias("weight")), "chances")


def mix(docs: DataFrame, targets: dict | None = None, fraction: float = FRACTION, topic: Column | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, weight, sampled for every row of docs."""
    features = stored(featured(docs, topic), "features")
    return features.join(chances(features, targets, fraction), list(SIDES)).withColumn("sampled", drawn(F.col("doc_id"), seed) < F.col("probability"))


def sampled_rows(docs: DataFrame, targets: dict | None = None, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, with their columns as they are."""
    text = text_or_empty()
    side = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = unused(docs, "_folio_")
    keyed = docs.withColumns({f"{own}source": side("source"), f"{own}lang": side("lang"), f"{own}topic": default_topic(text)})
    found = chances(featured(docs), targets, fraction).select(*(F.col(s).alias(own + s) for s in SIDES), F.col("probability").alias(f"{own}probability"))
    rows = keyed.join(found, [own + s for s in SIDES]).where(drawn(F.col("doc_id"), seed) < F.col(f"{own}probability"))
    return rows.select(*docs.columns)
