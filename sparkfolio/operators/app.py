"""Caches, selections and drawings of the viewer, as tables: cache keys and hits, dataset pages, formula segments, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import natural_key

# Places of the step drawing, in its own units.
COLUMN_GAP, ROW_GAP, MARGIN = 260, 120, 60
# The groups of dataset pages in their order, the one whose years go backwards, and what stands in for a missing year or page.
GROUPS, DESCENDING = ("csat", "sat"), "csat"
NO_YEAR, NO_PAGE = {"csat": "2025", "sat": "8"}, "001"


def solve_key(problem: Column, modality: Column, group: Column, year: Column, page: Column, uploaded: Column) -> Column:
    """Key of a solved problem: its dataset page where it has one, else the time of its upload."""
    place = F.when(group.isNotNull() & year.isNotNull() & page.isNotNull(), F.concat_ws("_", group, year, page)).otherwise(F.coalesce(uploaded.cast("string"), F.lit("none")))
    return F.concat_ws("_", problem, modality, place)


def usable(cache: DataFrame) -> DataFrame:
    """Cache entries with results and groups; of several with a key the last written."""
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("written"), F.desc("entry")))
    return cache.withColumn("rank", last).where("rank = 1 and n_results > 0 and has_groups").drop("rank")


def split_by_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that the cache answers, and those that must run."""
    good = usable(cache).select("key")
    return requests.join(good, "key", "left_semi"), requests.join(good, "key", "left_anti")


def latest_texts(files: DataFrame) -> DataFrame:
    """files (key, modified, path, text): the newest of a key; of equally new ones the last by path."""
    return files.groupBy("key").agg(F.max_by("text", F.struct("modified", "path")).alias("text"))


def dataset_pages(index: DataFrame) -> DataFrame:
    """index (groups map<group, map<year, map<page, struct<json, image>>>>) -> (grp, year, page, json, image), entries without image left out."""
    g = index.select(F.explode("groups").alias("grp", "years")).select("grp", F.explode("years").alias("year", "pages")).select("grp", "year", F.explode("pages").alias("page", "own"))
    return g.where("own.image <> ''").select("grp", "year", "page", "own.json", "own.image")


def selected(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each request (id, grp, year, page) the page meant, from pages (grp, year, page): group, year and page are each what is asked
    for if it is there, else the first one; where there is none at all, a constant. Every request gives a row.

    Years and pages are ordered by their numbers; the newest year comes first in the group DESCENDING. A request for the year
    `sat` names test and page as `<test>_<page>`.
    """
    there = pages.where(F.col("grp").isin(*GROUPS)).select("grp", "year", "page").distinct()
    held = {r.grp for r in there.select("grp").distinct().collect()}  # two at most
    first_group = next((g for g in GROUPS if g in held), None)
    group = F.when(F.col("grp").isin(*held), F.col("grp")).otherwise(F.lit(first_group)) if held else F.coalesce("grp", F.lit(GROUPS[0]))
    # Defaults are made before the joins: one row a year and one a group, so no request meets all pages of its group.
    place = lambda c: F.struct(*(x.alias(f"k{i}") for i, x in enumerate(natural_key(F.lower(F.col(c))))), F.col(c).alias("own"))
    firsts = there.groupBy("grp", "year").agg(F.min(place("page"))["own"].alias("first"))
    ends = firsts.groupBy("grp").agg(F.min(place("year"))["own"].alias("low"), F.max(place("year"))["own"].alias("high"))
    default = ends.select("grp", F.when(F.col("grp") == DESCENDING, F.col("high")).otherwise(F.col("low")).alias("default"))

    old = (F.col("grp") == "sat") & (F.col("year") == "sat") & F.contains("page", F.lit("_"))
    asked = wanted.select("id", group.alias("grp"), "year", "page").withColumns({"year": F.when(old, F.substring_index("page", "_", 1)).otherwise(F.col("year")), "page": F.when(old, F.regexp_extract("page", "^[^_]*_(.*)$", 1)).otherwise(F.col("page"))})
    known = asked.join(firsts.drop("first").withColumn("known", F.lit(True)), ["grp", "year"], "left").join(default, "grp", "left")
    year = F.when(F.col("known"), F.col("year")).otherwise(F.coalesce("default", F.when(F.col("grp") == "sat", NO_YEAR["sat"]).otherwise(NO_YEAR["csat"])))
    dated = known.select("id", "grp", year.alias("year"), "page")
    rows = dated.join(firsts, ["grp", "year"], "left").join(there.withColumn("hit", F.lit(True)), ["grp", "year", "page"], "left")
    return rows.select("id", "grp", "year", F.when(F.col("hit"), F.col("page")).otherwise(F.coalesce("first", F.lit(NO_PAGE))).alias("page"))


def math_segments(text: Column) -> Column:
    """array<struct<kind, body>> of text, display formulas and inline formulas, in order."""
    rule = r"(?s)\\\[(.+?)\\\]|\$\$(.+?)\$\$|\\\((.+?)\\\)|\$([^$]+?)\$"
    mark = lambda kind, k: f"\u0001{kind}${k}\u0001"
    # Each formula is fenced by marks that name its kind; groups that did not match are empty.
    fenced = F.regexp_replace(text, rule, mark("D", "1$2") + mark("I", "3$4"))
    parts = F.split(fenced, "\u0001")
    typed = F.transform(parts, lambda p, i: F.struct(F.when(i % 4 == 1, "display").when(i % 4 == 3, "inline").otherwise("text").alias("kind"), F.when(i % 2 == 1, F.substring(p, F.lit(2), F.length(p))).otherwise(p).alias("body")))
    return F.filter(typed, lambda s: s["body"] != "")


def drawn(members: DataFrame) -> DataFrame:
    """members (problem, component, solver, idx) -> nodes (problem, component, stage, row_no, x, y): a component's stage is its mean
    step, halves up; nodes of a stage stand below each other in order of their mean solver.
    """
    node = members.groupBy("problem", "component").agg(F.floor(F.avg("idx") + 0.5).cast("long").alias("stage"), F.avg("solver").alias("mean_solver"))
    row = F.row_number().over(Window.partitionBy("problem", "stage").orderBy("mean_solver", "component"))
    placed = node.withColumn("row_no", (row - 1).cast("long"))
    return placed.select("problem", "component", "stage", "row_no", (F.col("stage") * COLUMN_GAP + MARGIN).alias("x"), (F.col("row_no") * ROW_GAP + MARGIN).alias("y"))


def chains(members: DataFrame) -> DataFrame:
    """Edges (problem, solver, from_component, to_component) along each solver's steps; the first comes from null, the drawing's start."""
    w = Window.partitionBy("problem", "solver").orderBy("idx")
    return members.select("problem", "solver", F.lag("component").over(w).alias("from_component"), F.col("component").alias("to_component"))


def upload_size(width: Column, height: Column, bytes_: Column, most: int = 8 * 1024 * 1024, edge: int = 4200) -> Column:
    """struct(width, height): small files as they are, others scaled to a long edge of at most `edge`."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height))
    new = lambda v: F.when(bytes_ < most, v).otherwise(F.floor(v * scale + 0.5)).cast("long")
    return F.struct(new(width).alias("width"), new(height).alias("height"))
