"""Sources of problems and what becomes of their questions: paths, pages, boxes, texts, detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Order in which years are run; years whose problems stay without an image; boxes of a page's four problems.
YEAR_ORDER = (2024, 2025, 2026, 2022, 2023)
YEARS_WITHOUT_IMAGES = (2022, 2026)
PLACEHOLDERS = ((100, 400, 600, 900), (100, 1100, 600, 1600), (700, 400, 1200, 900), (700, 1100, 1200, 1600))
NO_TEXT = "(텍스트 없음)"


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """candidates (id, priority, path), files (path) -> (id, path): the first path that exists; null where none does."""
    there = files.select("path").distinct().withColumn("there", F.lit(True))
    rows = candidates.join(there, "path", "left").groupBy("id").agg(F.min(F.when(F.col("there"), F.struct("priority", "path"))).alias("one"))
    return rows.select("id", F.col("one.path").alias("path"))


def page_images(files: DataFrame) -> DataFrame:
    """files (path) -> (id, path) of the page images: png files that are no crops, named by their stem."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.endswith(".png") & ~name.contains("_crop")).select(F.regexp_replace(name, r"\.png$", "").alias("id"), "path")


def selected_sources(problems: DataFrame, most: int | None = None) -> DataFrame:
    """problems (year, ord, id, content) that a run takes, and the year's turn: those without content only where the year
    is kept for its texts; at most `most` a year, in order of ord.
    """
    rows = problems.where(F.col("content").isNotNull() | F.col("year").isin(*YEARS_WITHOUT_IMAGES))
    rows = rows.withColumn("turn", F.array_position(F.array(*map(F.lit, YEAR_ORDER)), F.col("year"))).where("turn > 0")
    if most is not None:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy("ord", "id"))).where(F.col("rank") <= most).drop("rank")
    return rows


def sliced_pages(rows: DataFrame, per: int = len(PLACEHOLDERS)) -> DataFrame:
    """rows (ord, desc), ord from 0 -> (page, qid, merged_text, x1, y1, x2, y2): `per` rows a page, in boxes by place."""
    at = (F.col("ord") % per).cast("int")
    box = F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in PLACEHOLDERS]), at % len(PLACEHOLDERS) + 1)
    page = F.floor(F.col("ord") / per).cast("long") + 1
    return rows.select(page.alias("page"), (at + 1).cast("string").alias("qid"), T.trim_ws(F.coalesce("desc", F.lit(""))).alias("merged_text"), *[box[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def absent_pages(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of pages that are not stored: a stored page is never made anew."""
    return pages.join(stored.select("page").distinct(), "page", "left_anti")


def page_texts(questions: DataFrame) -> DataFrame:
    """questions (page, ord, qid, text) -> (page, texts map<qid, text>); questions without a qid go, of equal ones the last counts."""
    named = questions.where("qid is not null and qid <> ''").groupBy("page", "qid").agg(F.max_by("text", "ord").alias("text"))
    return named.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("qid", F.coalesce("text", F.lit("")).alias("text")))).alias("texts"))


def clean_text(value: Column) -> Column:
    return T.trim_ws(F.regexp_replace(F.coalesce(value, F.lit("")), r"\r\n?", "\n"))


def parsed_box(value: Column) -> Column:
    """array<int> of a box written as JSON: exactly four numbers (strings of numbers too), without their fractions; else null."""
    parts = F.transform(F.from_json(value, "array<string>"), lambda x: x.try_cast("double").cast("int"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda x: x.isNull()), parts)


def detections(questions: DataFrame, texts: DataFrame | None = None, demo: bool = False) -> DataFrame:
    """questions (page, pos, width, height, qid, bbox, detection_id, label, merged_text, postcorrection_text, text_source,
    crop_b64) -> (page, pos, id, x, y, w, h, label, text, crop_url): boxes as shares of the page.

    A corrected text comes first, then the stored text (texts of page_texts()) of that place, then the merged one. The id
    is the question's own one, or in demo mode the page's name and its number, or its number.
    """
    own = F.coalesce(F.nullif("postcorrection_text", F.lit("")), F.nullif("merged_text", F.lit("")), F.lit(""))
    text = own
    if texts is not None:
        questions = questions.join(texts.select("page", "texts"), "page", "left")
        stored = F.try_element_at("texts", (F.col("pos") + 1).cast("string"))
        corrected = (F.coalesce("postcorrection_text", F.lit("")) != "") | (F.coalesce("text_source", F.lit("")) == "postcorrection")
        text = F.when(~corrected & stored.isNotNull(), stored).otherwise(own)
    qid, page = F.coalesce(F.col("qid").cast("string"), F.lit("")), F.col("page").cast("string")
    given = F.nullif(F.col("detection_id"), F.lit(""))
    made = F.when(page != "", F.concat_ws("_", page, qid)).otherwise(qid) if demo else qid
    label = F.when(given.isNotNull(), F.coalesce(F.nullif(F.col("label"), F.lit("")), given)).otherwise(made)
    box = F.when(F.size("bbox") == 4, F.col("bbox")).otherwise(F.array(*[F.lit(0)] * 4))
    across, down = F.greatest(F.lit(1), "width"), F.greatest(F.lit(1), "height")
    url = F.when(F.coalesce("crop_b64", F.lit("")) != "", F.concat(F.lit("data:image/png;base64,"), "crop_b64"))
    return questions.select(
        "page", "pos", F.coalesce(given, made).alias("id"), (box[0] / across).alias("x"), (box[1] / down).alias("y"),
        ((box[2] - box[0]) / across).alias("w"), ((box[3] - box[1]) / down).alias("h"), label.alias("label"), T.trim_ws(text).alias("text"), url.alias("crop_url"),
    )


def chosen_text(corrected: Column, raw_log: Column, merged: Column, crop: Column) -> Column:
    """The first of a question's texts that is not empty: corrected, from the page's log, merged, read from its crop."""
    return F.coalesce(*[F.nullif(T.trim_ws(F.coalesce(c, F.lit(""))), F.lit("")) for c in (corrected, raw_log, merged, crop)], F.lit(NO_TEXT))


def with_crops(questions: DataFrame, crops: DataFrame, keys: list[str]) -> DataFrame:
    """questions and the crop of each; empty where there is none."""
    return questions.join(crops.select(*keys, "crop"), keys, "left").withColumn("crop", F.coalesce("crop", F.lit("")))


def problem_context(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """wanted (id), found (id, label, text) -> (id, label, text): a detection without a text is known by its label."""
    rows = wanted.join(found, "id", "left")
    return rows.select("id", "label", F.coalesce(F.nullif("text", F.lit("")), "label").alias("text"))


def legacy_page_key(year: Column, page: Column) -> Column:
    """Key of a SAT page in an index without groups: with the test before the page, once."""
    bare = page.contains("_") | (F.coalesce(year, F.lit("")).isin("", "sat"))
    return F.when(bare, page).otherwise(F.concat_ws("_", year, page))


def split_legacy_page(year: Column, page: Column) -> Column:
    """struct(year, page): a SAT page's key parted into its test and its page; anything else as it is."""
    joined = (year == "sat") & page.contains("_")
    return F.struct(F.when(joined, F.substring_index(page, "_", 1)).otherwise(year).alias("year"), F.when(joined, F.regexp_replace(page, "^[^_]*_", "")).otherwise(page).alias("page"))


def csat_years(index: DataFrame) -> DataFrame:
    """Rows (year, ...) of an index without groups that are no SAT entry."""
    return index.where("year <> 'sat'")
