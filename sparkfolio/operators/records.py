"""Problem records: ids, de-duplication, ground truth, known pages, source precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zfill(x: Column, width: int = 3) -> Column:
    """Zeros in front; unlike lpad() it never cuts."""
    return F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)


def page_spec(page_id: Column) -> Column:
    """struct(document_type, subject_key, page, stored_page_key, id_prefix) of a page id, null if it is none."""
    sat, csat = r"^sat_math_odd_page_(\d+)_(\d+)$", r"^(\d{4})_math_odd_page_(\d+)$"
    v = F.trim(page_id)
    part = lambda rule, k: F.regexp_extract(v, rule, k)
    page_s, page_c = zfill(part(sat, 2)), zfill(part(csat, 2))
    spec = lambda *cols: F.struct(*(c.alias(n) for c, n in zip(cols, ("document_type", "subject_key", "page", "stored_page_key", "id_prefix"))))
    subject = F.concat(part(csat, 1), F.lit("_math_odd"))
    return F.when(v.rlike(sat), spec(F.lit("sat"), F.concat(F.lit("sat-practice-test-"), part(sat, 1), F.lit("-math")), page_s, F.concat_ws("_", part(sat, 1), page_s), F.concat_ws("_", F.lit("sat"), part(sat, 1), page_s))).when(
        v.rlike(csat), spec(F.lit("csat"), subject, page_c, page_c, F.concat(subject, F.lit("_page_"), page_c))
    )


def detection_id(spec: Column, qid: Column) -> Column:
    """The id of a problem on a page: by page for SAT, 2026 and other than numbers, else by track."""
    by_page = F.concat_ws("_", spec["id_prefix"], qid)
    year, q, page = F.substring(spec["subject_key"], 1, 4), F.expr("1"), spec["page"].try_cast("int")
    q = qid.try_cast("int")
    track = F.when(page.between(1, 8), "common").when(page.between(9, 12), "probability").when(page.between(13, 16), "calculus").when(page.between(17, 20), "geometry")
    named = F.concat_ws("_", year, F.lit("odd"), F.when(q <= 22, "common").otherwise(track), q.cast("string"))
    return F.when(spec.isNull(), None).when((spec["document_type"] == "sat") | (year == "2026") | q.isNull() | ((q > 22) & track.isNull()), by_page).otherwise(named)


def document_type(given: Column, problem_id: Column) -> Column:
    v, p = F.lower(F.trim(F.coalesce(given, F.lit("")))), F.lower(F.trim(F.coalesce(problem_id, F.lit(""))))
    return F.when(v.isin("csat", "sat"), v).when(p.rlike("^sat[_-]"), "sat").when(p.rlike(r"^\d{4}_"), "csat")


def longest_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the longest text, the least of equals."""
    return _least(rows, keys, F.coalesce(-F.length("text"), F.lit(1)), F.col("text"))


def _least(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in an order. Each task keeps a row a key before anything is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    one = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("own")))
    return rows.groupBy(*keys).agg(one.alias("one")).select(*keys, *[F.col(f"one.own.{c}").alias(c) for c in rest])


def largest_crop(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Crops without repeated contents (md5 within a key), then the largest of each key; contents stay behind, their md5 goes on."""
    hashed = rows.withColumn("content_md5", F.md5(F.col("content").cast("binary"))).drop("content")
    once = _least(hashed, [*keys, "content_md5"], F.col(id_col))
    return _least(once, keys, F.coalesce(-F.col("area"), F.lit(1)), F.col("content_md5"))


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A lookup table of which a key's last row counts; null values are empty."""
    return rows.groupBy(key).agg(F.coalesce(F.max_by(value, order), F.lit("")).alias(value))


def with_truth(rows: DataFrame, truth: DataFrame, key: str, value: str) -> DataFrame:
    return rows.join(truth, key, "left").withColumn(value, F.coalesce(value, F.lit("")))


def comparison_table(cells: DataFrame, key: str, models: list[str]) -> DataFrame:
    """(key, one column a model) from (key, model_key, cell)."""
    return cells.groupBy(key).pivot("model_key", models).agg(F.first("cell"))


def by_priority(rows: DataFrame, keys: list[str], valid: str | None = None) -> DataFrame:
    """The row of the first source that has the key. With `valid`, a first row that fails it leaves the key out: sources after it do not count."""
    w = Window.partitionBy(*keys).orderBy("priority", "path")
    first = rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
    return first.where(valid) if valid else first


def stored_texts(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """questions (page, questions array) with the text stored for position + 1 where there is one."""
    each = questions.select("page", F.posexplode("questions").alias("pos", "own"))
    stored = texts.select("page", (F.col("number") - 1).alias("pos"), F.col("text").alias("stored"))
    return each.join(stored, ["page", "pos"], "left").select("page", "pos", F.coalesce(F.nullif("stored", F.lit("")), "own").alias("text"))


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays; 255 if they differ in length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 255.0).otherwise(total / F.size(a))


def exact_pages(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads (id, content) that equal a known page (page_id, content): the size is compared first, then SHA-256."""
    sized = lambda df: df.withColumns({"size": F.length("content"), "sha": F.sha2(F.col("content").cast("binary"), 256)})
    first = sized(known).groupBy("size", "sha").agg(F.min("page_id").alias("page_id"))
    hits = sized(uploads).select("id", "size", "sha").join(first, ["size", "sha"])
    return hits.groupBy("id").agg(F.min("page_id").alias("page_id"))


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixel box of a detection, whose unit is the page if all of it lies in 0..1; clamped, at least a pixel."""
    unit = x.between(0, 1) & y.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)
    px = lambda v, size: F.floor(F.when(unit, v * size).otherwise(v) + 0.5).cast("long")
    cx, cy = F.greatest(F.lit(0), F.least(px(x, width), width - 1)), F.greatest(F.lit(0), F.least(px(y, height), height - 1))
    return F.struct(cx.alias("x"), cy.alias("y"), F.greatest(F.lit(1), F.least(px(w, width), width - cx)).alias("w"), F.greatest(F.lit(1), F.least(px(h, height), height - cy)).alias("h"))


def natural_key(text: Column) -> list[Column]:
    """Sort keys: the letters before a number, the number, the rest."""
    rule = r"^(\D*)(\d*)(.*)$"
    return [F.regexp_extract(text, rule, 1), F.regexp_extract(text, rule, 2).try_cast("long"), F.regexp_extract(text, rule, 3)]


def collated_key(text: Column) -> Column:
    """A sort key that reads runs of digits as numbers wherever they stand and letters without case and accents, as
    people order titles; digits come before letters. Texts that differ in case or accents only have equal keys.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.when(r.rlike(r"^\d"), 0).otherwise(1).alias("kind"), r.try_cast("decimal(38,0)").alias("number"), F.collate(r, "UNICODE_CI_AI").alias("letters")))
