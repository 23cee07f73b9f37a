"""Problems of a data folder by year, each year from the files that are there: (year, prob_id, image, content, ground_truth).

| year | files | rows |
| --- | --- | --- |
| 2022 | 2022_math_odd.tsv, images of the folder 2022_math_odd without crops | a row an image |
| 2026 | 2026_math_odd.tsv | every row; image is the first of ten places that exists, or null |
| others | <year>_math_odd_dla.csv beside <year>_math_odd.csv | rows whose base64 can be read |
| 2023 without the former | 2023_math_odd.csv if it has base64 itself, else 2023_math_odd.tsv | as the others, or as 2026 |

A year whose files are missing has no rows. Tables are read as text by the names in their header; nothing is inferred. Ground truth is
that of a problem's last row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from .files import decoded
from .shared import exists

SCHEMA = "year int, prob_id string, image string, content binary, ground_truth string"


def bare(path: Column) -> Column:
    """A path without its scheme and without doubled slashes, as paths are compared."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/+", "/")


def listing(spark: SparkSession, *folders: str) -> DataFrame:
    """(path) of all files below some folders, those that are there; no file is opened. Files without a byte are left out."""
    there = [f for f in folders if exists(spark, f)]
    if not there:
        return spark.createDataFrame([], "path string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)
    return found.select(bare(F.col("path")).alias("path")).distinct()


def table(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """A table of texts with `row_no` rising in the order of its rows."""
    rows = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def candidates(rows: DataFrame, data_dir: str, table_path: str, root: str) -> DataFrame:
    """rows (prob_id, prob_img_path) -> (prob_id, prob_img_path, rank, path): the places at which an image may lie, in order."""
    given = F.trim("prob_img_path")
    name = F.regexp_extract(F.regexp_replace(given, "/+$", ""), "([^/]*)$", 1)
    folder, stem = table_path.rsplit("/", 1)[0], table_path.rsplit("/", 1)[1].rsplit(".", 1)[0]
    # The places, in order.
    places = [(data_dir, given), (data_dir, name), (f"{data_dir}/crop_image", name), (f"{folder}/{stem}", name), (root, given), (root, name), (f"{root}/crop_image", name), (folder, given), (folder, name), (f"{folder}/crop_image", name)]
    # An absolute path stays what it is, wherever it is looked for.
    paths = F.array(*(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(f"{d}/"), p)) for d, p in places))
    return rows.where(F.coalesce(given, F.lit("")) != "").select("prob_id", "prob_img_path", F.posexplode(paths).alias("rank", "path")).withColumn("path", bare(F.col("path")))


def resolved(rows: DataFrame, files: DataFrame, data_dir: str, table_path: str, root: str) -> DataFrame:
    """rows with image: the first place that is among files (path); null where none is."""
    hits = candidates(rows, data_dir, table_path, root).join(files, "path").groupBy("prob_img_path").agg(F.min_by("path", "rank").alias("image"))
    return rows.join(hits, "prob_img_path", "left")


def truths(rows: DataFrame) -> DataFrame:
    return records.last_wins(rows.select(F.col("prob_id"), F.col("prob_desc").alias("ground_truth"), "row_no"), "prob_id", "ground_truth", "row_no")


def year_rows(spark: SparkSession, data_dir: str, year: int, root: str) -> DataFrame:
    at = lambda end: f"{data_dir}/{year}_math_odd{end}"
    here = lambda end: exists(spark, at(end))
    none = spark.createDataFrame([], SCHEMA)
    empty, no_image = F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("image")

    def by_table(truth: DataFrame) -> DataFrame:
        rows = table(spark, at(".tsv"), "\t").select("prob_id", "prob_img_path")
        return resolved(rows, listing(spark, data_dir, root), data_dir, at(".tsv"), root).select("prob_id", "image", empty), truth

    def by_bytes(end: str, truth: DataFrame) -> DataFrame:
        return table(spark, at(end), ",").select("prob_id", no_image, decoded("prob_base64").alias("content")).where("content is not null"), truth

    if year == 2022 and here(".tsv"):
        images = listing(spark, at("")).where(F.col("path").rlike(r"^.*/2022_math_odd/[^/]*\.png$") & ~F.col("path").rlike("_crop[^/]*$"))
        found = images.select(F.regexp_extract("path", r"([^/]*)\.png$", 1).alias("prob_id"), F.col("path").alias("image"), empty), truths(table(spark, at(".tsv"), "\t"))
    elif year == 2026 and here(".tsv"):
        found = by_table(truths(table(spark, at(".tsv"), "\t")))
    elif year in (2022, 2026) or not here(".csv"):
        return none
    else:
        given = table(spark, at(".csv"), ",")
        if here("_dla.csv"):
            found = by_bytes("_dla.csv", truths(given))
        elif year == 2023 and "prob_base64" in given.columns:
            found = by_bytes(".csv", truths(given))
        elif year == 2023 and here(".tsv"):
            found = by_table(truths(given))
        else:
            return none
    rows, truth = found
    return records.with_truth(rows, truth, "prob_id", "ground_truth").select(F.lit(year).alias("year"), "prob_id", "image", "content", "ground_truth")


def problems(spark: SparkSession, data_dir: str, years: list[int], root: str) -> DataFrame:
    """The rows of all years that have files, in one frame."""
    out = spark.createDataFrame([], SCHEMA)
    for year in years:
        out = out.unionByName(year_rows(spark, data_dir, year, root))
    return out
