"""Readers and writers of the formats that records travel in. All schemas are declared; none is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = "*.{png,jpg,jpeg,PNG,JPG,JPEG}"
# Columns of the problem table.
PROBLEM_COLUMNS = ("prob_id", "prob_type", "prob_area", "prob_point", "prob_desc", "prob_img_path", "prob_fig_img_path", "answer", "solution")
CHUNK = "problemId string, modelId string, kind string, event string, text string, errorMessage string, timestampMs long"
PAGE = "page_image string, width int, height int, y_cut int, x_divider double, questions array<struct<qid:string,merged_text:string,bbox:array<int>>>, contour_injected_qids array<string>"


def images(spark: SparkSession, *dirs: str) -> DataFrame:
    """(page_id, grp, path, length, content) of the image files of some folders, not of folders below."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).load(list(dirs)).dropDuplicates(["path"])
    return found.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("page_id"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("grp"), "path", "length", "content")


def delimited(spark: SparkSession, path: str, columns: tuple[str, ...], sep: str = ",") -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)


def decoded(column: str = "prob_base64"):
    """Bytes of base64 text or of a data URL; null if there are none or they cannot be decoded."""
    body = F.when(F.col(column).startswith("data:"), F.regexp_extract(column, r"^data:[^,]*,(.*)$", 1)).otherwise(F.col(column))
    return F.try_to_binary(F.nullif(F.trim(body), F.lit("")), F.lit("base64"))


def raw_logs(spark: SparkSession, path: str) -> DataFrame:
    """(page, raw): of each page's logs, named <page>__<stamp>.txt, the one whose name comes last."""
    rows = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_name").alias("name"))
    return rows.withColumn("page", F.regexp_extract("name", r"^(.*?)__", 1)).groupBy("page").agg(F.max_by("value", "name").alias("raw"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a question of page JSON files: (page_image, width, height, qid, text, x1, y1, x2, y2); missing sizes come from the boxes."""
    rows = spark.read.schema(PAGE).option("multiLine", True).json(path)
    ext = lambda k: F.greatest(F.lit(1), F.array_max(F.transform("questions", lambda q: F.get(q["bbox"], F.lit(k)))))
    sized = rows.withColumns({"width": F.coalesce("width", ext(2), F.lit(1)), "height": F.coalesce("height", ext(3), F.lit(1))})
    each = sized.select("page_image", "width", "height", F.explode("questions").alias("q")).where("q.qid <> '' and size(q.bbox) = 4")
    return each.select("page_image", "width", "height", "q.qid", F.col("q.merged_text").alias("text"), *(F.col("q.bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))


def chunks(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """NDJSON stream chunks; blank lines are no rows."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(CHUNK).json(path).where("kind is not null")


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """Every value quoted, quotes doubled, line breaks within cells as they are."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("sep", sep).csv(path)


def write_problems(df: DataFrame, path: str) -> None:
    """The problem table, tab-separated; tabs of a description become spaces, its line ends line feeds."""
    desc = F.regexp_replace(F.replace("prob_desc", F.lit("\t"), F.lit(" ")), r"\r\n?", "\n")
    write_table(df.withColumn("prob_desc", desc).select(*PROBLEM_COLUMNS), path, "\t")


def write_pages(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("page_id").json(path)


def write_chunks(df: DataFrame, path: str) -> None:
    """One JSON object a line; columns without a value are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
