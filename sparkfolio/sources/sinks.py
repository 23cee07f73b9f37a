"""Result files that a stream adds to, each row once even if a batch is repeated; and text files in a total order.

A batch goes to a folder of its own attempt, then a small table named by the batch's number says which attempt counts. A
batch that is repeated (its driver died before Spark noted its end) writes another attempt and replaces that entry, so
readers, who take the attempts that entries name, see every batch once and never half of one. What is left behind by
attempts that do not count is removed by `vacuum`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import exists, folder

# Columns of the comparison table and of the table of raw texts.
RESULT_COLUMNS = ("prob_id", "ground_truth", "prob_desc_deepseek", "prob_desc_deepseek2", "prob_desc_qwen", "prob_desc_paddle")
META_COLUMNS = ("prob_id", "raw_deepseek_ocr", "raw_deepseek_ocr2")
#: Cells as they are: all quoted, quotes doubled, white space and line ends kept.
CSV = {"header": "true", "quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


class Sink(NamedTuple):
    """A table of text columns under path: `csv` with all cells quoted, or `json` with one object a line."""

    path: str
    columns: tuple[str, ...]
    kind: str = "csv"

    def write(self, batch: DataFrame, n: int) -> None:
        """Add a batch, or replace what an earlier attempt at it has added. Null cells of a CSV are empty ones."""
        attempt = f"a{uuid.uuid4().hex}"
        rows, to = batch.select(*self.columns), f"{self.path}/data/attempt={attempt}"
        if self.kind == "csv":
            rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in self.columns)).write.options(**CSV).csv(to)
        else:
            rows.select(F.to_json(F.struct(*self.columns)).alias("value")).write.text(to)
        batch.sparkSession.range(1).select(F.lit(attempt).alias("attempt")).write.mode("overwrite").parquet(f"{self.path}/committed/batch={n}")

    def batches(self, spark: SparkSession) -> DataFrame:
        """(batch, attempt): what counts."""
        return spark.read.schema("attempt string, batch long").parquet(f"{self.path}/committed").select("batch", "attempt")

    def read(self, spark: SparkSession) -> DataFrame:
        """The columns and `batch`; with none yet an empty frame."""
        if not exists(spark, f"{self.path}/committed"):
            return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in self.columns) + ", batch long")
        schema = ", ".join(f"`{c}` string" for c in (*self.columns, "attempt"))
        if self.kind == "csv":
            rows = spark.read.schema(schema).options(**CSV, multiLine="true", enforceSchema="false").csv(f"{self.path}/data")
            rows = rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in self.columns), "attempt")
        else:
            rows = spark.read.schema(schema).json(f"{self.path}/data")
        return rows.join(self.batches(spark), "attempt").select(*self.columns, "batch")

    def vacuum(self, spark: SparkSession) -> int:
        """Remove attempts that no batch names; no batch may be under way. Returns their number."""
        held = {r.attempt for r in self.batches(spark).collect()} if exists(spark, f"{self.path}/committed") else set()
        fs, there = folder(spark, f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(there) if s.getPath().getName().removeprefix("attempt=") not in held] if fs.exists(there) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)


def result_sinks(base: str) -> tuple[Sink, Sink]:
    """The comparison table, and the raw texts beside it."""
    return Sink(f"{base}/results", RESULT_COLUMNS), Sink(f"{base}/raw", META_COLUMNS)


def results_writer(base: str, dry_run: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for rows (prob_id, ground_truth, one column a model, raw texts): cells of results are put on
    one line, raw texts stay as they are and are written for rows that have one. A dry run writes ids and ground truth only.
    """
    results, raw = result_sinks(base)

    def write(batch: DataFrame, n: int) -> None:
        line: Callable[[str], Column] = lambda c: T.one_line(F.col(c)) if c != "prob_id" else F.col(c)
        shown = [F.lit("").alias(c) if dry_run and c not in RESULT_COLUMNS[:2] else F.coalesce(line(c), F.lit("")).alias(c) for c in RESULT_COLUMNS]
        results.write(batch.select(*shown), n)
        if not dry_run:
            raw.write(batch.where(" or ".join(f"`{c}` is not null" for c in META_COLUMNS[1:])), n)

    return write


def run_available(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Write all that is there now; called again with the same checkpoint, what has come since."""
    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def write_ordered(df: DataFrame, path: str, order: list[Column], columns: tuple[str, ...], constants: dict[str, str] | None = None, sep: str = ",") -> None:
    """One table of text cells in a total order over its files: rows are dealt by ranges of order and sorted within, so the files
    read by name follow one another and no task sorts everything. Columns that df lacks are filled from constants, or empty;
    every file has the header. Rows that tie in order may change places: make it total.
    """
    given = constants or {}
    cells = [(F.col(c).cast("string") if c in df.columns else F.lit(given.get(c, ""))).alias(c) for c in columns]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select(*(F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cells, columns, strict=True))).write.mode("overwrite").options(**CSV).option("sep", sep).csv(path)


def read_ordered(spark: SparkSession, path: str, columns: tuple[str, ...], sep: str = ",") -> DataFrame:
    """The columns, with the file's name and the row's place in it (`file`, `place`), which give the order back."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).options(**CSV, multiLine="true", enforceSchema="false").option("sep", sep).csv(path)
    # A multi-line file is read whole by one task, so ids within a file rise in the order of its rows.
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows of read_ordered() with `row_no`, from 1, instead of file and place: the place in a file behind the rows of files before it."""
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    # One row a file.
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = rows.withColumn("within", F.row_number().over(Window.partitionBy("file").orderBy("place")))
    return within.join(before, "file").withColumn("row_no", F.col("within") + F.col("before")).drop("file", "place", "within", "before")
