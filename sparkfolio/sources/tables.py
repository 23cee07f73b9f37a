"""Tables as the operators see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. A table is one file or a folder of them; only a pattern, which the last letter makes of the path, may name either to a stream."""
    return spark.readStream.schema(read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(problem, solver, idx, title, body): five conversations are five solvers of a problem, a turn is a step, its first sentence the title."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.expr("conv_id div 5").alias("problem"), (F.col("conv_id") % 5).alias("solver"), F.col("turn").alias("idx"), F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("body"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layout block per order line on a page of 2480 x 3508 pixels: (page, ord, kind, x1, y1, x2, y2, txt).

    Coordinates come from the line's keys by integer arithmetic, so every engine makes the same pages.
    """
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    return li.select(
        F.col("l_orderkey").alias("page"), (F.col("l_linenumber").cast("long") * 100_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey") % 1000 * 100 + F.col("q")).alias("ord"),
        F.element_at(F.array(*map(F.lit, ("text", "sub_title", "equation", "title"))), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("kind"),
        (F.col("l_partkey") * 37 % 2200).cast("int").alias("x1"), (F.col("l_partkey") * 53 % 3200).cast("int").alias("y1"),
        (F.col("l_partkey") * 37 % 2200 + 20 + F.col("q") * 11).cast("int").alias("x2"), (F.col("l_partkey") * 53 % 3200 + 12 + F.col("l_suppkey") % 90).cast("int").alias("y2"),
        F.when(F.col("q") % 3 == 0, F.concat((F.col("q") % 40).cast("string"), F.lit(". item"))).when(F.col("q") % 3 == 1, F.lit("plain words of a block")).otherwise((F.col("l_partkey") % 997).cast("string")).alias("txt"),
    )


#: boxes() in SQL.
BOXES = """boxes as (select l_orderkey page, l_linenumber::bigint * 100000000000 + l_partkey * 100000 + l_suppkey % 1000 * 100 + trunc(l_quantity)::int ord, (['text', 'sub_title', 'equation', 'title'])[l_suppkey % 4 + 1] kind,
    (l_partkey * 37 % 2200)::int x1, (l_partkey * 53 % 3200)::int y1, (l_partkey * 37 % 2200 + 20 + trunc(l_quantity)::int * 11)::int x2, (l_partkey * 53 % 3200 + 12 + l_suppkey % 90)::int y2,
    case trunc(l_quantity)::int % 3 when 0 then (trunc(l_quantity)::int % 40)::varchar || '. item' when 1 then 'plain words of a block' else (l_partkey % 997)::varchar end txt from lineitem)"""
WIDTH, HEIGHT = 2480, 3508
