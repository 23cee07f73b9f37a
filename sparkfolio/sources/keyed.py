"""A table by key, in hash buckets: a write reads and replaces the buckets that it touches and no others.

Of several rows of a key the one with the largest `written` counts, and of equally new ones the later write. What is cleared stays as a row without
values that says when, so a bucket whose last key goes is replaced like any other and an older write cannot bring a key
back. Writers take turns: two at a time could lose one's rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, folder

BUCKETS = 64


class KeyedTable(NamedTuple):
    """Rows (keys, values, written long) under path. The number of buckets is fixed when the table is made."""

    path: str
    keys: tuple[str, ...]
    values: str
    key_types: str
    buckets: int = BUCKETS

    @property
    def schema(self) -> str:
        return f"{self.key_types}, {self.values}, written long, cleared boolean, bucket int"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _all(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path) if exists(spark, self.path) else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).where("not cleared").drop("cleared", "bucket")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; the buckets of the others are not read."""
        asked = keys.select(*self.keys).distinct().select(*self.keys, self.bucket())
        return self._in(keys.sparkSession, asked).where("not cleared").join(asked, [*self.keys, "bucket"], "left_semi").drop("cleared", "bucket")

    def _in(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        """What the table holds in the buckets of rows: their numbers, at most `buckets`, prune its folders."""
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        return self._all(spark).where(F.col("bucket").isin(touched))

    def _merge(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        new = rows.withColumn("bucket", self.bucket()).withColumn("_turn", F.lit(1))
        both = self._in(spark, new).withColumn("_turn", F.lit(0)).unionByName(new)
        own = [c for c in both.columns if c not in (*self.keys, "bucket", "_turn")]
        one = F.max_by(F.struct(*own), F.struct("written", "_turn", F.xxhash64(*own)))
        merged = both.groupBy("bucket", *self.keys).agg(one.alias("_one")).select(*self.keys, "_one.*", "bucket")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def upsert(self, rows: DataFrame) -> None:
        """rows (keys, values, written); the last written of a key counts."""
        self._merge(rows.withColumn("cleared", F.lit(False)))

    def insert_missing(self, rows: DataFrame) -> None:
        """Only rows of keys that the table does not hold."""
        self.upsert(rows.join(self.lookup(rows).select(*self.keys), list(self.keys), "left_anti"))

    def clear(self, keys: DataFrame) -> None:
        """keys (keys, written): what was written for them until then goes, later writes stay."""
        held = [c for c in self._all(keys.sparkSession).schema if c.name not in (*self.keys, "written", "cleared", "bucket")]
        self._merge(keys.select(*self.keys, *(F.lit(None).cast(c.dataType).alias(c.name) for c in held), "written", F.lit(True).alias("cleared")))

    def clear_all(self, spark: SparkSession) -> None:
        fs, where = folder(spark, self.path)
        fs.delete(where, True)
