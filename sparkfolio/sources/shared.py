"""Tables that a job writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in a local session without it a folder of our own."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if there:
        return there
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    there = "file://" + tempfile.mkdtemp(prefix="folio-tables-")
    sc.setCheckpointDir(there)
    return there


def folder(spark: SparkSession, path: str):
    """The file system and the path, as Hadoop knows them."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = folder(spark, path)
    return fs.exists(where)


class Stored:
    """A frame written to the shared folder: lineage ends there, and lost executors cost nothing that is not on disk."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files; the frame must not be read any more."""
        fs, where = folder(self.df.sparkSession, self.path)
        fs.delete(where, True)
