"""What the operators of this subpackage share: input tables, the shared folder, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: The same characters for Python's str.translate / split on a single space.
SPACE_TABLE = {c: " " for c in range(0x09, 0x0E)}
#: A-Z to a-z and every white-space character to a space, in one pass.
ASCII_LOWER = SPACE_TABLE | {c: chr(c + 32) for c in range(0x41, 0x5B)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def unused(docs: DataFrame, name: str) -> str:
    """name, lengthened until it is no column's beginning."""
    taken = [c.lower() for c in docs.columns]
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 3, is 1. A null doc_id counts as held out: nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="folio-shared-")
        sc.setCheckpointDir(there)
    return there


def stored(df: DataFrame, name: str, by: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and gives
    the planner true sizes, so that a broadcast only happens under Spark's own size threshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._folio_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Remove the files of a stored() frame that is no longer read."""
    path = getattr(df, "_folio_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so once the driver's JVM has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch: it ends with the row that reaches them, so very long texts travel few at a time.
ARROW_BYTES = 4 << 20


def arrow_rows(spark: SparkSession, rows: int = 512) -> None:
    """Bound an Arrow batch: at most `rows` texts, or ARROW_BYTES and one text, travel to a Python worker at a time."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def filtered_joins(spark: SparkSession) -> Iterator[None]:
    """Within, the planner may build a Bloom filter of a join's selective side and apply it to the other side's
    scan, whatever that side's size: only rows that may match are shuffled. The join stays exact.
    """
    conf = {
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "64MB",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which its memory goes back to the system: a Python worker stays for the next task, and beside it
    the executor's JVM needs the room.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run
