"""Raw output of page engines as a data source: a folder of <page>__<stamp>.txt files, in batch and as a stream.

After `register(spark)`, `spark.read.format("raw_pages").load(folder)` and `spark.readStream.format("raw_pages").load(folder)` give a row a
file: (page, stamp, raw). A file is a partition of its own, read by the task that gets it; only names go through the
driver. Folders are any that Arrow's file systems read (local, or by address). Files whose names lack the two parts, and folders below, are
left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators import solve

NAME = re.compile(r"([^/]+?)__([^/]*)\.txt$")
SCHEMA = "page string, stamp string, raw string"


class RawFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def listed(folder: str) -> list[tuple[int, str]]:
    """(time of last change, path) of a folder's raw files, in this order."""
    from pyarrow import fs

    system, where = _system(folder)
    found = system.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return sorted((x.mtime_ns or 0, x.path) for x in found if x.type == fs.FileType.File and NAME.search(x.path))


def rows_of(folder: str, path: str) -> Iterator[tuple[str, str, str]]:
    system, _ = _system(folder)
    page, stamp = NAME.search(path).groups()
    with system.open_input_stream(path) as stream:
        yield page, stamp, stream.read().decode("utf-8", "replace")


class RawReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[RawFile]:
        return [RawFile(path) for _, path in listed(self.folder)]

    def read(self, partition: RawFile) -> Iterator[tuple]:
        yield from rows_of(self.folder, partition.path) if partition and getattr(partition, "path", None) else ()


class RawStreamReader(DataSourceStreamReader):
    """Offsets name the last file of a batch by its time and path; what comes behind it is new. A file must not change once it is there."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": "[0, \"\"]"}

    def latestOffset(self) -> dict:  # noqa: N802
        there = listed(self.folder)
        return {"at": json.dumps(there[-1])} if there else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[RawFile]:
        low, high = (tuple(json.loads(x["at"])) for x in (start, end))
        return [RawFile(path) for at, path in listed(self.folder) if low < (at, path) <= high]

    def read(self, partition: RawFile) -> Iterator[tuple]:
        yield from rows_of(self.folder, partition.path)

    def commit(self, end: dict) -> None:
        pass


class RawPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_pages"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> str:
        if not self.options.get("path"):
            raise ValueError("raw_pages needs a folder: load(folder)")
        return self.options["path"]

    def reader(self, schema) -> RawReader:
        return RawReader(self._folder())

    def streamReader(self, schema) -> RawStreamReader:  # noqa: N802
        return RawStreamReader(self._folder())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawPages)


def page_blocks(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """solve.blocks() of a folder's files, with the file's stamp in the page's name; the same for a stream of files as they come."""
    register(spark)
    reader = spark.readStream if streaming else spark.read
    raw = reader.format("raw_pages").load(folder)
    return solve.blocks(raw.selectExpr("concat(page, '__', stamp) as page", "raw"))
