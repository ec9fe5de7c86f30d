"""A data source of panel files: df.write.format("panel_files") writes rows (name, png) as files, spark.read gives them back.

Each task attempt writes into a folder of its own below _staging; the commit moves the folders of the attempts that
count to part-*, one rename for each task, and an aborted write removes what was staged. So readers never see part of a write, and
a retried or speculative attempt leaves nothing. The folder must be one that the driver and all executors see under the same path.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "name string, png binary"
STAGING = "_staging"


@dataclass
class Part(InputPartition):
    """The folder of one task's files."""

    folder: str


@dataclass
class Written(WriterCommitMessage):
    """Where a task attempt has put how many files."""

    folder: str
    files: int


class PanelFiles(DataSource):
    """The option path names the folder."""

    @classmethod
    def name(cls) -> str:
        return "panel_files"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> str:
        if not self.options.get("path"):
            raise ValueError("panel_files needs a path")
        return self.options["path"].removeprefix("file:")

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self._folder())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if schema.fieldNames() != ["name", "png"]:
            raise ValueError(f"panel_files takes columns name and png, not {schema.fieldNames()}")
        return Writer(self._folder(), overwrite)


class Reader(DataSourceReader):
    """A partition for each committed part, read file by file; an empty folder has none."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Part]:
        return [Part(str(p)) for p in sorted(Path(self.folder).glob("part-*"))]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition is None:
            return
        for entry in sorted(os.scandir(partition.folder), key=lambda e: e.name):
            yield entry.name, Path(entry.path).read_bytes()


class Writer(DataSourceWriter):
    """Writes a file for each row. A null name or image, a name with a slash, and a name twice in a task fail the write."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.run = folder, overwrite, uuid.uuid4().hex

    def _staged(self) -> Path:
        return Path(self.folder) / STAGING / self.run

    def write(self, iterator: Iterator[Row]) -> Written:
        own = self._staged() / uuid.uuid4().hex
        own.mkdir(parents=True)
        n = 0
        for name, png in iterator:
            if name is None or png is None or "/" in name or name in ("", ".", ".."):
                raise ValueError(f"no file can have the name {name!r}, or its image is null")
            with open(own / name, "xb") as f:
                f.write(png)
            n += 1
        return Written(str(own), n)

    def commit(self, messages: list[Written | None]) -> None:
        before = list(Path(self.folder).glob("part-*")) if self.overwrite else []
        for k, m in enumerate(messages):
            if m is not None and m.files:
                os.rename(m.folder, Path(self.folder) / f"part-{k:05d}-{self.run}")
        for old in before:
            shutil.rmtree(old)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove what this write has staged, and the staging folder where no other write uses it."""
        shutil.rmtree(self._staged(), ignore_errors=True)
        try:
            os.rmdir(Path(self.folder) / STAGING)
        except OSError:
            return


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PanelFiles)
