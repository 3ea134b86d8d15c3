"""Beginnings of raw files as a data source: a file is opened and so many bytes are read, whatever its size.

``spark.dataSource.register(RawHeads)`` makes it known; then
``spark.read.format("raw_heads").option("path", folder).load()`` gives a row for each
file, and ``spark.readStream`` the files that have come since the last batch.

Options: path (a folder, or a URI that pyarrow knows), glob (of file names, ``*``),
bytes (1,024), files_per_task (256).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("path", StringType()), StructField("id", StringType()), StructField("size", LongType()), StructField("read", LongType()), StructField("content", BinaryType())])
HEAD_BYTES, FILES_PER_TASK = 1024, 256


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(None)
        self.files = files


class _Folder:
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.glob = options.get("glob", "*")
        self.most = int(options.get("bytes", HEAD_BYTES))
        self.each = int(options.get("files_per_task", FILES_PER_TASK))

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri else (fs.LocalFileSystem(), self.uri)

    def listed(self) -> list[tuple[int, str, int]]:
        """Time of change, path and size of the files, in this order."""
        from pyarrow import fs

        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        rows = [(i.mtime_ns or 0, i.path, i.size) for i in found if i.type == fs.FileType.File and fnmatch(i.base_name, self.glob) and not i.base_name.startswith(("_", "."))]
        return sorted(rows)

    def dealt(self, files: list[tuple[int, str, int]]) -> list[Files]:
        return [Files([(path, size) for _, path, size in files[k : k + self.each]]) for k in range(0, len(files), self.each)]

    def rows(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._system()
        for path, size in partition.files:
            with system.open_input_file(path) as file:
                head = file.read_at(min(self.most, size), 0)
            yield path, path.rsplit("/", 1)[-1], size, len(head), head


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Files]:
        return self.folder.dealt(self.folder.listed()) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.folder.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """An offset is the last file, by time of change and path, of those that have been given out."""

    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self.folder.listed()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return self.folder.dealt([f for f in self.folder.listed() if low < f[:2] <= high]) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class RawHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_heads"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Folder(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(_Folder(self.options))


def heads(spark: SparkSession, path: str, glob: str = "*", most: int = HEAD_BYTES, stream: bool = False) -> DataFrame:
    """path, id (file name), size, read (bytes that were read), content (the beginning) of raw files."""
    spark.dataSource.register(RawHeads)
    reader = spark.readStream if stream else spark.read
    return reader.format("raw_heads").option("path", path).option("glob", glob).option("bytes", str(most)).load()
