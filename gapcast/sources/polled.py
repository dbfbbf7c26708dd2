"""A polled feed as a streaming source: each trigger looks once for payloads that have come since.

A feed writes a payload per poll into a folder. The offset is the place of the last payload
taken, in the order of time and name, so a restart goes on after it and a batch that runs again
reads the same payloads. Payloads are read by the tasks, one each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "message string"
LINES = 10_000


class Payload(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class PolledReader(DataSourceStreamReader):
    """Offsets are (micros, name) of a payload; nothing has come before ``(0, "")``."""

    def __init__(self, folder: str):
        self.folder = folder

    def _store(self) -> tuple[fs.FileSystem, str]:
        if self.folder.startswith("/"):
            return fs.LocalFileSystem(), self.folder
        # Hadoop writes a local folder with one slash.
        return fs.FileSystem.from_uri(self.folder.replace("file:/", "file:///", 1) if "://" not in self.folder else self.folder)

    def _payloads(self) -> list[tuple[int, str]]:
        store, folder = self._store()
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        return sorted((f.mtime_ns // 1000, f.base_name) for f in files)

    def initialOffset(self) -> dict:
        return {"micros": 0, "name": ""}

    def latestOffset(self) -> dict:
        micros, name = max(self._payloads(), default=(0, ""))
        return {"micros": micros, "name": name}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, upto = (start["micros"], start["name"]), (end["micros"], end["name"])
        return [Payload(name) for micros, name in self._payloads() if after < (micros, name) <= upto]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, folder = self._store()
        with store.open_input_stream(f"{folder.rstrip('/')}/{partition.name}") as stream:
            rows: list[str] = []
            for line in _lines(stream):
                rows.append(line)
                if len(rows) == LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["message"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["message"])

    def commit(self, end: dict) -> None:
        """Payloads stay where they are."""


def _lines(stream, size: int = 1 << 20) -> Iterator[str]:
    """Lines of a stream that are not empty, decoded whole."""
    rest = b""
    while True:
        part = stream.read(size)
        whole, _, rest = (rest + part).rpartition(b"\n") if part else (rest, b"", b"")
        for line in whole.split(b"\n"):
            if line.strip():
                yield line.rstrip(b"\r").decode("utf-8", "replace")
        if not part:
            return


class PolledUpdates(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polled_updates"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PolledReader(self.options["folder"])


def read_polled_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of JSON messages, one per line of the payloads that a feed leaves in ``folder``.

    Column ``message``. Every trigger takes what has come since the last one; a trigger of
    ``processingTime='30 seconds'`` polls that often. The folder is on a file system that
    pyarrow reads (local, s3, gs, hdfs) and that all executors share.
    """
    spark.dataSource.register(PolledUpdates)
    return spark.readStream.format("polled_updates").option("folder", folder).load()
