"""Change-feed files as a source: one envelope a line, in a folder whose file names ascend in order of arrival.

    spark.dataSource.register(ChangefeedFiles)
    spark.readStream.format("changefeed_files").option("path", folder).option("topic", "fact_inventory_movement").load()

A stream's offset is the name of the last file that was read; a batch is the files after one name up to another, so a
batch that runs again reads the same files. With ``maxFiles`` a batch has so many at most; ``progress`` names a file of
the reader's own then, in a folder that outlives the driver, from which a restarted query knows where to go on: the
engine does not tell a reader where it stands before it asks for the newest offset. Folders may lie in any store that
``pyarrow.fs`` opens, on executors as well.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "topic string, file string, offset long, value string"
_ROWS = 4096


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _names(folder: str) -> list[str]:
    """Files of a folder in order; hidden ones, and those that are still being written under such a name, are left out."""
    fs, path = _opened(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


def _lines(folder: str, topic: str, name: str) -> Iterator[pa.RecordBatch]:
    """The lines of a file, compressed or not, with their numbers; a last line without an end counts, an empty one does not."""
    fs, path = _opened(folder)
    n, rows = 0, []
    as_batch = lambda: pa.RecordBatch.from_arrays([pa.array([topic] * len(rows), pa.string()), pa.array([name] * len(rows), pa.string()), pa.array([k for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.string())], names=["topic", "file", "offset", "value"])
    with fs.open_input_stream(posixpath.join(path, name), compression="detect") as stream:
        rest = b""
        while block := stream.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                if line.strip():
                    rows.append((n, line.decode("utf-8", "replace")))
                n += 1
                if len(rows) == _ROWS:
                    yield as_batch()
                    rows = []
        if rest.strip():
            rows.append((n, rest.decode("utf-8", "replace")))
    if rows:
        yield as_batch()


class _Files(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.topic = options["path"], options.get("topic", "")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in _names(self.folder)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _lines(self.folder, self.topic, partition.value)


class _FileStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.topic = options["path"], options.get("topic", "")
        self.most, self.progress = int(options.get("maxFiles", 0)), options.get("progress")
        if self.most and not self.progress:
            raise ValueError("maxFiles needs a progress file")
        self.last = self._stored() if self.progress else ""

    def _stored(self) -> str:
        fs, path = _opened(self.progress)
        if fs.get_file_info(path).type != pafs.FileType.File:
            return ""
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())["file"]

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        new = [name for name in _names(self.folder) if name > self.last]
        if new:
            self.last = new[self.most - 1 if 0 < self.most < len(new) else -1]
        return {"file": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last, end["file"])
        return [InputPartition(name) for name in _names(self.folder) if start["file"] < name <= end["file"]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _lines(self.folder, self.topic, partition.value)

    def commit(self, end: dict) -> None:
        if self.progress:
            fs, path = _opened(self.progress)
            with fs.open_output_stream(path + ".new") as f:
                f.write(json.dumps(end).encode())
            fs.move(path + ".new", path)


class ChangefeedFiles(DataSource):
    """``changefeed_files``: options path, topic, and for streams maxFiles and progress."""

    @classmethod
    def name(cls) -> str:
        return "changefeed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Files(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _FileStream(self.options)
