"""The ends of log files as a table, by a data source that reads files backwards from their ends.

``spark.read.format("tail").option("lines", 100).load(folder)`` after ``register(spark)``: files are listed on the driver, a group of them is a partition, and
each is read in blocks from its end until enough lines are there. So a large file costs as many bytes as its last lines have. Files are opened by
their URI through Arrow's file systems, on the executors.
"""

from __future__ import annotations

import fnmatch
import io

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a block, and of a file that is read whole; lines if none are asked for, and at most.
BLOCK, WHOLE, LINES, MOST = 8 << 10, 100 << 10, 100, 1_000
#: Files of a partition at most.
FILES = 64


def tail_bytes(file: io.IOBase, size: int, lines: int) -> tuple[bytes, int]:
    """(the last ``lines`` lines of a file, how many bytes were read for them). A line break at the very end ends the last line and begins none."""
    if size <= WHOLE:
        file.seek(0)
        data, at = file.read(size), 0
    else:
        blocks, at, breaks = [], size, 0
        # one break more than lines, as the first of them ends the line before; and perhaps one at the very end
        while at > 0 and breaks < lines + 1:
            step = min(BLOCK, at)
            at -= step
            file.seek(at)
            blocks.append(file.read(step))
            breaks += blocks[-1].count(b"\n")
        data = b"".join(reversed(blocks))
    read = len(data)
    ended = data[:-1] if data.endswith(b"\n") else data
    cut = len(ended)
    for _ in range(lines):
        cut = ended.rfind(b"\n", 0, cut)
        if cut < 0:
            break
    return (ended if cut < 0 else ended[cut + 1 :]), read


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files[0][0])
        self.files = files


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = _uri(options["path"])
        self.lines = min(max(int(options.get("lines", LINES)), 1), MOST)
        self.glob = options.get("pathglobfilter", "*")

    def partitions(self) -> list[InputPartition]:
        system, path = pa.fs.FileSystem.from_uri(self.uri)
        info = system.get_file_info(path)
        every = [info] if info.is_file else system.get_file_info(pa.fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in every if f.is_file and not f.base_name.startswith(("_", ".")) and fnmatch.fnmatch(f.base_name, self.glob))
        return [_Files(files[k : k + FILES]) for k in range(0, len(files), FILES)]

    def read(self, partition):
        if partition is None or not isinstance(partition, _Files):
            return
        system, _ = pa.fs.FileSystem.from_uri(self.uri)
        for path, size in partition.files:
            with system.open_input_file(path) as file:
                data, read = tail_bytes(file, size, self.lines)
            text = data.decode("utf-8", "replace").split("\n") if data or size else []
            columns = [pa.array([path] * len(text), pa.string()), pa.array(range(1, len(text) + 1), pa.int32()), pa.array([x.removesuffix("\r") for x in text], pa.string()), pa.array([read] * len(text), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "place", "line", "bytes_read"])


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, place int, line string, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tail)


def tails(spark: SparkSession, path: str, lines: int = LINES, glob: str = "*") -> DataFrame:
    """(path, place, line, bytes_read): the last ``lines`` lines (1 to ``MOST``) of each file under a path, numbered from 1 in their order, without their
    ends; bytes that are no UTF-8 become marks. Empty files have no lines; hidden files are not read."""
    register(spark)
    return spark.read.format("tail").option("lines", lines).option("pathGlobFilter", glob).load(path)


def newest(listing: DataFrame) -> DataFrame:
    """A listing of files (``files.listing``), those that changed last first."""
    return listing.orderBy(F.desc("modified"), "path")
