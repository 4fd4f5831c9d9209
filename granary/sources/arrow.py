"""Arrow IPC shards as a Spark data source: the form in which build steps hand tables on.

``register(spark)`` makes format ``arrow_shards`` known. Reading takes a partition per shard, in the stream or the file format, a
record batch at a time, so a task never holds a shard; the schema is the first shard's, and later shards are cast to it. Writing makes
a shard per partition beside its place and moves them in when all tasks are done, with the list of shards and rows in
``state.json``; with that list, readers see the shards of committed writes and no others. Paths may be local or any URI that Arrow's
file systems know.

Cases: a missing path is left out (and an error if no path is there), a shard that can't be read fails the query, an empty folder
or shard gives no rows; without any shard a schema must be given.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

STATE = "state.json"
COUNTS = "shard string, batches long, rows long"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it."""
    local = re.sub(r"^file:/*", "/", path)
    return (pafs.LocalFileSystem(), local) if local.startswith("/") else pafs.FileSystem.from_uri(path)


def shards(path: str) -> list[str] | None:
    """The shards of a folder, or the one file; of a folder with a list those that are listed; null where nothing is there."""
    fs, at = place(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        return None
    if info.type == pafs.FileType.File:
        return [path]
    state = posixpath.join(at, STATE)
    if fs.get_file_info(state).type == pafs.FileType.File:
        with fs.open_input_stream(state) as f:
            names = [s["name"] for s in json.loads(f.read())["shards"]]
    else:
        found = fs.get_file_info(pafs.FileSelector(at, recursive=False))
        names = sorted(f.base_name for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".arrow"))
    return [posixpath.join(path, n) for n in names]


def opened(path: str) -> tuple[pa.Schema, Iterator[pa.RecordBatch]]:
    """Schema and batches of a shard of either format; local files are mapped, so batches that nobody looks at aren't read."""
    fs, at = place(path)
    source = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(at).size else fs.open_input_file(at)
    if source.size() == 0:
        return pa.schema([]), iter(())
    framed = source.read(6) == b"ARROW1"
    source.seek(0)
    if not framed:
        reader = pa.ipc.open_stream(source)
        return reader.schema, iter(reader)
    reader = pa.ipc.open_file(source)
    return reader.schema, (reader.get_batch(k) for k in range(reader.num_record_batches))


@dataclass
class Shard(InputPartition):
    path: str | None = None


class ShardReader(DataSourceReader):
    def __init__(self, found: list[str], schema: StructType, counts: bool):
        self.found, self.schema, self.counts = found, schema, counts

    def partitions(self) -> list[Shard]:
        return [Shard(p) for p in self.found] or [Shard(None)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            return
        wanted = to_arrow_schema(self.schema)
        _, batches = opened(partition.path)
        if self.counts:
            sizes = [b.num_rows for b in batches]
            yield pa.RecordBatch.from_pydict({"shard": [posixpath.basename(partition.path)], "batches": [len(sizes)], "rows": [sum(sizes)]}, schema=wanted)
            return
        for b in batches:
            missing = [f.name for f in wanted if f.name not in b.schema.names]
            if missing:
                raise ValueError(f"{partition.path}: no column {', '.join(missing)}")
            yield pa.RecordBatch.from_arrays([_plain(b.column(f.name)).cast(f.type) for f in wanted], schema=wanted)


def _plain(column: pa.Array) -> pa.Array:
    return column.dictionary_decode() if pa.types.is_dictionary(column.type) else column


def _plain_schema(schema: pa.Schema) -> pa.Schema:
    return pa.schema([f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in schema])


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    rows: int


class ShardWriter(DataSourceArrowWriter):
    """Shards are written under names that no reader looks for; the commit names them and replaces the list in one step."""

    def __init__(self, path: str, overwrite: bool, stream: bool):
        self.path, self.overwrite, self.stream = path, overwrite, stream

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        fs, at = place(self.path)
        fs.create_dir(at, recursive=True)
        name, rows, sink, writer = f"_{uuid.uuid4().hex}.tmp", 0, None, None
        try:
            for b in iterator:
                if writer is None:
                    sink = fs.open_output_stream(posixpath.join(at, name))
                    writer = (pa.ipc.new_stream if self.stream else pa.ipc.new_file)(sink, b.schema)
                writer.write_batch(b)
                rows += b.num_rows
        finally:
            if writer is not None:
                writer.close()
                sink.close()
        return Written(name if writer is not None else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = place(self.path)
        fs.create_dir(at, recursive=True)
        state = posixpath.join(at, STATE)
        listed = fs.get_file_info(state).type == pafs.FileType.File
        kept = json.loads(fs.open_input_stream(state).read())["shards"] if listed and not self.overwrite else []
        run, told = uuid.uuid4().hex[:12], []
        for k, m in enumerate(m for m in messages if m is not None and m.temporary):
            name = f"part-{run}-{k:05d}.arrow"
            fs.move(posixpath.join(at, m.temporary), posixpath.join(at, name))
            told.append({"name": name, "rows": m.rows})
        with fs.open_output_stream(f"{state}.tmp") as f:
            f.write(json.dumps({"shards": kept + told}).encode())
        fs.move(f"{state}.tmp", state)
        if self.overwrite:  # the old shards are in no list any more
            now = {s["name"] for s in told}
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.base_name.endswith(".arrow") and f.base_name not in now:
                    fs.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = place(self.path)
        for m in messages:
            if m is not None and m.temporary:
                fs.delete_file(posixpath.join(at, m.temporary))


class ArrowShards(DataSource):
    """Options: ``path`` (several joined by line ends as ``paths``), ``counts`` (rows of each shard instead of the rows), ``ipc`` (file or stream, for writing)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def _found(self) -> list[str]:
        paths = self.options.get("paths", self.options.get("path", "")).split("\n")
        there = [s for s in map(shards, paths) if s is not None]
        if not there:
            raise FileNotFoundError(f"none of these is there: {', '.join(paths)}")
        return [p for s in there for p in s]

    def schema(self) -> StructType | str:
        if self.options.get("counts", "false") == "true":
            return COUNTS
        for path in self._found():
            kinds, _ = opened(path)
            if len(kinds):
                return from_arrow_schema(_plain_schema(kinds))
        raise ValueError("no shard tells a schema; give one")

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self._found(), schema, self.options.get("counts", "false") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], overwrite, self.options.get("ipc", "file") == "stream")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowShards)


def read_shards(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """The rows of all shards of the paths that are there."""
    register(spark)
    reader = spark.read.format("arrow_shards").option("paths", "\n".join(paths))
    return (reader.schema(_parse_datatype_string(schema)) if schema else reader).load()


def count_shards(spark: SparkSession, *paths: str) -> DataFrame:
    """(shard, batches, rows) of each shard, told by the tasks from the batches' own headers."""
    register(spark)
    return spark.read.format("arrow_shards").option("paths", "\n".join(paths)).option("counts", "true").load()


def write_shards(df: DataFrame, path: str, mode: str = "append", ipc: str = "file") -> None:
    """A shard per partition; ``mode`` is append or overwrite, ``ipc`` file or stream."""
    register(df.sparkSession)
    df.write.format("arrow_shards").mode(mode).option("ipc", ipc).save(path)
