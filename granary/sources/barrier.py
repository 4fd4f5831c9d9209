"""One file per rank, flushed by all ranks before one of them publishes the list: readers see all ranks or none."""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.arrow import STATE, place


def _flushed(fs: pafs.FileSystem, at: str) -> None:
    """On the disk, not in a buffer; other stores keep what is closed."""
    if isinstance(fs, pafs.LocalFileSystem):
        handle = os.open(at, os.O_RDONLY)
        try:
            os.fsync(handle)
        finally:
            os.close(handle)


def write_ranks(df: DataFrame, path: str, ranks: int, by: str | None = None, check: Callable[[int], None] | None = None) -> list[int]:
    """Write now, and tell the rows of each rank: ``df`` is dealt to ``ranks`` tasks of one barrier stage, by the hash of ``by`` or in turn.

    Each task writes a shard of its own under a name that no reader looks for, flushes it and waits for all others; then rank 0 gives the
    shards their list (``read_shards`` sees listed shards only) in one rename, and the rest wait for that. If a task fails, Spark runs all of
    them again under new names, and the list stays as it was. The cluster must have ``ranks`` free cores at once.
    ``check(rank)`` is called before a task waits.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        rank, run = context.partitionId(), uuid.uuid4().hex[:12]  # another one for each attempt
        fs, at = place(path)
        fs.create_dir(at, recursive=True)
        name, rows, sink, writer = f"rank{rank}-{run}.arrow", 0, None, None
        try:
            for b in batches:
                if writer is None:
                    sink = fs.open_output_stream(posixpath.join(at, name))
                    writer = pa.ipc.new_file(sink, b.schema)
                writer.write_batch(b)
                rows += b.num_rows
        finally:
            if writer is not None:
                writer.close()
                sink.close()
        if writer is not None:
            _flushed(fs, posixpath.join(at, name))
        if check is not None:
            check(rank)
        told = context.allGather(json.dumps({"name": name, "rows": rows}))
        if rank == 0:
            listed = [s for s in map(json.loads, told) if s["rows"]]
            mine = posixpath.join(at, f"{STATE}.{run}")
            with fs.open_output_stream(mine) as f:
                f.write(json.dumps({"shards": listed}).encode())
            _flushed(fs, mine)
            fs.move(mine, posixpath.join(at, STATE))
        context.barrier()
        yield pa.RecordBatch.from_pydict({"rank": pa.array([rank], pa.int32()), "rows": pa.array([rows], pa.int64())})

    dealt = df.repartition(ranks, by) if by else df.repartition(ranks)
    # Spark runs a broken barrier stage again only if a shuffle follows it
    told = dealt.mapInArrow(write, "rank int, rows long", barrier=True).groupBy("rank").agg(F.max("rows").alias("rows")).collect()
    return [r["rows"] for r in sorted(told)]
