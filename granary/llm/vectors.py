"""Vectors as integers: what vector compression and hard-negative mining have in common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of this size or more take no part: with them sums of squared differences may not fit a long.
LARGEST = 1 << 20


def integer_rows(rows: DataFrame, vec_col: str, scale: int = 256, **columns: Column) -> DataFrame:
    """``columns`` and ``vec`` array<int>, floor(scale * x) of each component, of the rows whose vector can be read.

    Left out are vectors that are null, that hold null or non-finite components or some of ``LARGEST`` or more, and those of
    another length than the commonest (the shorter, if two are as common).
    """
    vec = F.col(vec_col).cast("array<double>")
    # NaN is greater than any number
    fine = vec.isNotNull() & ~F.coalesce(F.exists(vec, lambda x: x.isNull() | (F.abs(x) >= LARGEST)), F.lit(True))
    whole = F.transform(vec, lambda x: F.floor(x * scale).cast("int"))
    named = rows.where(fine).select(*[c.alias(name) for name, c in columns.items()], whole.alias("vec"))
    dim = named.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return named.where(F.size("vec") == (dim["dim"] if dim else 0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def as_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a 2-d array as bytes."""
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * raw.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])


def from_binary(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
