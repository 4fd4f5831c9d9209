"""Vector code compression: product codebooks by Elkan's form of Lloyd's rounds, in integers.

Components become integers and vectors are cut into equal parts, each with a codebook of its own. A round assigns every part to its
nearest entry and moves the entries to the floored means of their parts. The first assignment measures all distances; each row then
carries, in a stored table, an upper bound for the distance of each part to its entry and a lower bound for each entry. When entries
move, upper bounds grow by the movement of the part's entry and lower bounds shrink by that of theirs. An entry is left
unmeasured only if the triangle inequality puts it strictly farther: its lower bound, or half its distance to the part's entry, is
over the upper bound. The rest are measured in integers, so equal distances go to the lower index exactly. Lower bounds are kept in
a byte each, rounded down to a 255th of the part's largest, and upper ones rounded up, so rounding never prunes too much.

Rows are read and written where they lie: a pass is a map without a shuffle, and what a task sends on is one sum per part and
entry. The driver holds the codebooks (parts * entries * components of a part) and such sums.

Cases: rows whose vector is null or holds null or non-finite components are dropped, and so are those that ``integer_rows`` can't
compare (another length than the commonest, components of 2**20 or more). Lengths that ``parts`` doesn't divide are filled up with
zeros. Fewer rows than entries give as many entries. Null ids are the last to start an entry; ties of ids start in order of
their vectors. Repeated rows count as often as they are there. Entries that no part is nearest to stay. A null label is a label. Empty
tables give no rows and empty codebooks. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, stored
from granary.llm.vectors import as_binary, from_binary, integer_rows, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows that a task works on at once.
ROWS = 2048
_UP, _DOWN = 1 + 1e-6, 1 - 1e-6


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    reach = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if x.shape[1] * (2 * int(reach)) ** 2 < 1 << 52:  # every partial result is a whole number that a double holds
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)).astype(np.int64)
    return np.stack([((x - entry) ** 2).sum(1) for entry in book], axis=1)


def _kept_bounds(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale per row, a byte per entry): bounds rounded down."""
    scale = lower.max(axis=1).astype(np.float32)
    step = np.where(scale > 0, scale, 1).astype(np.float64)[:, None] / 255
    return scale, np.floor(lower / step * _DOWN).astype(np.uint8)


def _bounds(scale: np.ndarray, kept: np.ndarray) -> np.ndarray:
    return kept * (scale.astype(np.float64)[:, None] / 255 * _DOWN)


class Moved:
    """What a pass needs to know of a codebook that moved: movements, and half distances between entries."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.by = np.sqrt(((new - old).astype(np.float64) ** 2).sum(2)) * _UP
        self.half = np.stack([np.sqrt(squares(b, b).astype(np.float64)) for b in new]) * (_DOWN / 2)
        alone = np.where(np.eye(new.shape[1], dtype=bool), np.inf, self.half)
        self.nearest = alone.min(axis=2)


def reassign(x: np.ndarray, book: np.ndarray, by: np.ndarray, half: np.ndarray, nearest: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """(code, upper, lower) of one part after its book moved, ``lower`` in place; and how many distances were measured."""
    upper = upper + by[code]
    np.maximum(lower - by, 0, out=lower)
    code = code.copy()
    some = np.flatnonzero(upper >= nearest[code])
    own = ((x[some] - book[code[some]]) ** 2).sum(1)
    upper[some] = np.sqrt(own.astype(np.float64)) * _UP
    at = np.arange(len(some))
    lower[some, code[some]] = np.sqrt(own.astype(np.float64)) * _DOWN
    open_ = (lower[some] <= upper[some, None]) & (half[code[some]] <= upper[some, None])
    open_[at, code[some]] = False
    r, k = np.nonzero(open_)
    d = ((x[some[r]] - book[k]) ** 2).sum(1)
    lower[some[r], k] = np.sqrt(d.astype(np.float64)) * _DOWN
    best = own.copy()
    np.minimum.at(best, r, d)
    entry = np.where(own == best, code[some], len(book))
    tie = d == best[r]
    np.minimum.at(entry, r[tie], k[tie])
    code[some] = entry
    upper[some] = np.sqrt(best.astype(np.float64)) * _UP
    return code, upper, lower, len(some) + len(r)


def _in_parts(vec: pa.Array, dim: int, parts: int) -> np.ndarray:
    x = matrix(vec, dim)
    wide = -(-dim // parts) * parts
    return np.pad(x, ((0, 0), (0, wide - dim))).reshape(len(x), parts, wide // parts)


def _pieces(batches):
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            yield whole.slice(k, ROWS)


def _first(rows: DataFrame, books: np.ndarray, dim: int, kind: str) -> DataFrame:
    """Every part's nearest entry, all distances measured, and the bounds."""
    parts = len(books)

    def run(batches):
        for b in _pieces(batches):
            x = _in_parts(b.column("vec"), dim, parts)
            d = np.stack([squares(x[:, p], books[p]) for p in range(parts)], axis=1)
            code = d.argmin(axis=2)
            own = np.take_along_axis(d, code[..., None], axis=2)[..., 0]
            bounds = [_kept_bounds(np.sqrt(d[:, p].astype(np.float64))) for p in range(parts)]
            yield _state(b, code, np.sqrt(own.astype(np.float64)), bounds)

    return rows.select("id", "label", "vec").mapInArrow(run, f"{kind}, {STATE}")


STATE = "code binary, upper binary, scale binary, lower binary"


def _state(b: pa.RecordBatch, code, upper, bounds) -> pa.RecordBatch:
    up = np.nextafter((upper * _UP).astype(np.float32), np.float32(np.inf))
    scale, lower = np.stack([s for s, _ in bounds], axis=1), np.concatenate([q for _, q in bounds], axis=1)
    columns = [b.column("id"), b.column("label"), b.column("vec"), as_binary(code.astype(np.uint8)), as_binary(up), as_binary(scale), as_binary(lower)]
    return pa.RecordBatch.from_arrays(columns, ["id", "label", "vec", "code", "upper", "scale", "lower"])


def _next(state: DataFrame, old: np.ndarray, new: np.ndarray, dim: int, kind: str, last: bool) -> DataFrame:
    """The state after the books moved; of the ``last`` pass the codes and the sum of the squared distances."""
    parts, entries = new.shape[:2]
    moved = Moved(old, new)

    def run(batches):
        for b in _pieces(batches):
            x = _in_parts(b.column("vec"), dim, parts)
            code, upper = from_binary(b.column("code"), np.uint8).astype(np.int64), from_binary(b.column("upper"), np.float32).astype(np.float64)
            scale, kept = from_binary(b.column("scale"), np.float32), from_binary(b.column("lower"), np.uint8).reshape(len(x), parts, entries)
            code, upper, bounds, error = code.copy(), upper.copy(), [], np.zeros(len(x), np.int64)
            for p in range(parts):
                code[:, p], upper[:, p], lower, _ = reassign(x[:, p], new[p], moved.by[p], moved.half[p], moved.nearest[p], code[:, p], upper[:, p], _bounds(scale[:, p], kept[:, p]))
                if last:
                    error += ((x[:, p] - new[p][code[:, p]]) ** 2).sum(1)
                else:
                    bounds.append(_kept_bounds(lower))
            if last:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), as_binary(code.astype(np.uint8)), pa.array(error)], ["id", "label", "code", "error"])
            else:
                yield _state(b, code, upper, bounds)

    out = f"{kind.rpartition(',')[0]}, code binary, error long" if last else f"{kind}, {STATE}"
    return state.mapInArrow(run, out)


def _means(state: DataFrame, books: np.ndarray, dim: int) -> np.ndarray:
    """The books with entries at the floored means of their parts: a task adds up its own, sums of tasks meet by entry."""
    parts, entries, width = books.shape

    def run(batches):
        sums, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in _pieces(batches):
            x, code = _in_parts(b.column("vec"), dim, parts), from_binary(b.column("code"), np.uint8)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                for j in range(width):
                    # at most 2,048 components below 2**28 in size: exact in doubles
                    sums[p, :, j] += np.bincount(code[:, p], x[:, p, j], entries).astype(np.int64)
        p, k = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(n[p, k]), pa.array(sums[p, k].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    told = state.select("vec", "code").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    place = F.posexplode(F.concat(F.array(F.col("n")), "sums")).alias("j", "v")  # the count goes along as component 0
    met = told.select("part", "entry", place).groupBy("part", "entry", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    by = {(r["part"], r["entry"], r["j"]): int(r["v"]) for r in met.collect()}
    out = books.copy()
    for p, k, j in by:
        if j:
            out[p, k, j - 1] = by[p, k, j] // by[p, k, 0]
    return out


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code binary, error) of every kept row, the codebooks as parts x entries x components)."""
    if not 0 < entries <= 256 or rounds < 1:
        raise ValueError("a code is a byte: 1 to 256 entries, and one round at least")
    kept = stored(integer_rows(rows, vec_col, scale, id=F.col(id_col), label=F.col(label_col)), "integers")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    first = kept.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).select("vec").collect()
    if not first:
        return kept.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    dim = len(first[0]["vec"])
    started = _in_parts(pa.array([r["vec"] for r in first], pa.list_(pa.int32())), dim, parts)
    books = started.transpose(1, 0, 2).copy()
    state = stored(_first(kept, books, dim, kind), "state")
    discard(kept)
    for k in range(rounds):
        moved = _means(state, books, dim)
        after = stored(_next(state, books, moved, dim, kind, last=k == rounds - 1), "state")
        discard(state)
        state, books = after, moved
    return state, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of its label's rows added up; null labels are one."""
    sums = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def decoded(coded: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """(id, vec array<double>): each row's vector as its codes tell it, in the middle of the integers' steps."""

    def run(batches):
        for b in _pieces(batches):
            code = from_binary(b.column("code"), np.uint8)
            said = np.concatenate([books[p][code[:, p]] for p in range(len(books))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(((said + 0.5) / scale).tolist(), pa.list_(pa.float64()))], ["id", "vec"])

    return coded.select("id", "code").mapInArrow(run, f"id {coded.schema['id'].dataType.simpleString()}, vec array<double>")
