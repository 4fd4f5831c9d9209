"""Repeated byte strings by a depth-limited radix sort of sampled suffixes.

Every string of ``length`` bytes holds an anchor: the place of its least hashed ``gram``, the same place in each of its
occurrences. So only suffixes at anchors are sorted, and each stands for the strings that start at most ``slack`` =
``length - gram`` bytes before it. The sort goes from the most significant digit: pass 0 groups the suffixes by their
first ``gram`` bytes, and every further pass takes a quarter of the open range of starts, whose common core is a longer
digit. A group of one drops out; a range is settled at once where even its hull (the union of its strings) is repeated,
and one witness of such a hull stays for the ranges that share only a part of it.
After the last pass the digit is the whole string, so equal groups are exactly the repeated windows. In the passes groups
are only counted (with map-side combine), never gathered, so a passage that a third of all documents share is no larger
task. Groups of at most ``GATHERED`` suffixes after pass 0 take a shorter way to the same end: a task sorts their strings.

Strings are compared by digests: 128 bits (core and hull) wherever a string is settled in a pass, 64 bits inside a group of at most
``GATHERED`` suffixes that share a 64-bit core; bytes themselves aren't compared.

Cases: null counts as empty; texts shorter than ``length`` have no strings; a repeat within one document counts. Every row is a
document of its own, also where an id repeats or is null, so identical rows repeat each other. Ties between equal hashes go to the
later place, the same in every occurrence. Very long texts are hashed ``PIECE`` bytes at a time. Only the two named columns are
read, so others never clash. Empty tables give none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, shuffle_width, stored

_MIX = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Most suffixes of a group that one task sorts; larger groups go through the passes.
GATHERED = 512
#: Texts are hashed in pieces of this many bytes, which overlap by a window; memory doesn't grow with the text.
PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each run of w neighbours, by minima from both ends of blocks of w."""
    n = len(x)
    pad = -n % w
    y = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: bytes, length: int = 400, gram: int = 200) -> np.ndarray:
    """Sorted places of the anchors of all strings of ``length`` bytes; which place a string has depends on it alone."""
    n, w = len(data), length - gram + 1
    found, at = [], 0
    while at + length <= n:
        piece = np.frombuffer(data, np.uint8, min(PIECE + length, n - at), at)
        up, down = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_MIX[piece] * up[: len(piece)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: len(piece) - gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        places = np.arange(len(h), dtype=np.uint64)
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - places)
        least = _sliding_min(key, w)
        change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        found.append((np.uint64(0xFFFFFF) - (least[change] & np.uint64(0xFFFFFF))).astype(np.int64) + at)
        at += PIECE
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _digest(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(piece)


def _suffixes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, at, first, last, core, hull): a row per anchor; its strings start ``first`` to ``last`` bytes before ``at``."""
    slack = length - gram

    def run(batches):
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = (data.as_py() or "").encode("utf-8", "surrogatepass")
                places = anchors(data, length, gram)
                if not len(places):
                    continue
                first, last = np.maximum(0, places + length - len(data)), np.minimum(slack, places)
                core, hull = [], []
                for p, x, y in zip(places.tolist(), first.tolist(), last.tolist(), strict=True):
                    core.append(_digest(data[p : p + gram]))
                    hull.append(_digest(data[p - y : p - x + length]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), doc)), pa.array(places.astype(np.int32)), pa.array(first.astype(np.int16)), pa.array(last.astype(np.int16)), pa.array(np.array(core, np.uint64).view(np.int64)), pa.array(np.array(hull, np.uint64).view(np.int64))],
                    ["doc", "at", "first", "last", "core", "hull"],
                )

    return docs.mapInArrow(run, "doc long, at int, first short, last short, core long, hull long")


def _repeated(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows whose core occurs elsewhere: (those whose hull does too, the rest with one witness of each hull they may
    meet and the size ``n`` of the group, the table behind both)."""
    # the counts are stored before they are joined: only then can a frequent core's rows be split over tasks
    cores = stored(rows.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), "cores")
    alive = stored(rows.drop("n").join(cores, "core"), "alive")
    hulls = stored(alive.groupBy("core", "first", "last", "hull").agg(F.count("*").alias("same"), F.min(F.struct("doc", "at")).alias("witness")), "hulls")
    told = stored(alive.join(hulls, ["core", "first", "last", "hull"]), "told")
    discard(cores, alive, hulls)
    settled, rest = told.where("same > 1"), told.where("same = 1")
    witnesses = settled.where("doc = witness.doc and at = witness.at").join(rest.select("core").distinct(), "core", "left_semi")
    return settled, rest.unionByName(witnesses), told


def _contexts(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(core, doc, at, first, last, context, n): the open suffixes with the bytes of their hulls."""
    wanted = rows.groupBy("doc").agg(F.collect_list(F.struct("core", "at", "first", "last", "n")).alias("open"))
    kinds = {"core": pa.int64(), "at": pa.int32(), "first": pa.int16(), "last": pa.int16(), "n": pa.int64()}

    def run(batches):
        for b in batches:
            for doc, text, ranges in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                cols = {k: pa.array([r[k] for r in ranges], t) for k, t in kinds.items()}
                cols |= {"doc": pa.array([doc] * len(ranges), pa.int64()), "context": pa.array([data[r["at"] - r["last"] : r["at"] - r["first"] + length] for r in ranges], pa.binary())}
                names = ["core", "doc", "at", "first", "last", "context", "n"]
                yield pa.RecordBatch.from_arrays([cols[k] for k in names], names)

    return docs.join(wanted, "doc").select("doc", "text", "open").mapInArrow(run, "core long, doc long, at int, first short, last short, context binary, n long")


def sorted_spans(group: list[tuple], length: int, slack: int) -> list[tuple[int, int, int]]:
    """(doc, start, stop) of the strings that occur twice or more among suffixes (doc, at, first, last, context).

    Column k of the table below is the digest of the string that starts k bytes before the anchor; columns are sorted.
    """
    m = len(group)
    data = np.zeros((m, slack + length), np.uint8)
    for i, (_, _, _, last, context) in enumerate(group):
        data[i, slack - last : slack - last + len(context)] = np.frombuffer(context, np.uint8)
    sums = np.zeros((m, slack + length + 1), np.uint64)
    np.cumsum(_MIX[data] * _powers(slack + length)[0][: slack + length], axis=1, out=sums[:, 1:])
    h = (sums[:, length:] - sums[:, : slack + 1])[:, ::-1]
    k = np.arange(slack + 1)
    real = (k >= np.array([[g[2]] for g in group])) & (k <= np.array([[g[3]] for g in group]))
    h = np.where(real, h, np.arange(m, dtype=np.uint64)[:, None])
    order = np.argsort(h, axis=0)
    ranked = np.take_along_axis(h, order, 0)
    equal = ranked[1:] == ranked[:-1]
    twice = np.zeros((m, slack + 1), np.int8)
    twice[1:] |= equal
    twice[:-1] |= equal
    hit = np.zeros((m, slack + 3), np.int8)
    np.put_along_axis(hit[:, 1:-1], order, twice, 0)
    edge = np.diff(hit, axis=1)
    who, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return [(group[i][0], group[i][1] - z + 1, group[i][1] - a + length) for i, a, z in zip(who.tolist(), begin.tolist(), end.tolist(), strict=True)]


def _gathered(contexts: DataFrame, length: int, slack: int) -> DataFrame:
    """(doc, start, stop) of the repeated strings of the groups that one task may sort; a group at a time."""

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["doc", "start", "stop"])

    def run(batches):
        core, group, out = None, [], []
        for b in batches:
            for c, *row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if c != core:
                    if len(group) > 1:
                        out += sorted_spans(group, length, slack)
                    core, group = c, []
                group.append(row)
            if len(out) > 10_000:
                yield batch(out)
                out = []
        if len(group) > 1:
            out += sorted_spans(group, length, slack)
        yield batch(out)

    dealt = contexts.select("core", "doc", "at", "first", "last", "context").repartition(shuffle_width(contexts.sparkSession), "core").sortWithinPartitions("core")
    return dealt.mapInArrow(run, "doc long, start int, stop int")


def _divided(rows: DataFrame, length: int, width: int) -> DataFrame:
    """Cut each open range of starts at multiples of ``width`` and take the digit (core) and the hull of every part."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, at, first, last, context in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                for y in range(last // width * width, first - width, -width):
                    x, z = max(first, y), min(last, y + width - 1)
                    piece = context[last - z : last - x + length]
                    core = context[last - y : last - y - width + 1 + length]  # of the whole part, also where the text's ends cut it
                    for column, value in zip(out, (doc, at, x, z, _digest(core + y.to_bytes(4, "little")), _digest(piece), piece), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int16()), pa.array(out[3], pa.int16()), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[4:6]), pa.array(out[6], pa.binary())],
                ["doc", "at", "first", "last", "core", "hull", "context"],
            )

    return rows.mapInArrow(run, "doc long, at int, first short, last short, core long, hull long, context binary")


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 200, gathered: int = GATHERED) -> DataFrame:
    """(doc, text), doc unique -> (doc, spans array<struct<start int, stop int>>): the strings found elsewhere, as hulls."""
    slack = length - gram
    suffixes = stored(_suffixes(docs, length, gram), "suffixes")
    settled, rest, told = _repeated(suffixes)
    discard(suffixes)
    shape = ["doc", (F.col("at") - F.col("last")).alias("start"), (F.col("at") - F.col("first") + length).alias("stop")]
    spans, done = settled.select(*shape), [told]
    contexts = stored(_contexts(docs, rest, length), "contexts")
    spans = spans.unionByName(_gathered(contexts.where(F.col("n") <= gathered), length, slack))
    width = 4 ** int(math.log(slack, 4)) if slack else 1
    rest = contexts.where(F.col("n") > gathered)
    while not rest.isEmpty():
        parts = stored(_divided(rest.select("doc", "at", "first", "last", "context"), length, width), "parts")
        settled, rest, told = _repeated(parts)
        discard(parts)
        done.append(told)
        spans = spans.unionByName(settled.select(*shape))
        if width == 1:
            break
        width //= 4
    out = stored(spans.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans")
    discard(contexts, *done)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 200, gathered: int = GATHERED) -> DataFrame:
    """Per row: (doc, n_bytes, removed array<struct<start, stop>> of maximal runs, kept binary); doc is the id, also where it repeats or is null."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if named.groupBy("id").agg(F.count("*").alias("n")).where("id is null or n > 1").isEmpty():
        named = named.select(F.col("id").alias("doc"), "text", "id")
    else:  # ids don't tell the rows apart: numbers do, stored with the texts
        named = stored(named.select(F.monotonically_increasing_id().alias("doc"), "text", "id"), "numbered")
    spans = repeated_spans(named.select("doc", "text"), length, gram, gathered)

    def run(batches):
        for b in batches:
            docs_, sizes, runs, kept = [], [], [], []
            for doc, text, found in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s in found or ():
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["stop"])
                    else:
                        merged.append([s["start"], s["stop"]])
                at, left = 0, []
                for start, stop in merged:
                    left.append(data[at:start])
                    at = stop
                docs_.append(doc)
                sizes.append(len(data))
                runs.append([{"start": a, "stop": z} for a, z in merged])
                kept.append(b"".join([*left, data[at:]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs_, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary())],
                ["doc", "n_bytes", "removed", "kept"],
            )

    return named.join(spans, "doc", "left").select("id", "text", "spans").mapInArrow(run, "doc long, n_bytes long, removed array<struct<start:int,stop:int>>, kept binary")
