"""Hard-negative mining by a Voronoi-partition distributed nearest-neighbour join.

Scores are integer inner products. A component that brings every row to the same norm is added (norm augmentation; anchors get 0 there),
so a higher score is exactly a shorter distance. Rows belong to the nearest of some pivots, drawn from the rows by hash; anchors are
grouped by the nearest of some of these pivots. Each search asks, for an anchor, for the first rows by score inside a window of scores,
of its own label or of others. It has two passes, both of them exact local joins of a group's anchors with rows:

* a first look: rows of the anchors' own cells, which gives a lower bound for the last score that is asked for;
* all rows that may serve: for each cell, the group's windows become a range of distances to the pivot by the triangle
  inequality, and a row goes to the groups whose range it lies in, and to no other.

Positives are searched first; their scores are the windows of the negatives. Of rows with equal label and vector only the first ids
can be among the first, so only those are kept (a window with a limit ahead of its shuffle), and equal anchors are searched once.
A group's rows are dealt out by the rows that its cells hold, each task keeps its first ones, and these meet in one aggregate;
so neither a crowded cell nor a large group of copies is one task's work. No pair but those first ones leaves a task. Bounds are widened by
more than the rounding of distances; pruning depends on how far rows spread, results never do.

Cases: rows with a null id or label, and those that ``integer_rows`` can't read (null vectors, null or non-finite components, another
length than the commonest, components of 2**20 or more) take no part, and neither do those of a squared norm of 2**56 or more, whose scores
times 100 may not fit a long. Rows that are equal in id, label and vector are one; rows of one id that differ are rows (and anchors) of
their own. Ties go to the smaller id. Labels may be of any type. Negative or zero positive scores
follow the window as it is written. Anchors without positives or without negatives in the window give no rows; empty tables give
none. Only the three named columns are read, so others never clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import discard, shuffle_width, stored
from granary.llm.vectors import integer_rows, matrix

#: Pivots at most, components of all pivots, and rows that they are drawn from (or so): pivots only steer the pruning.
PIVOTS, COMPONENTS, SAMPLE = 1024, 1 << 22, 20_000
#: Anchors of a group, and rows that a task compares with a group, or so.
GROUP, PART = 512, 65_536
BLOCK = 2048
NONE = 1 << 62


def scores(a: np.ndarray, b: np.ndarray, largest: int) -> np.ndarray:
    """Integer inner products of the rows of a and b, exactly; ``largest`` is the largest squared norm."""
    if largest < 1 << 52:  # every partial sum is a whole number that a double holds
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Space:
    """Pivots, with what distances to them need; small and of fixed size."""

    def __init__(self, pivots: np.ndarray, norms: np.ndarray, largest: int, groups: int):
        self.pivots, self.largest, self.groups = pivots.astype(np.float64), largest, groups
        self.extra = np.sqrt(np.maximum(largest - norms.astype(np.float64), 0))
        self.slack = 1e-6 * math.sqrt(largest) + 1e-3

    def row_distances(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        extra = np.sqrt(np.maximum(self.largest - (x**2).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.largest - 2 * (x @ self.pivots.T + extra[:, None] * self.extra), 0))

    def anchor_distances(self, a: np.ndarray) -> np.ndarray:
        a = a.astype(np.float64)
        return np.sqrt(np.maximum((a**2).sum(1)[:, None] + self.largest - 2 * a @ self.pivots.T, 0))

    def span(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest, farthest) distance of what scores in low..high against each anchor."""
        square = (a.astype(np.float64) ** 2).sum(1) + self.largest
        return np.sqrt(np.maximum(square - 2.0 * high, 0)), np.sqrt(np.maximum(square - 2.0 * low, 0))


def _placed(rows: DataFrame, space: Space, dim: int, anchors: bool) -> DataFrame:
    """``rows`` with ``cell``, the nearest pivot, and ``far``, the distance to it; anchors are placed among the first ``groups`` pivots."""
    names = [f.name for f in rows.schema]

    def run(batches):
        for whole in batches:
            for b in (whole.slice(k, BLOCK) for k in range(0, whole.num_rows, BLOCK)):
                x = matrix(b.column("vec"), dim)
                d = space.anchor_distances(x) if anchors else space.row_distances(x)
                cell = d.argmin(1)
                more = [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])]
                if anchors:
                    more.append(pa.array(d[:, : space.groups].argmin(1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*names, "cell", "far", *["home"] * anchors])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, cell int, far double" + ", home int" * anchors)


def _ranges(asks: DataFrame, space: Space, dim: int, look: bool) -> DataFrame:
    """(cell, group, least, most): the distances to a cell's pivot at which a row may serve the group; a first look asks for its own cells whole."""
    n = len(space.pivots)

    def told(group, low, high):
        some = np.flatnonzero(low <= high)
        k = len(some)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([group] * k, pa.int64()), pa.array(low[some]), pa.array(high[some])], ["cell", "group", "least", "most"])

    def run(batches):
        group, low, high = None, None, None
        for b in batches:
            keys, x = b.column("group").to_numpy(), matrix(b.column("vec"), dim)
            cells = b.column("cell").to_numpy()
            least, most = (np.array([f(v) for v in b.column(c).to_pylist()]) for c, f in (("low", min), ("high", max)))
            d, (near, far) = space.anchor_distances(x), space.span(x, np.maximum(least, -NONE), np.minimum(most, NONE))
            a = np.maximum(d - far[:, None], near[:, None] - d) - space.slack
            z = d + far[:, None] + space.slack
            if look:
                own = np.arange(n)[None] == cells[:, None]
                a, z = np.where(own, -1.0, np.inf), np.where(own, np.inf, -np.inf)
            for g in dict.fromkeys(keys.tolist()):
                here = keys == g
                if g != group:
                    if group is not None:
                        yield told(group, low, high)
                    group, low, high = g, np.full(n, np.inf), np.full(n, -np.inf)
                low, high = np.minimum(low, a[here].min(0)), np.maximum(high, z[here].max(0))
        if group is not None:
            yield told(group, low, high)

    dealt = asks.select("group", "cell", "vec", "low", "high").repartition(shuffle_width(asks.sparkSession), "group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "cell int, group long, least double, most double")


def _firsts(ask: np.ndarray, score: np.ndarray, ids: np.ndarray, need: int) -> np.ndarray:
    """Indices of the first ``need`` of each ask, higher scores first, ties by id."""
    order = np.lexsort((ids, -score, ask))
    a = ask[order]
    start = np.concatenate(([True], a[1:] != a[:-1]))
    place = np.arange(len(a)) - np.maximum.accumulate(np.where(start, np.arange(len(a)), 0))
    return order[place < need]


def _joined(asks: DataFrame, rows: DataFrame, ranges: DataFrame, space: Space, dim: int, need: int, same: bool) -> DataFrame:
    """(ask, window, score, id): the first rows of each task's share for every window of every ask."""
    spark = asks.sparkSession

    def run(batches):
        group, held, kept = None, [], None

        def result():
            return pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1].astype(np.int32)), pa.array(kept[2]), pa.array(kept[3])], ["ask", "window", "score", "id"])

        def opened():
            """The asks of a group as arrays, a row for each window."""
            ask = np.concatenate([h[0] for h in held])
            label = np.concatenate([h[1] for h in held])
            low, high = [w for h in held for w in h[3]], [w for h in held for w in h[4]]
            of = np.repeat(np.arange(len(ask)), [len(w) for w in low])
            window = np.concatenate([np.arange(len(w)) for w in low])
            return ask, label, np.concatenate([h[2] for h in held]), of, window, np.concatenate(low).astype(np.int64), np.concatenate(high).astype(np.int64)

        def met(group_, kept_, ids, labels, x):
            ask, label, vec, of, window, low, high = group_
            s = scores(vec, x, space.largest)
            equal = label[:, None] == labels[None]
            some = equal if same else ~equal
            floor = np.full(len(of), -NONE)
            if len(kept_[0]):  # scores below the last of a full list can't come in
                place = kept_[4]
                full = np.bincount(place, minlength=len(of)) == need
                last = np.full(len(of), NONE)
                np.minimum.at(last, place, kept_[2])
                floor = np.where(full, last, floor)
            least = np.maximum(low, floor)
            # windows are few per ask: one look at all of them together, then one at each that is hit
            i, j = np.nonzero(some & (s >= np.minimum.reduceat(least, np.flatnonzero(np.diff(of, prepend=-1)))[:, None]) & (s <= np.maximum.reduceat(high, np.flatnonzero(np.diff(of, prepend=-1)))[:, None]))
            sizes = np.bincount(of, minlength=len(ask))
            w = np.repeat((np.cumsum(sizes) - sizes)[i], sizes[i]) + np.arange(sizes[i].sum()) - np.repeat(np.cumsum(sizes[i]) - sizes[i], sizes[i])
            j = np.repeat(j, sizes[i])
            hit = s[of[w], j]
            fit = (hit >= least[w]) & (hit <= high[w])
            w, j, hit = w[fit], j[fit], hit[fit]
            place, score, got = np.concatenate((kept_[4], w)), np.concatenate((kept_[2], hit)), np.concatenate((kept_[3], ids[j]))
            best = _firsts(place, score, got, need)
            place = place[best]
            return ask[of[place]], window[place], score[best], got[best], place

        nothing = tuple(np.zeros(0, np.int64) for _ in range(5))
        opened_ = None
        for whole in batches:
            for b in (whole.slice(k, BLOCK) for k in range(0, whole.num_rows, BLOCK)):
                keys = b.column("key").to_numpy()
                cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0)).tolist() + [len(keys)]
                for start, stop in zip(cuts, cuts[1:], strict=False):
                    piece = b.slice(start, stop - start)
                    if keys[start] != group:
                        if kept is not None and len(kept[0]):
                            yield result()
                        group, held, kept, opened_ = keys[start], [], nothing, None
                    asking = int(np.count_nonzero(piece.column("row").to_numpy(zero_copy_only=False) == 0))
                    if asking:
                        p = piece.slice(0, asking)
                        held.append((p.column("id").to_numpy(), p.column("label").to_numpy(), matrix(p.column("vec"), dim), [np.array(v) for v in p.column("low").to_pylist()], [np.array(v) for v in p.column("high").to_pylist()]))
                    if asking < stop - start and held:
                        p = piece.slice(asking)
                        opened_ = opened_ or opened()
                        kept = met(opened_, kept, p.column("id").to_numpy(), p.column("label").to_numpy(), matrix(p.column("vec"), dim))
        if kept is not None and len(kept[0]):
            yield result()

    counts = stored(rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("farthest")), "cells")
    sent = ranges.join(counts, "cell").where("least <= farthest and near <= most")
    sent = stored(sent.select("cell", "group", "least", "most", "n"), "ranges")
    parts = stored(sent.groupBy("group").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts")), "parts")
    routed = stored(sent.drop("n").join(parts, "group"), "routes")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    given = rows.join(routed, "cell").where("far between least and most").select(F.xxhash64("group", part).alias("key"), F.lit(1).alias("row"), "id", "label", "vec", F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high"))
    asked = asks.join(parts, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select(F.xxhash64("group", "part").alias("key"), F.lit(0).alias("row"), F.col("ask").alias("id"), "label", "vec", "low", "high")
    dealt = asked.unionByName(given).repartition(shuffle_width(spark), "key").sortWithinPartitions("key", "row")
    return dealt.mapInArrow(run, "ask long, window int, score long, id long")


def _lists(found: DataFrame, need: int) -> DataFrame:
    """(ask, window, first array<struct<score, id>>): the shares of an ask meet, at most ``need`` rows of each."""
    ranks = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= need)
    return best.groupBy("ask", "window").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))), lambda r: F.struct(r["score"].alias("score"), r["id"].alias("id"))).alias("first"))


def search(asks: DataFrame, rows: DataFrame, space: Space, dim: int, need: int, same: bool) -> DataFrame:
    """(ask, window, first): the first ``need`` rows by score (ties by id) in each of an ask's windows low..high, of its label or of others.

    ``asks``: (ask, group, cell, label, vec, low array<long>, high array<long>); ``rows``: (id, label, vec, cell, far).
    """
    looked = _lists(_joined(asks, rows, _ranges(asks, space, dim, look=True), space, dim, need, same), need)
    bound = looked.where(F.size("first") == need).groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("window", F.element_at("first", -1)["score"]))).alias("bound"))
    better = F.transform("low", lambda v, k: F.greatest(v, F.coalesce(F.try_element_at("bound", k), v)))
    nearer = stored(asks.join(bound, "ask", "left").withColumn("low", F.when(F.col("bound").isNull(), F.col("low")).otherwise(better)).drop("bound"), "asks")
    return stored(_lists(_joined(nearer, rows, _ranges(nearer, space, dim, look=False), space, dim, need, same), need), "firsts")


def _space(rows: DataFrame, asks: int, pivots: int | None) -> tuple[Space, int]:
    """Pivots among the rows, by the hash of their vectors; their number grows with the square root of the rows."""
    n, largest, dim = rows.agg(F.count("*"), F.max("norm"), F.max(F.size("vec"))).first()
    if not n:
        return Space(np.zeros((1, 0)), np.zeros(1), 1, 1), 0
    p = pivots or max(1, min(PIVOTS, int(math.sqrt(n) / 8), COMPONENTS // max(1, dim)))
    drawn = rows.where(F.pmod(F.xxhash64("vec"), F.lit(max(1, n // SAMPLE))) == 0).select("vec", "norm").distinct().orderBy(F.xxhash64(F.lit(11), "vec"), "vec").limit(p).collect()
    drawn = drawn or rows.orderBy("vec").limit(1).collect()
    x = np.array([r["vec"] for r in drawn], np.int64)
    return Space(x, np.array([r["norm"] for r in drawn]), int(largest), max(1, min(len(x), -(-asks // GROUP)))), x.shape[1]


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256, pivots: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says which rows are anchors. An anchor's positives are the first others of its label by score; for each, the first
    rows of other labels whose score is between ``window`` hundredths of the positive's.
    """
    known = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    whole = integer_rows(known, vec_col, scale, id=F.col(id_col).cast("long"), label=F.xxhash64(F.col(label_col).cast("string")), asked=F.coalesce(anchor, F.lit(False)))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    read = stored(whole.withColumn("norm", norm).where(F.col("norm") < float(1 << 56)), "read")
    most = 1 + max(positives, negatives)
    firsts = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))
    once = read.groupBy("id", "label", "vec").agg(F.first("norm").alias("norm"))
    few = stored(once.withColumn("place", firsts).where(F.col("place") <= most).drop("place"), "few")
    own = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    members = stored(read.where("asked").select("id", "label", "vec", own.alias("own")).distinct(), "members")
    numbered = stored(members.select("label", "vec").distinct().withColumn("ask", F.monotonically_increasing_id()), "numbered")
    space, dim = _space(few, numbered.count(), pivots)
    placed = stored(_placed(few, space, dim, anchors=False), "placed")
    asks = stored(_placed(numbered, space, dim, anchors=True), "homes")
    # crowded groups are cut by hash
    sizes = stored(asks.groupBy("home").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("chunks")), "homes_n")
    asks = stored(asks.join(sizes, "home").withColumn("group", F.xxhash64("home", F.pmod(F.xxhash64("ask"), F.col("chunks")))).select("ask", "group", "cell", "label", "vec"), "grouped")
    discard(read, few)

    wide = asks.withColumns({"low": F.array(F.lit(-NONE)), "high": F.array(F.lit(NONE))})
    near = search(wide, placed, space, dim, positives + 1, same=True).select("ask", "first")
    of = numbered.withColumnsRenamed({"label": "l", "vec": "v"})
    ids = members.join(of, (members.label == of.l) & (members.vec == of.v)).select(F.col("id").alias("anchor_id"), "own", "ask")
    # the anchor itself goes; another row of its id and score would be told in the same words
    itself = F.array_position("first", F.struct(F.col("own").alias("score"), F.col("anchor_id").alias("id"))) - 1
    own = stored(ids.join(near, "ask").select("ask", "anchor_id", F.slice(F.filter("first", lambda r, k: k != itself), 1, positives).alias("first")), "positives")

    # a window of scores for each different score among the first of an ask; windows that hold no score are left out
    a, z = window
    lowest = F.expr(f"{a} * s div 100") + F.when(F.expr(f"{a} * s % 100 > 0"), 1).otherwise(0)
    highest = F.expr(f"{z} * s div 100") - F.when(F.expr(f"{z} * s % 100 < 0"), 1).otherwise(0)
    each = near.select("ask", F.explode(F.array_distinct(F.transform("first", lambda r: r["score"]))).alias("s")).withColumns({"lo": lowest, "hi": highest}).where("lo <= hi")
    windows = each.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("s", "lo", "hi"))).alias("w"))
    windows = stored(windows.select("ask", F.col("w.s").alias("s"), F.col("w.lo").alias("low"), F.col("w.hi").alias("high")), "windows")
    far = search(asks.join(windows.drop("s"), "ask"), placed, space, dim, negatives, same=False)
    by_score = far.join(windows.select("ask", "s"), "ask").select("ask", F.get("s", F.col("window")).alias("positive_score"), F.col("first").alias("others"))

    pairs = own.select("ask", "anchor_id", F.explode("first").alias("p")).select("ask", "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    met = pairs.join(by_score, ["ask", "positive_score"])
    told = met.select("anchor_id", "positive_id", "positive_score", F.posexplode("others").alias("rank", "n"))
    return told.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
