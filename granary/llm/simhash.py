"""SimHash near-dedup: 64-bit fingerprints of 4-word shingles, linked by a binary-trie self-join under a Hamming budget.

Distribution: fingerprints that differ in at most ``budget`` bits agree on at least one of ``budget + 1`` bit blocks, so
each distinct fingerprint goes to ``budget + 1`` sub-tries, keyed by block and block value; within a partition the tries
are ranges of one sorted array and node pairs are traversed level by level. Sub-tries over ``split_at`` are dealt out
again by the blocks of the bits that are still free, so a hot block value does not land in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import shuffle_width, stored
from granary.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BITS = 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Bit i is 1 if set in over half of the XXH64 hashes of the shingles; 0 for texts without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    k = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    n = len(h)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = n // 255 * 255
    counts = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        counts = counts + bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long): the fingerprint of every whole text as a signed 64-bit integer; null texts count as empty."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, words, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [[int(x) for x in part] for part in np.array_split(np.array(bits), parts)]


def _labels(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Merge the label classes that the index pairs (a, b) join; a label is the least index of its class."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Self-join of the tries of each group: (member, root) index pairs that span the classes linked inside it.

    The trie is implicit: a node is a range of the sorted array whose fingerprints share their leading bits. Node pairs go
    down a bit at a time; a pair whose differing bits exceed the budget is pruned, and so is one whose leaves are all in
    one class already. Small pairs are compared leaf by leaf.
    """
    order = np.lexsort((fp, group))
    g, x, n = group[order], fp[order], len(fp)
    label = np.arange(n)
    near = np.flatnonzero((g[1:] == g[:-1]) & (np.bitwise_count(x[1:] ^ x[:-1]) <= budget))
    label = _labels(near, near + 1, label)
    cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    lo, hi = cuts[:-1], cuts[1:]
    keep = hi - lo > 1
    lo1, hi1 = lo[keep], hi[keep]
    lo2, hi2, dist = lo1.copy(), hi1.copy(), np.zeros(len(lo1), np.int64)
    for depth in range(BITS + 1):
        if not len(lo1):
            break
        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        done = (changes[hi1 - 1] == changes[lo1]) & (changes[hi2 - 1] == changes[lo2]) & (label[lo1] == label[lo2])
        n1, n2 = hi1 - lo1, hi2 - lo2
        leaf = ~done & ((n1 * n2 <= small) | (depth == BITS))
        if leaf.any():
            a0, b0, w1, w2 = lo1[leaf], lo2[leaf], n1[leaf], n2[leaf]
            size = w1 * w2
            for s in range(0, len(size), 1 << 18):
                part = slice(s, s + (1 << 18))
                sz = size[part]
                which = np.repeat(np.arange(len(sz)), sz)
                k = np.arange(len(which)) - np.repeat(np.cumsum(sz) - sz, sz)
                i, j = a0[part][which] + k // w2[part][which], b0[part][which] + k % w2[part][which]
                ok = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
                label = _labels(i[ok], j[ok], label)
        go = ~done & ~leaf
        lo1, hi1, lo2, hi2, dist = lo1[go], hi1[go], lo2[go], hi2[go], dist[go]
        if not len(lo1) or depth == BITS:
            break
        ones = np.concatenate(([0], np.cumsum((x >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int64)))
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        same = (lo1 == lo2) & (hi1 == hi2)
        other = ~same
        step = [
            (lo1, mid1, lo2, mid2, dist),
            (mid1, hi1, mid2, hi2, dist),
            (lo1, mid1, mid2, hi2, dist + 1),
            (mid1[other], hi1[other], lo2[other], mid2[other], dist[other] + 1),
        ]
        lo1, hi1, lo2, hi2, dist = (np.concatenate(c) for c in zip(*step, strict=True))
        live = (dist <= budget) & (hi1 > lo1) & (hi2 > lo2) & ~((lo1 == lo2) & (hi1 - lo1 == 1))
        lo1, hi1, lo2, hi2, dist = lo1[live], hi1[live], lo2[live], hi2[live], dist[live]
    moved = np.flatnonzero(label != np.arange(n))
    return order[moved], order[label[moved]]


def block_masks(budget: int) -> tuple[list[int], list[list[int]]]:
    """Bit masks of the ``budget + 1`` blocks, and for each block those of the blocks of its remaining bits."""
    tops = _blocks(list(range(BITS)), budget + 1)
    mask = lambda bits: sum(1 << b for b in bits)
    return [mask(bits) for bits in tops], [[mask(sub) for sub in _blocks([b for b in range(BITS) if b not in bits], budget + 1)] for bits in tops]


def block_keys(prints: DataFrame, budget: int, split_at: int = 1024) -> DataFrame:
    """(rep, fp) -> (rep, fp, key, block): a row per bit block of the fingerprint; two within the budget share a key.

    Blocks with more than ``split_at`` fingerprints are keyed again by the blocks of their remaining bits; their ``block``
    is -1.
    """
    tops, rests = block_masks(budget)

    def masked(mask):
        return F.col("fp").bitwiseAND(F.lit(int(np.array([mask], np.uint64).view(np.int64)[0])))

    keyed = prints.select("rep", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), masked(bits).alias("value")) for i, bits in enumerate(tops)])).alias("k")).select("rep", "fp", "k.*")
    hot = keyed.groupBy("block", "value").count().where(F.col("count") > split_at).select("block", "value", F.lit(True).alias("hot"))
    keyed = keyed.join(hot, ["block", "value"], "left")
    cold_key = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sub_value")))
    split_key = F.lit(None)
    for i, rest in enumerate(rests):
        split_key = F.when(F.col("block") == i, F.array(*[F.struct(F.lit(j).alias("sub"), masked(sub).alias("sub_value")) for j, sub in enumerate(rest)])).otherwise(split_key)
    return keyed.select("rep", "fp", "block", "value", F.explode(F.when(F.col("hot"), split_key).otherwise(cold_key)).alias("s")).select("rep", "fp", F.xxhash64("block", "value", "s.sub", "s.sub_value").alias("key"), F.when(F.col("s.sub") < 0, F.col("block")).otherwise(-1).alias("block"))


def trie_join(prints: DataFrame, budget: int = 4, split_at: int = 1024) -> DataFrame:
    """(rep long, fp long), fp distinct -> (u, v): links that span every class of fingerprints within the budget.

    No pair within the budget is lost to its class: it shares a block, and the trie of that block joins it or finds both
    ends in one class already. At most one link comes out for each member of a sub-trie.
    """

    def run(batches):
        for rep, fp, key in whole_keys(batches, 3, 2):
            a, b = trie_links(key, fp.view(np.uint64), budget)
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["u", "v"])

    dealt = block_keys(prints, budget, split_at).drop("block").repartition(shuffle_width(prints.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "u long, v long")


def whole_keys(batches, columns: int, key: int, rows: int = 32_768):
    """Arrow batches sorted by column ``key`` -> tuples of arrays with whole keys, of ``rows`` rows or so: a task holds no more than that and one key."""
    held: list[tuple] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(b.column(k).to_numpy() for k in range(columns)))
        size += b.num_rows
        if size < rows:
            continue
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(whole[key], whole[key][-1]))  # the last key may go on
        if cut:
            yield tuple(c[:cut] for c in whole)
        held, size = [tuple(c[cut:] for c in whole)], len(whole[key]) - cut
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4) -> DataFrame:
    """(id, fp, component): every row of ``docs`` with the smallest id that links of at most ``budget`` bits reach.

    Null and blank texts have fingerprint 0 and link like any other. Rows with a null id link others as any row does, but
    can't be a component's smallest id: the component is null where no row has one (ids are below 7 * 2**60). Repeated rows come back
    as often as they are there, all in one component (ties by fingerprint are no case: equal ones are one node). Very long texts are
    read whole, one at a time. Only the two named columns are read, so others never clash; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    # fingerprints that only rows without an id have are nodes beyond all ids
    nameless = F.lit(2**63 - 1) - F.pmod(F.xxhash64("fp"), F.lit(2**60))
    reps = stored(prints.groupBy("fp").agg(F.min("id").alias("rep")).select("fp", F.coalesce("rep", nameless).alias("rep")), "reps")
    found = components(trie_join(reps, budget))
    least = F.coalesce("component", "rep")
    classes = reps.join(found, reps.rep == found.node, "left").select("fp", F.when(least < 2**63 - 1 - 2**60, least).alias("component"))
    return prints.join(classes, "fp").select("id", "fp", "component")
