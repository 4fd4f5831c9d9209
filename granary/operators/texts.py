"""Scores of text pairs: all n-gram counts and the longest common subsequence of a pair in one pass over numbers, and METEOR.

Words become 64-bit hashes in the JVM, so Python sees flat arrays of longs; two different words of one pair are told apart but for a
chance of about words squared in 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of both sides that are counted at once, or so.
WORDS = 1 << 20
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), sizes


def _grams(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every n-gram; the key tells rows apart too."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # words from here to the end of the row
    at = np.flatnonzero(left >= n)
    key = row[at].astype(np.uint64) * _MIX
    for k in range(n):
        key = (key ^ (key >> np.uint64(29))) * _ODD + words[at + k]
    return row[at], key


def gram_matches(refs: tuple, hyps: tuple, most: int) -> np.ndarray:
    """Per row and n up to ``most``: clipped matches, n-grams of hyp, n-grams of ref."""
    rows = len(refs[1])
    out = np.zeros((rows, 3 * most), np.int64)
    for n in range(1, most + 1):
        (r_row, r_key), (h_row, h_key) = _grams(*refs, n), _grams(*hyps, n)
        key, row = np.concatenate((r_key, h_key)), np.concatenate((r_row, h_row))
        order = np.argsort(key, kind="stable")
        if len(key):
            starts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
            of_ref = np.add.reduceat((order < len(r_key)).astype(np.int64), starts)
            total = np.diff(np.append(starts, len(key)))
            out[:, 3 * n - 3] = np.bincount(row[order[starts]], np.minimum(of_ref, total - of_ref), rows)
        out[:, 3 * n - 2], out[:, 3 * n - 1] = np.maximum(hyps[1] - n + 1, 0), np.maximum(refs[1] - n + 1, 0)
    return out


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence: a row of the table as the bits of an integer."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _pieces(refs: pa.Array, hyps: pa.Array):
    """Slices of rows with ``WORDS`` words or one row."""
    sizes = np.cumsum(refs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + hyps.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(refs):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + WORDS)))
        yield refs.slice(at, stop - at), hyps.slice(at, stop - at)
        at = stop


def compared(ref: Column, hyp: Column, most: int = 4, subsequence: bool = False) -> Column:
    """array<long> of a pair of word arrays: matches, n-grams of hyp and of ref for n up to ``most``, and the longest common subsequence, if asked for."""

    def run(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        told = []
        for r, h in _pieces(refs, hyps):
            found = gram_matches(_flat(r), _flat(h), most)
            if subsequence:
                longest = [common_subsequence(a.as_py() or [], b.as_py() or []) for a, b in zip(r, h, strict=True)]
                found = np.column_stack((found, np.array(longest, np.int64)))
            told += found.tolist()
        return pa.array(told, pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")(hashes(ref), hashes(hyp))


def bleu(sums: dict[str, Column], most: int) -> Column:
    """Corpus BLEU x 100 from summed counts m1, t1, m2, ... and lengths r and c; no smoothing."""
    any_zero = F.least(*[sums[f"m{n}"] for n in range(1, most + 1)], F.lit(1)) == 0
    logs = sum((F.log(sums[f"m{n}"] / sums[f"t{n}"]) / most for n in range(1, most + 1)), F.lit(0.0))
    brevity = F.when(sums["c"] >= sums["r"], 0.0).otherwise(1 - sums["r"] / sums["c"])
    return F.when(any_zero, 0.0).otherwise(100 * F.exp(brevity + logs))


def f_score(matches: Column, total: Column) -> Column:
    return F.coalesce(2 * matches / F.nullif(total, F.lit(0)), F.lit(0.0))


def text_scores(rows: DataFrame, by: list[str], most: tuple[int, ...] = (2, 4), rouge: tuple[int, ...] = (1, 2), subsequence: bool = True) -> DataFrame:
    """Per group of (ref, hyp word arrays): n, bleu of each of ``most``, rouge of each n and rouge_l, all x 100, from one pass and one aggregate."""
    deep = max((*most, *rouge, 1))
    k = F.col("k")
    told = rows.select(*by, F.size("ref").alias("r"), F.size("hyp").alias("c"), compared(F.col("ref"), F.col("hyp"), deep, subsequence).alias("k"))
    sums = [F.sum(c).alias(c) for c in ("r", "c")] + [F.sum(k[3 * n - 3 + i]).alias(f"{x}{n}") for n in range(1, deep + 1) for i, x in enumerate("mt")]
    means = [(100 * F.avg(f_score(k[3 * n - 3], k[3 * n - 2] + k[3 * n - 1]))).alias(f"rouge{n}") for n in rouge]
    means += [(100 * F.avg(f_score(k[3 * deep], F.col("r") + F.col("c")))).alias("rouge_l")] * subsequence
    out = told.groupBy(*by).agg(F.count("*").alias("n"), *sums, *means)
    cols = {f"{x}{n}": F.col(f"{x}{n}") for n in range(1, deep + 1) for x in "mt"} | {"r": F.col("r"), "c": F.col("c")}
    return out.select(*by, "n", *[bleu(cols, n).alias(f"bleu{n}") for n in most], *[f"rouge{n}" for n in rouge], *["rouge_l"] * subsequence)


def stem(word: Column) -> Column:
    """A word without its plural and its -ed or -ing: the first steps of English suffix stripping."""
    plural = F.when(word.rlike("(sses|ies)$"), F.regexp_replace(word, "(ss|i)es$", "$1")).when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    bare = F.regexp_replace(plural, "^(.*[aeiouy].*)(ed|ing)$", "$1")
    return F.when((bare != plural) & bare.rlike("([^aeiouylsz])\\1$"), F.regexp_replace(bare, "(.)$", "")).otherwise(bare)


def _free_spots(ref: list, hyp: list, fixed: dict[int, int]) -> tuple[dict, dict]:
    """(key -> free ref places, key -> how many free hyp places ask for it) of the keys that both sides have."""
    taken, spots, asked = set(fixed.values()), {}, {}
    for j, x in enumerate(ref):
        if x is not None and j not in taken:
            spots.setdefault(x, []).append(j)
    for i, x in enumerate(hyp):
        if i not in fixed and x in spots:
            asked[x] = asked.get(x, 0) + 1
    return {x: spots[x] for x in asked}, asked


def follow(ref: list, hyp: list, fixed: dict[int, int]) -> dict[int, int]:
    """``fixed`` and the most further matches, in one pass: a match goes on where the last one ended, else it begins where the next
    word follows too, else at the first free place. As many matches as can be, not always in the fewest chunks."""
    spots, _ = _free_spots(ref, hyp, fixed)
    out, used = dict(fixed), set(fixed.values())
    firsts = {x: iter(places) for x, places in spots.items()}
    pairs: dict = {}
    for x, places in spots.items():
        for j in places:
            if j + 1 < len(ref):
                pairs.setdefault((x, ref[j + 1]), []).append(j)
    runs = {k: iter(places) for k, places in pairs.items()}

    def unused(places):
        return next((j for j in places if j not in used), None)

    for i, x in enumerate(hyp):
        if i in fixed or x not in spots:
            continue
        j = out.get(i - 1, -2) + 1
        if not (0 <= j < len(ref) and ref[j] == x and j not in used):
            j = unused(runs.get((x, hyp[i + 1]), ())) if i + 1 < len(hyp) else None
            j = unused(firsts[x]) if j is None else j
        if j is not None:
            out[i] = j
            used.add(j)
    return out


def align(ref: list, hyp: list, fixed: dict[int, int], most: int = 512) -> dict[int, int]:
    """``fixed`` (hyp place -> ref place) and the most further matches of equal keys among the free places, in the fewest chunks.

    Places of hyp are gone through in order; a state is which places of the keys with a choice are used, which keys were left out how
    often, and the last match. If that takes more than ``most`` states, ``follow`` aligns the texts instead.
    """
    spots, asked = _free_spots(ref, hyp, fixed)
    choice = {x for x in spots if len(spots[x]) > 1 or asked[x] > 1}
    if sum(len(spots[x]) for x in choice) > 64:
        return follow(ref, hyp, fixed)
    bit = {j: 1 << k for k, j in enumerate(j for x in choice for j in spots[x])}
    spare = {x: max(0, asked[x] - len(spots[x])) for x in spots}
    last_of = {x: i for i, x in enumerate(hyp) if x in choice and i not in fixed}
    # state: (last ref place or -2, used places as bits, keys left out) -> (chunks, matches as a linked list)
    states: dict = {(-2, 0, ()): (0, None)}
    for i, x in enumerate(hyp):
        after: dict = {}
        over = sum(bit[j] for j in spots[x]) if last_of.get(x) == i else 0  # nothing asks for the key's places again
        for (last, used, left), (count, path) in states.items():
            if i in fixed:
                options = [(fixed[i], used, left, path)]
            elif x not in spots:
                options = [(-2, used, left, path)]
            else:
                options = [(j, used | bit.get(j, 0), left, (i, j, path)) for j in spots[x] if not used & bit.get(j, 0)]
                if left.count(x) < spare[x]:
                    options.append((-2, used, tuple(sorted((*left, x), key=str)), path))
            for j, now, out, way in options:
                state = (j, now & ~over, tuple(y for y in out if y != x) if over else out)
                cost = count + (j >= 0 and j != last + 1)
                if state not in after or cost < after[state][0]:
                    after[state] = (cost, way)
        if len(after) > most:
            return follow(ref, hyp, fixed)
        states = after
    out, path = dict(fixed), min(states.values(), key=lambda s: s[0])[1]
    while path is not None:
        out[path[0]] = path[1]
        path = path[2]
    return out


def chunks(matches: dict[int, int]) -> int:
    return sum(1 for i, j in matches.items() if matches.get(i - 1) != j - 1 or i - 1 not in matches)


def meteor(ref: Column, hyp: Column, synonyms: DataFrame | None = None, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5, most: int = 64) -> Column:
    """METEOR of word arrays: words align if they are equal, then by stem, then by class of ``synonyms`` (a small table (word, class)).

    F is P R / (alpha P + (1 - alpha) R), less gamma (chunks / matches)^beta of it; 0 without a match. Each stage aligns as many of
    the words still free as it can, in the fewest chunks of all matches so far (``align``; texts of many repeated words by ``follow``). A synonym table of more than 100,000 words fails.
    """
    stages = [hashes(ref), hashes(hyp), F.transform(ref, lambda w: F.xxhash64(stem(w))), F.transform(hyp, lambda w: F.xxhash64(stem(w)))]
    if synonyms is not None:
        told = synonyms.select(F.xxhash64("word"), F.xxhash64("class")).limit(100_001).collect()
        if len(told) > 100_000:
            raise ValueError("the synonym table is too large to go along with every task")
        classes = dict(map(tuple, told))
    else:
        classes = {}

    def run(r: pa.Array, h: pa.Array, r_stem: pa.Array, h_stem: pa.Array) -> pa.Array:
        out = []
        for cells in zip(r, h, r_stem, h_stem, strict=True):
            a, b, a_stem, b_stem = (c.as_py() or [] for c in cells)
            found = align(a, b, {}, most)
            if len(found) < min(len(a), len(b)):
                found = align(a_stem, b_stem, found, most)
            if classes and len(found) < min(len(a), len(b)):
                found = align([classes.get(w) for w in a], [classes.get(w) for w in b], found, most)
            if not found:
                out.append(0.0)
                continue
            p, q = len(found) / len(b), len(found) / len(a)
            out.append(p * q / (alpha * p + (1 - alpha) * q) * (1 - gamma * (chunks(found) / len(found)) ** beta))
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(*stages)
