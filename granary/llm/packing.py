"""Sequence packing: shortest-pack-first over the length histogram, patterns joined back to pieces by rank.

Each document becomes token ids by a public byte-level BPE (the vocabulary's special strings in texts become their ids, as
the ``tokenizers`` library reads them by default), then ``end_id``. It is cut into full pieces of ``capacity`` and one
remainder. The driver sees the histogram only, ``capacity`` lengths at most: it places lengths longest first, each into the
shortest pack that exists, as counts of packing patterns; their number depends on the lengths, not on the rows (2,700 for
50,000 as for 5 million pieces), so the table of their places is broadcast. Pieces get their rank within their length, in
windows of ``RANKED`` rows or so, however many pieces a length has, and the patterns turn (length, rank) into (sequence, offset).

Cases: null texts are empty and give the end id alone; repeated rows and ids are packed as rows of their own; a null id
is kept as it is; ties of a length are ordered by id, start and content; a very long text is many full pieces; further
columns aren't read; an empty table gives none.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import stored

#: Pieces of one length that a window ranks, about.
RANKED = 8192
#: Ids of strings that aren't ordinary text: fixed values of the public vocabulary.
SPECIAL = {"byte_bpe_50k": {"<|endoftext|>": 50256}}
#: Words whose ids a worker remembers at most (some 200 bytes each); then it begins anew, with the words that come next.
REMEMBERED = 200_000


def tiktoken_encoding(vocabulary: str, pattern: str, ranks: dict[bytes, int]):
    """text -> list of its ids, special strings read as ordinary text."""
    import tiktoken

    return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@cache
def encoder(vocabulary: str = "byte_bpe_50k"):
    """text -> its ids as little-endian 32-bit bytes, for a vocabulary of public_tokenizers; equal to ``tokenizers`` on its JSON file.

    A word after one space is cut by the pattern alone, whatever stands around it, so its ids are remembered. The words of a text
    that aren't known are encoded in one call: the first token of each, and no other, begins with a space.
    """
    import public_tokenizers

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    plain = tiktoken_encoding(vocabulary, public_tokenizers.PATTERN, ranks)
    known: dict[str, bytes] = {}
    begins = np.zeros(max(ranks.values()) + 1, bool)
    begins[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True

    special = SPECIAL.get(vocabulary, {})
    marks = re.compile("|".join(map(re.escape, special))) if special else None

    def ids(text: str) -> bytes:
        return np.array(plain(text), "<u4").tobytes()

    def encode(text: str) -> bytes:
        out, at = [], 0
        for m in marks.finditer(text) if marks and "<|" in text else ():
            out += [ordinary(text[at : m.start()]), special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, ordinary(text[at:])]) if at else ordinary(text)

    def ordinary(text: str) -> bytes:
        first, *parts = text.split(" ")
        if not parts:
            return ids(text) if text else b""
        if not first or first[-1].isspace():
            return ids(text)
        out = list(map(known.get, parts))
        if None in out:
            new = list(dict.fromkeys(part for part, found in zip(parts, out, strict=True) if found is None))
            if any(not part or part[0].isspace() or part[-1].isspace() for part in new):
                return ids(text)
            data = ids(" " + " ".join(new))
            starts = (4 * np.flatnonzero(begins[np.frombuffer(data, "<u4")])).tolist()
            told = dict(zip(new, (data[i:j] for i, j in zip(starts, [*starts[1:], len(data)], strict=True)), strict=True))
            if len(known) + len(told) > REMEMBERED:
                known.clear()
            known.update(told if len(told) <= REMEMBERED else {})
            out = [told[part] if found is None else found for part, found in zip(parts, out, strict=True)]
        return b"".join([ids(first), *out])

    return encode


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k", end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids binary of little-endian 32-bit ids]): full pieces and a remainder."""
    last = int(end_id).to_bytes(4, "little")
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def run(batches):
        encode = encoder(vocabulary)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = encode(text.as_py() or "") + last
                total = len(data) // 4
                for start in range(0, total, capacity):
                    part = data[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), total, part if with_ids else None), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Shortest-pack-first: [(pattern {length: copies} in order of placing, packs)]; lengths longest first, as counts.

    All packs of one used length are taken together: as many as there are pieces left go on, the others stay.
    """
    by_used: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            used = min(by_used, default=capacity)
            if used + length > capacity:
                fit = capacity // length
                for copies in {fit, left % fit}:
                    packs = left // fit if copies == fit else 1
                    if copies and packs:
                        by_used.setdefault(copies * length, []).append(({length: copies}, packs))
                        left -= copies * packs
                continue
            pattern, packs = by_used[used].pop()
            if not by_used[used]:
                del by_used[used]
            fit = (capacity - used) // length
            copies = max(1, min(fit, left // packs))
            taken = min(packs, left // copies)
            if taken < packs:
                by_used.setdefault(used, []).append((pattern, packs - taken))
            by_used.setdefault(used + copies * length, []).append((pattern | {length: copies + pattern.get(length, 0)}, taken))
            left -= copies * taken
    return [p for used in sorted(by_used) for p in by_used[used]]


def _slots(packed: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset, copies) of every place of every pattern."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, packs in packed:
        offset = 0
        for length, copies in pattern.items():
            first = ranks.get(length, 0)
            ranks[length] = first + packs * copies
            rows.append((length, first, ranks[length], sequence, offset, copies))
            offset += length * copies
        sequence += packs
    return rows


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Stored pieces -> the same rows with (sequence_id, offset): sequences are filled gapless from 0 and hold ``capacity`` at most."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    salts = F.broadcast(spark.createDataFrame([(n, -(-count // RANKED)) for n, count in sorted(histogram.items())], "length int, _salts int"))
    slot = F.broadcast(spark.createDataFrame(_slots(patterns(histogram, capacity)), "length int, _first long, _stop long, _sequence long, _offset long, _copies long"))
    salted = parts.join(salts, "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("_salts")).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "bases")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    ranked = ranked.join(base, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    placed = ranked.join(slot, "length").where("_rank >= _first and _rank < _stop")
    at = F.col("_rank") - F.col("_first")
    return placed.select(*parts.columns, (F.col("_sequence") + F.floor(at / F.col("_copies"))).cast("long").alias("sequence_id"), (F.col("_offset") + at % F.col("_copies") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k", end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole documents; pad a sequence to ``capacity`` unless its length is a power of two."""
    return pack(stored(pieces(docs, capacity, vocabulary, end_id, with_ids, id_col, text_col), "pieces"), capacity)
