"""Chat formatting by event-sourced reconstruction.

An event is (conv, seq, kind, message, role, text). ``message`` starts a message with its text, ``delta`` appends to it,
``edit`` replaces its text and ``regenerate`` drops it to start over (text, possibly empty). Each message is folded by
itself, with sorted windows and one aggregate, so a long conversation is many small groups. Rendering streams the messages of a
partition in order of conversation and place and writes a row per turn, so a task holds a batch of messages and never a conversation.

The template writes a turn as ``<s>[ROLE] text [/ROLE]</s>``. Control strings hold ``<`` or ``[``; inside texts and roles
these two and the escape sign are escaped as two signs each, so no text can close or open a turn and reading back is exact.
The loss mask covers the escaped text of assistant turns.

Cases: null texts and roles count as empty; null conversations form one of their own, null sequence numbers come first;
ties of seq are ordered by kind, text and role; events that follow no ``message`` event open the message. Identical events of one
message are folded each, and identical rows of a turn table are turns of their own. A very long message is held whole, one at a
time. Only the named columns are read, so others never clash. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import shuffle_width

ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {v: k for k, v in ESCAPES.items()}
_ESCAPE = re.compile(r"[\\<\[]")
_UNESCAPE = re.compile(r"\\[\\lb]")
TURN = re.compile(r"<s>\[([^<\[\]]*)\] ([^<\[]*) \[/\1\]</s>")
_ROLE = re.compile(r"[\\<\[\]]")
_ROLE_BACK = re.compile(r"\\[\\lbc]")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[0]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and stop of its loss mask in it)."""
    name = _ROLE.sub(lambda m: "\\c" if m[0] == "]" else ESCAPES[m[0]], role)
    head = f"<s>[{name}] "
    body = escape(text)
    stop = len(head) + len(body)
    return f"{head}{body} [/{name}]</s>", len(head) if role == "assistant" else stop, stop


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; fails on anything between turns."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        out.append((_ROLE_BACK.sub(lambda x: "]" if x[0] == "\\c" else _BACK[x[0]], m[1]), unescape(m[2])))
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return out


def fold(events: DataFrame) -> DataFrame:
    """(conv, seq, kind, message, role, text) -> (conv, message, place, role, text): the final messages.

    ``place`` is the seq of a message's first event. Only the events from the last that sets the text on are joined.
    """
    one = Window.partitionBy("conv", "message")
    upto = one.orderBy(F.col("seq").asc_nulls_first(), "kind", "text", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clean = events.select("conv", "message", F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = clean.withColumn("k", F.count("*").over(upto))
    last = F.max(F.when(F.col("kind") != "delta", F.col("k"))).over(one)
    live = numbered.withColumn("last", F.coalesce(last, F.lit(0))).withColumn("place", F.min("seq").over(one))
    parts = F.sort_array(F.collect_list(F.when(F.col("k") >= F.col("last"), F.struct("k", "text"))))
    return live.groupBy("conv", "message").agg(F.first("place").alias("place"), F.max_by("role", "k").alias("role"), F.array_join(F.transform(parts, lambda p: p.text), "").alias("text"))


def as_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A turn table as an event log with one ``message`` event for each distinct row; rows of one turn are messages of their own."""
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(role), F.lit(""))
    copy = F.row_number().over(Window.partitionBy(conv, turn, role, F.xxhash64(text)).orderBy(F.lit(0)))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("seq"), F.lit("message").alias("kind"), F.concat_ws(":", F.coalesce(F.col(turn).cast("string"), F.lit("")), name, F.sha2(body, 256), copy.cast("string")).alias("message"), name.alias("role"), body.alias("text"))


def format_turns(messages: DataFrame) -> DataFrame:
    """(conv, no, at, formatted, start, stop): a row per turn, rendered in order of place.

    ``at`` is where the turn starts in its conversation, ``start`` to ``stop`` its loss mask inside the turn. A task holds a batch of
    turns and a running offset, however long a conversation is; turns leave in order.
    """
    names = ["conv", "no", "at", "formatted", "start", "stop"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        conv, no, at = None, -1, 0
        for b in batches:
            out: list[list] = [[] for _ in names]
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if no < 0 or c != conv:
                    conv, no, at = c, 0, 0
                piece, start, stop = render(role, text)
                for column, value in zip(out, (conv, no, at, piece, start, stop), strict=True):
                    column.append(value)
                no += 1
                at += len(piece)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    order = ["conv", F.col("place").asc_nulls_first(), "role", "text"]
    dealt = messages.repartition(shuffle_width(messages.sparkSession), "conv").sortWithinPartitions(*order)
    return dealt.select(F.col("conv").cast("long"), "role", "text").mapInArrow(run, "conv long, no long, at long, formatted string, start long, stop long")


def format_chats(messages: DataFrame) -> DataFrame:
    """(conv, formatted, mask array<struct<start, stop>>): conversations as one string each, for consumers that need them whole."""
    parts = F.array_sort(F.collect_list(F.struct("no", "formatted", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("stop")).alias("stop"), (F.col("formatted").startswith("<s>[assistant] ")).alias("loss"))))
    told = format_turns(messages).groupBy("conv").agg(parts.alias("parts"))
    mask = F.transform(F.filter("parts", lambda p: p.loss), lambda p: F.struct(p.start.alias("start"), p.stop.alias("stop")))
    return told.select("conv", F.array_join(F.transform("parts", lambda p: p.formatted), "").alias("formatted"), mask.alias("mask"))


def audit(turns: DataFrame, in_order: bool = False) -> DataFrame:
    """Per conversation, read back from formatted turns: (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Digests are taken as turns come, one at a time. ``in_order`` says that each conversation comes in order in one task, as it
    leaves ``format_turns``; else turns are sorted first.
    """
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        conv, held, out = None, None, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

        for b in batches:
            for c, text, start, stop in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held is None or c != conv:
                    if held is not None:
                        out.append((conv, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]))
                    conv, held = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    held[0] += 1
                    held[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(text[start:stop])
                held[2] += len(loss)
                held[3].update(loss.encode("utf-8", "surrogatepass"))
                held[4] += len(text)
            if len(out) > 1000:
                yield batch()
                out.clear()
        if held is not None:
            out.append((conv, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]))
        yield batch()

    ready = turns if in_order else turns.repartition(shuffle_width(turns.sparkSession), "conv").sortWithinPartitions("conv", "no")
    return ready.select("conv", "formatted", "start", "stop").mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
