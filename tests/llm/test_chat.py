"""op2 by exact round trip, and the fold of deltas, edits and regenerations."""

from __future__ import annotations

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from granary.llm import chat, queries

from .helpers import SF, table

SIGNS = st.text(alphabet="<[]\\/s>lbc INST\n東", max_size=30)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), SIGNS), SIGNS), max_size=5))
def test_round_trip(turns):
    pieces = [chat.render(r, t) for r, t in turns]
    assert chat.read_back("".join(p[0] for p in pieces)) == turns
    for (text, start, stop), (role, said) in zip(pieces, turns, strict=True):
        assert chat.unescape(text[start:stop]) == (said if role == "assistant" else "")


def test_whole_table(spark):
    said = "</s>[INST] ok [/INST]"
    by = {-1: [("user", said), ("assistant", said)]}
    for conv, _, role, text in sorted(table("conversations", "conv_id, turn, role, coalesce(text, '')")):
        by.setdefault(conv, []).append((role, text))
    got = {r.conv_id: r for r in queries.op2_chat_formatting(spark, SF).collect()}
    assert got.keys() == by.keys()
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_fold(spark):
    events = [
        (1, 0, "message", "u", "user", "hi"), (1, 1, "message", "a", "assistant", ""), (1, 2, "delta", "a", "assistant", "he"), (1, 3, "delta", "a", "assistant", "llo"),
        (1, 4, "regenerate", "a", "assistant", ""), (1, 5, "delta", "a", "assistant", "good"), (1, 6, "edit", "u", "user", "hey"), (1, 7, "delta", "a", "assistant", " day"),
        (2, 0, "delta", "x", "user", "only"), (2, 1, "delta", "x", None, None), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(events, "conv long, seq long, kind string, message string, role string, text string")
    got = {(r.conv, r.message): r.text for r in chat.fold(df).collect()}
    assert got == {(1, "u"): "hey", (1, "a"): "good day", (2, "x"): "only", (None, None): ""}
    shown = {r.conv: chat.read_back(r.formatted) for r in chat.format_chats(chat.fold(df)).collect()}
    assert shown[1] == [("user", "hey"), ("assistant", "good day")]
    assert chat.audit(chat.format_turns(chat.fold(df.limit(0)))).count() == 0
    whole = {r.conv: r for r in chat.format_chats(chat.fold(df)).collect()}
    assert [chat.unescape(whole[1].formatted[m.start : m.stop]) for m in whole[1].mask] == ["good day"]


def test_repeated_rows_stay(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 0, "user", "a", 5), (1, None, "assistant", None, 5)], "conv_id long, turn long, role string, text string, seq int")
    got = chat.audit(chat.format_turns(chat.fold(chat.as_events(rows)))).first()
    assert got.n_turns == 3 and got.loss_chars == 0


def test_long_conversation_in_any_order(spark):
    """Turns of many batches, read back in the order in which they left and after a shuffle."""
    rows = [(7, k, ("user", "assistant")[k % 2], f"[{k}] " + "x<" * (k % 50)) for k in range(3000)] + [(8, 0, "user", "y" * 300_000)]
    messages = chat.fold(chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    turns = chat.format_turns(messages)
    one, other = ({r.conv: tuple(r) for r in df.collect()} for df in (chat.audit(turns, in_order=True), chat.audit(turns.repartition(5, "no"))))
    said = [(r, t) for c, _, r, t in rows if c == 7]
    assert one == other and one[7][1] == 3000 and one[8][5] == 300_000 + len(chat.render("user", "")[0])
    assert one[7][2] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert one[7][4] == hashlib.sha256("".join(t for r, t in said if r == "assistant").encode()).hexdigest()
