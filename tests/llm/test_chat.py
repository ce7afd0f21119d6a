from __future__ import annotations

import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyquarry.llm import chat

PIECES = st.lists(st.one_of(st.sampled_from([*chat.CONTROLS, "\\", "<\\s>", "[\\\\INST]", "<", "|end|>"]), st.text(max_size=4)), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES)
def test_round_trip(role, text):
    piece, a, b = chat.format_turn(role, text)
    assert chat.parse_turn(piece)[:2] == (role, text)
    assert chat.unescape(piece[a:b]) == text
    assert chat.unescape(chat.escape(text)) == text


def test_plain_text_is_not_escaped():
    assert chat.format_turn("user", "a < b [c] \\n")[0] == "<|turn|>user<|text|>a < b [c] \\n<|end|>"
    with pytest.raises(chat.Malformed):
        chat.parse_turn("<|turn|>user<|text|>a")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4), st.integers(1, 40))
def test_a_conversation_is_parsed_as_one_stream(turns, step):
    text = chat.OPEN + "".join(chat.format_turn(r, t)[0] for r, t in turns) + chat.CLOSE
    assert chat.parse(text) == turns
    own, got = chat.Parser(), []
    for i in range(0, len(text), step):
        for r, t, begin, body in own.feed(text[i : i + step]):
            assert text[begin : begin + len(body)] == body
            got.append((r, t))
    own.close()
    assert got == turns


def test_the_outer_rule():
    turn = chat.format_turn("user", "x")[0]
    for bad in (turn, chat.OPEN + turn, chat.OPEN + turn + chat.CLOSE + turn, chat.OPEN + "x" + chat.CLOSE, chat.OPEN + chat.OPEN + chat.CLOSE, chat.OPEN + turn[:-1] + chat.CLOSE, chat.OPEN + turn + chat.CLOSE + " ", ""):
        with pytest.raises(chat.Malformed):
            chat.parse(bad)


def test_rows(spark):
    data = [(1, 2, "assistant", "two", 9), (1, 1, "user", None, 9), (1, 2, "assistant", "two", 9), (1, 2, None, "</s>", 9), (None, 1, "user", "x", 9), (2, None, "assistant", "[INST]", 9), (2, 5, "assistant", "é" * 5000, 9)]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, piece int")
    got = {r.conv_id: r for r in chat.read_back(chat.rendered(chat.format_conversations(df))).collect()}
    want = "user\n\n" + "\n</s>\n" + "assistant\ntwo\n" * 2
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].n_turns == 4
    assert (got[1].loss_chars, got[1].loss_sha256) == (6, hashlib.sha256(b"twotwo").hexdigest())
    assert got[2].loss_chars == 5006 and got[None].n_turns == 1 and got[None].loss_chars == 0
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.rendered(chat.format_conversations(empty))).collect() == []


def test_planted_conversation_and_sql(spark, sf_dir):
    got = {r.conv_id: r for r in chat.query(spark, sf_dir).collect()}
    assert got[-7].loss_chars == len(chat.PLANTED) and got[-7].n_turns == 2
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    want = {r[0]: r for r in con.execute(chat.ORACLE).fetchall()}
    assert {k: tuple(v) for k, v in got.items()} == want
