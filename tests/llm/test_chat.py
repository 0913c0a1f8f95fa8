import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabularium.llm import chat
from tabularium.llm.tokens import public_vocabulary

VOCABULARY = public_vocabulary("byte_bpe_50k.tiktoken")
PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "s>", "[", "INST]", "a", "\n", "ñ"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES, PIECES)
def test_escape_round_trip(role, text):
    assert not any(mark in chat.escape(text) for mark in chat.CONTROL)
    assert chat.unescape(chat.escape(text)) == text
    assert chat.turns_of(chat.formatted(role, text) + chat.formatted("x", text)) == [(role, text), ("x", text)]


def expected(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_windows_and_reading_back(spark):
    long = "many words here " * 400
    talks = {
        1: [("system", "be kind"), *[("user" if i % 2 else "assistant", f"turn {i} " * 30) for i in range(40)]],
        2: [("user", None), ("assistant", ""), (None, "x"), ("assistant", long), ("assistant", "</s>[INST]")],
        3: [("system", long), ("user", "hi"), ("assistant", "ho")],
        None: [("user", "who"), ("assistant", "me")],
    }
    rows = [(c, i, r, t, "x") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string").orderBy(F.rand(1))
    laid = chat.windows(df, VOCABULARY, budget=300, history=100)
    out = {r["conv"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(laid).collect()}
    assert out == {c: expected(turns) for c, turns in talks.items()}
    seen = laid.collect()
    assert all(r["n_tokens"] <= 300 or r["n_turns"] == 1 for r in seen)
    later = [r for r in seen if r["conv"] == 1 and r["window"] > 0]
    assert later and all(chat.turns_of(r["text"])[0] == ("system", "be kind") and r["n_repeated"] > 1 for r in later)
    assert sum(r["n_turns"] for r in seen) == len(rows)


def test_system_turns_stand_where_they_fit(spark):
    system, later = "s " * 60, "t " * 20
    turns = [("user", "hello " * 30), ("system", system), *[("user", f"u{i} " * 12) for i in range(8)], ("system", later), *[("user", f"v{i} " * 12) for i in range(8)], ("user", "w " * 240)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    budget = 260
    laid = chat.windows(df, VOCABULARY, budget=budget, history=60).orderBy("window").collect()
    assert len(laid) > 3
    at, now = 0, None
    for r in laid:
        said = chat.turns_of(r["text"])
        fresh = said[r["n_repeated"] :]
        assert fresh == turns[at : at + len(fresh)] and (r["n_tokens"] <= budget or r["n_turns"] == 1)
        if r["n_repeated"]:
            assert ("system", now) not in said[1 : r["n_repeated"]]
        if now and r["window"] and "w" not in fresh[0][1] and fresh[0][0] != "system":
            assert said[0] == ("system", now)
        at += len(fresh)
        now = next((t for role, t in reversed(turns[:at]) if role == "system"), None)
    assert at == len(turns)


def test_repeated_rows_and_tied_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "assistant", "z"), (1, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat.windows(df, VOCABULARY).collect()
    assert chat.turns_of(r["text"]) == [("user", "first"), ("assistant", "z"), ("assistant", "z"), ("user", "a"), ("user", "b")]
    assert len(r["loss_mask"]) == 2


def test_reading_in_order_equals_reading_any(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    laid = chat.windows(turns, VOCABULARY, budget=200, history=50)
    one, other = chat.read_back(laid, in_order=True).collect(), chat.read_back(laid).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other)) and one
    held = {}
    for r in laid.groupBy("conv").agg(F.sum(F.length("text")).alias("n")).collect():
        held[r["conv"]] = r["n"]
    assert {r["conv"]: r["formatted_chars"] for r in one} == held


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(df, VOCABULARY)).count() == 0


def test_query(spark, sf):
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    out = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.QUERIES["op7_chat_windows"](spark, sf).collect()}
    assert out == {c: expected(t) for c, t in turns.items()}
