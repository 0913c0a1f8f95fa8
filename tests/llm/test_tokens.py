import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tabularium.llm import chat, packing, tokens

PATH = tokens.public_vocabulary("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ADDED = "a <|endoftext|> b"
SPACES = "x" + " " * 1_200_000 + "y"


def ids_of(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def test_added_tokens_and_long_runs():
    encode = tokens.encoder(PATH).encode_ordinary
    assert encode(ADDED) == [64, 220, 50256, 275] == ids_of(ADDED)
    assert len(encode(SPACES)) == 1_200_001


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "'s", "'LL", " ", "\n", "\t", " ", "　", "é", "a", "Z", "1", "²", "日", "\U0001f600", "\x00", "\x1c", "\x85"]) | st.text(max_size=5), max_size=20).map("".join))
def test_same_ids_as_the_tokenizer(text):
    assert tokens.encoder(PATH).encode_ordinary(text) == ids_of(text)


def test_every_character_splits_alike():
    encode = tokens.encoder(PATH).encode_ordinary
    assert tokens.encoder(PATH)._ranked is not None
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4000):
        text = "".join(f"a{c}1{c}  {c}" for c in points[i : i + 4000])
        assert all(encode(part) == ids_of(part) for part in (text[a : a + 50_000] for a in range(0, len(text), 50_000)))


@pytest.mark.parametrize("stage", ["op6", "pipeline"])
def test_pieces_hold_the_tokenizers_ids(spark, docs_of, tmp_path, stage):
    docs = docs_of([(1, ADDED, "en", "a"), (2, SPACES, "en", "a"), (3, "plain", "en", "a")], extra=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    packed = packing.op6_best_fit_packing(spark, str(tmp_path)) if stage == "op6" else corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
    rows = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packed.collect()}
    whole = {i: [*ids_of(t), 0] for i, t in ((1, ADDED), (2, SPACES), (3, "plain"))}
    assert rows == {(i, n): (a, k, zlib.crc32(np.array(ids[a : a + k], "<u4").tobytes())) for i, ids in whole.items() for n, (a, k) in enumerate(packing.cuts(len(ids), 2048))}


def test_chat_counts(spark):
    df = spark.createDataFrame([(1, 0, "user", SPACES), (2, 0, "user", ADDED)], "conv_id long, turn long, role string, text string")
    laid = {r["conv"]: (r["n_tokens"], r["text"]) for r in chat.windows(df, PATH).collect()}
    assert all(n == len(ids_of(text)) for n, text in laid.values())


def test_op7_takes_the_whole_tokenizer(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", SPACES)], "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    assert {r["conv_id"]: r["n_turns"] for r in chat.op7_chat_windows(spark, str(tmp_path)).collect()} == {1: 1, -7: 2}
