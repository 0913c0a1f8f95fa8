import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabularium.llm import packing
from tabularium.llm.tokens import encoder, public_vocabulary

VOCABULARY = public_vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_both_libraries_give_the_same_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_both_libraries_give_the_same_ids, "t") else test_both_libraries_give_the_same_ids.t
    test_both_libraries_give_the_same_ids.t = t
    assert encoder(VOCABULARY).encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


def check(rows, documents, tokenizer, capacity=2048):
    ids = {}
    for i, text in documents:
        whole = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        ids.setdefault((i, len(whole), zlib.crc32(np.array(whole, "<u4").tobytes())), []).append(whole)
    bins = {}
    for r in rows:
        assert r["length"] > 0 and (r["piece"] > 0 or r["start"] == 0)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    expected = sorted(
        (i is None, i or 0, n, start, length, zlib.crc32(np.array(whole[start : start + length], "<u4").tobytes()))
        for (i, *_), wholes in ids.items() for whole in wholes for n, (start, length) in enumerate(packing.cuts(len(whole), capacity))
    )
    assert sorted((r["id"] is None, r["id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    return len(bins), sum(x[4] for x in expected)


def test_documents(documents, tokenizer):
    rows = packing.pack(documents, VOCABULARY, leaf_pieces=30).collect()
    n, total = check(rows, [(r["doc_id"], r["text"]) for r in documents.collect()], tokenizer)
    assert n <= 1.03 * -(-total // 2048) + 1


def test_odd_rows_and_small_groups(odd, empty, tokenizer):
    rows = packing.pack(odd, VOCABULARY, leaf_pieces=2, group_bins=2).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], tokenizer)
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_sequences_hold_their_ids(odd, tokenizer):
    packed = packing.pack(odd, VOCABULARY, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in rows) == packed.agg(F.sum("length")).first()[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_best_fit(sizes):
    where, offset, fills = packing.best_fit(np.array(sizes, np.int64), 100)
    seen = {}
    for b, o, s in zip(where.tolist(), offset.tolist(), sizes):
        seen.setdefault(b, []).append((o, s))
    for b, parts in seen.items():
        end = 0
        for o, s in sorted(parts):
            assert o == end
            end += s
        assert end == fills[b] <= 100
    assert len(fills) <= 1.25 * -(-sum(sizes) // 100) + 1 or sum(s > 50 for s in sizes) >= len(fills) - 1
