import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabularium.llm import alignment
from tabularium.llm.tokens import _bytes_of, public_vocabulary

A, B = public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model")
WHOLE = Tokenizer.from_file(A)
WHOLE.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
BYTE = _bytes_of()
NAMES = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    "", None, "a", " lead and  two   three spaces ", "tab\tand\nline \n end", "▁ mark ▁▁ here", "x▁y", "<s> </s> <|endoftext|> <0x41>", "ñandú über ça — 日本語 の \U0001f600 text",
    "nbsp here 　 wide   em \x85 next \x1c file", "nul\x00 in it", "it's we'll CAN'T 12345 1 2 3", "same same same same", "ﬁ ｆｕｌｌ", "é combining", "…", "a b c d e f",
    "the theory of the thing", "x" * 3000, " " * 2000 + "z", "word " * 3000, "é à ü ", "a é", "é a", "Слово и дело",
]


def tokens(text):
    """(id, start, stop) lists of the whole text by both tokenizers, or None without tokens."""
    if not text:
        return None
    said = (" " + text).encode()
    both = []
    ids = WHOLE.encode(" " + text, add_special_tokens=False).ids
    parts = [(i, bytes(BYTE[c] for c in WHOLE.id_to_token(i))) for i in ids]
    pieces = [(i, PIECES.id_to_piece(i)) for i in PIECES.encode(text)]
    named = [(i, bytes([int(p[3:5], 16)]) if PIECES.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
    for side in (parts, named):
        if b"".join(t for _, t in side) != said:
            return None
        at, laid = 0, []
        for i, token in side:
            laid.append((i, at, at + len(token)))
            at += len(token)
        both.append(laid)
    return both


def brute(docs):
    held = [(i, tokens(text)) for i, text in docs]
    pairs = Counter((x[0], y[0]) for _, both in held if both for x in both[0] for y in both[1] if x[2] == y[2])
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, both in held:
        if not both:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = both
        links = [(x[0], y[0]) for x in a for y in b if x[2] == y[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        said = [",".join(str(t[0]) for t in a if lo < t[2] <= hi) + "|" + ",".join(str(t[0]) for t in b if lo < t[2] <= hi) for lo, hi in zip([0, *ends], ends)]
        out.append((i, len(a), len(b), len(ends), len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(";".join(said).encode()).hexdigest()))
    return pairs, sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


@pytest.mark.parametrize("batch_bytes", [alignment.BATCH_BYTES, 40])
def test_hard_texts_equal_plain_pairs(spark, batch_bytes):
    docs = [(i, t[:400] if t else t) for i, t in enumerate(HARD)] + [(3, HARD[3]), (None, "the theory"), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, piece string, n_a int")
    counted, want = brute(docs)
    assert rows_of(alignment.align(df, A, B, batch_bytes=batch_bytes)) == want
    assert {(r["a"], r["b"]): r["n"] for r in alignment.pairs(df, A, B, batch_bytes=batch_bytes).collect()} == dict(counted)
    assert len(counted) <= alignment.pair_bound(A, B)


def test_long_texts_have_the_whole_texts_tokens(spark):
    for text in HARD[18:21]:
        row = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
        assert (row["n_a"], row["n_b"]) == (len(WHOLE.encode(" " + text, add_special_tokens=False).ids), len(PIECES.encode(text)))


def test_query_over_the_documents(spark, sf, documents):
    few = {r["doc_id"]: r["text"] for r in documents.collect() if len(r["text"]) < 1500}
    out = {r["doc_id"]: r for r in alignment.op12_token_alignment(spark, sf).collect()}
    assert len(out) == documents.count()
    for i, text in list(few.items())[:60]:
        _, [(_, n_a, n_b, n_groups, n_links, _, _, said)] = brute([(i, text)])
        assert (n_a, n_b, n_groups, n_links, said) == tuple(out[i][n] for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"))


def test_overlaps(spark):
    docs = [(i, t[:200]) for i, t in enumerate(HARD) if t]
    want = Counter()
    for _, text in docs:
        both = tokens(text)
        want.update((x[0], y[0]) for x in (both or [[], []])[0] for y in both[1] if x[1] < y[2] and y[1] < x[2])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["a"], r["b"]): r["n"] for r in alignment.pairs(df, A, B, link="overlap").collect()} == dict(want)
    with pytest.raises(ValueError):
        alignment.pairs(df, A, B, link="near")


def test_odd_rows_and_empty_tables(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 5]
    assert rows_of(alignment.align(odd.where("doc_id IS NULL OR doc_id <> 5"), A, B)) == brute(rows)[1]
    assert alignment.align(empty, A, B).count() == 0 and alignment.pairs(empty, A, B).count() == 0


CHARACTERS = st.sampled_from([" ", "  ", "\n", "\t", " ", "　", " ", "\x85", "\x1c", "▁", "a", "the", "'s", "Z", "1", "é", "ü", "ß", "日", "\U0001f600", "\x00", "<s>", "<|endoftext|>", ".", ",", "́", "­", "​"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(CHARACTERS, max_size=14).map("".join), max_size=4))
def test_pieces_give_what_whole_texts_give(texts):
    texts = [t for t in texts if t]
    if not texts:
        return
    known = alignment.Known(*alignment.sides(A, B), "end")
    rows = alignment.aligned([t.encode() for t in texts], known)
    for n, text in enumerate(texts):
        [(_, n_a, n_b, n_groups, n_links, _, _, said)] = brute([(0, text)])[1]
        assert (n_a, n_b, n_groups, n_links, said) == tuple(rows[name][n] for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"))
        assert dict(zip(rows["pairs"][n].tolist(), rows["times"][n].tolist())) == {a << 32 | b: k for (a, b), k in brute([(0, text)])[0].items()}


def test_a_worker_forgets_and_starts_anew(monkeypatch):
    texts = [f"word{i} other{i % 3} {'long' * (i % 4)}".encode() for i in range(40)]
    sides = alignment.sides(A, B)
    want = alignment.aligned(texts, alignment.Known(*sides, "end"))
    monkeypatch.setattr(alignment, "KNOWN", 7)
    known = alignment.Known(*sides, "end")
    for n, text in enumerate(texts):
        rows = alignment.aligned([text], known)
        assert all(np.array_equal(rows[name][0], want[name][n]) for name in rows) and len(known.place) <= 7
