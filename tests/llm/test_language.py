import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import language
from tabularium.llm.tokens import public_vocabulary

VOCABULARY = public_vocabulary("piece_bpe_32k.model")


PIECES = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5}
P = {0: 0.1, 1: 0.2, 2: 0.15, 3: 0.25, 4: 0.05, 5: 0.25}


def segmentations(word, pieces):
    """Every way to cut the word into pieces, as lists of piece numbers; None stands for an uncovered letter."""
    if not word:
        return [[]]
    found = []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            found += [[pieces.get(word[:n]), *rest] for rest in segmentations(word[n:], pieces)]
    return found


def probability(ids, p):
    return math.prod(language.UNKNOWN if i is None else p[i] for i in ids)


def logs(words, pieces, languages):
    known = language.Lattice(pieces)
    return language.word_logs(words, known, language.columns_of(languages, known))


def test_forward_sums_all_segmentations():
    other = {**P, 1: 0.01, 5: 0.3}
    words = ["abba", "b", "abxba", "ab", "aaaaaaaaaaab", "x"]
    out = logs(words, PIECES, [P, other])
    for word, row in zip(words, out):
        for p, found in zip((P, other), row):
            assert found == pytest.approx(math.log(sum(probability(ids, p) for ids in segmentations("▁" + word, PIECES))))


def test_expected_counts_run_over_all_segmentations():
    words, p = collections.Counter({"abba": 3, "ab": 1, "xab": 2, "babab": 5}), dict.fromkeys(PIECES.values(), 1 / len(PIECES))
    for _ in range(2):
        expected = dict.fromkeys(PIECES.values(), 0.01)
        for word, count in words.items():
            ways = segmentations("▁" + word, PIECES)
            whole = sum(probability(ids, p) for ids in ways)
            for ids in ways:
                for i in ids:
                    if i is not None:
                        expected[i] += count * probability(ids, p) / whole
        p = {i: x / sum(expected.values()) for i, x in expected.items()}
    assert language.fit_language(words, language.Lattice(PIECES), rounds=2) == pytest.approx(p)


def test_very_long_words_do_not_underflow():
    out = logs(["a" * 5000, "b", "x" * 3000], {"▁": 0, "a": 1}, [{0: 1e-3, 1: 1e-3}, {0: 1e-3, 1: 1e-9}])
    assert out[0] == pytest.approx([5001 * math.log(1e-3), math.log(1e-3) + 5000 * math.log(1e-9)])
    assert out[2] == pytest.approx([math.log(1e-3) + 3000 * math.log(language.UNKNOWN)] * 2)


def plain_fit(words, pieces, rounds):
    """Expectation-maximisation in logarithms, one edge at a time."""
    log = dict.fromkeys(pieces.values(), -math.log(len(pieces)))
    for _ in range(rounds):
        expected = dict.fromkeys(pieces.values(), 0.01)
        for word, count in words.items():
            text = "▁" + word
            edges = [(s, e, pieces[text[s:e]]) for s in range(len(text)) for e in range(s + 1, min(len(text), s + 3) + 1) if text[s:e] in pieces]
            a, b = ([-math.inf] * (len(text) + 1) for _ in range(2))
            a[0] = b[-1] = 0.0
            for s, e, i in edges:
                a[e] = np.logaddexp(a[e], a[s] + log[i])
            for s, e, i in reversed(edges):
                b[s] = np.logaddexp(b[s], b[e] + log[i])
            for s, e, i in edges:
                expected[i] += count * math.exp(a[s] + log[i] + b[e] - a[-1])
        log = {i: math.log(x / sum(expected.values())) for i, x in expected.items()}
    return {i: math.exp(x) for i, x in log.items()}


def test_long_words_are_learned():
    words = collections.Counter({"ab" * 400: 2, "ba" * 30 + "a" * 200: 1, "ab": 5})
    found = language.fit_language(words, language.Lattice(PIECES))
    assert found == pytest.approx(plain_fit(words, PIECES, 3), rel=1e-6)


def test_unspaced_language_is_learned(spark, docs_of):
    rows = [(i, "".join(chr(0x3042 + (7 * i + 3 * j) % 40) for j in range(100)) if i % 2 else f"plain english text number {'abcdefghij'[i % 10]}", "ja" if i % 2 else "en", "a") for i in range(20)]
    model = language.fit(docs_of(rows), VOCABULARY)
    assert sum(p > 0.01 for p in model["ja"].values()) >= 25 and sum(p > 0.01 for p in model["en"].values()) > 5
    texts = docs_of([(1, "あいうえおかきくけこ", None, None), (2, "½ ²", None, None), (3, "①ab½", None, None)])
    out = {r["doc_id"]: r["x"] for r in texts.select("doc_id", language.predict(F.col("text"), model, VOCABULARY, spark).alias("x")).collect()}
    assert out[1]["lang"] == "ja" and (out[2]["lang"], out[2]["score"]) == ("und", 0) and out[3]["lang"] == "en"


def test_query_against_plain_sums(spark, sf, documents):
    """Every prediction of the query, by the plain sum over the words' forward sums, one edge at a time."""
    held_out = language.fold_of(F.col("doc_id"), 4) == 2
    model = language.fit(documents.where(~held_out), VOCABULARY)
    pieces, nodes = {}, language.lattice(VOCABULARY)
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    pieces = {whole.id_to_piece(i): i for i in nodes.numbers}
    longest, names, cache = max(map(len, pieces)), list(model), {}

    def log_of(word):
        if word not in cache:
            cache[word], text = [], "▁" + word
            for p in model.values():
                a = [1.0] + [0.0] * len(text)
                for s in range(len(text)):
                    for e in range(s + 1, min(len(text), s + longest) + 1):
                        if text[s:e] in pieces:
                            a[e] += a[s] * p[pieces[text[s:e]]]
                        elif e == s + 1:
                            a[e] += a[s] * language.UNKNOWN
                cache[word].append(math.log(a[-1]))
        return cache[word]

    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    out = {r["doc_id"]: r for r in language.QUERIES["op10_language_id"](spark, sf).collect()}
    assert len(out) == len(texts)
    for i, text in texts.items():
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        if not words or max(map(len, words)) > 30:
            assert words or out[i]["lang_pred"] == "und"
            continue
        total = [sum(log_of(w)[g] for w in words) for g in range(len(names))]
        best = max(range(len(names)), key=lambda g: total[g])
        score = 1 / sum(math.exp(x - total[best]) for x in total)
        assert out[i]["lang_pred"] == names[best] and out[i]["score"] == pytest.approx(score, rel=1e-6)


def test_held_out_accuracy(spark, sf):
    out = language.QUERIES["op10_language_id"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("i"), "lang")
    rows = out.join(truth, F.col("doc_id") == F.col("i")).where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) and rows


def test_odd_rows(spark, odd, empty, documents):
    model = language.fit(documents, VOCABULARY, docs_per_language=20)
    out = {r["doc_id"]: r["x"] for r in odd.select("doc_id", language.predict(F.col("text"), model, VOCABULARY, spark).alias("x")).collect()}
    assert all(out[i]["lang"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3, 9)) and out[6]["lang"] in model
    kept = language.keep_declared(odd, model, VOCABULARY)
    assert kept.columns == odd.columns and {1, 2, 3, 9}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert language.fit(empty, VOCABULARY) == {}
    assert [r["x"]["lang"] for r in odd.select(language.predict(F.col("text"), {}, VOCABULARY, spark).alias("x")).collect()] == ["und"] * odd.count()
    assert language.keep_declared(empty, model, VOCABULARY).count() == 0
