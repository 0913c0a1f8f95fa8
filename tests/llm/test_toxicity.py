import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import toxicity


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    out = toxicity.QUERIES["op5_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("i"), "toxic")
    rows = out.join(labels, F.col("doc_id") == F.col("i")).where("held_out").collect()
    pos = np.array([r["score"] for r in rows if r["toxic"]])
    neg = np.array([r["score"] for r in rows if not r["toxic"]])
    assert len(pos) and len(neg) and np.mean(pos[:, None] > neg[None, :]) > 0.95
    assert np.mean(pos >= toxicity.THRESHOLD) > 0.8 and np.mean(neg >= toxicity.THRESHOLD) < 0.05


def test_odd_rows(spark, odd, empty):
    model = toxicity.Model({"word": 9.0}, -6.0)
    out = {r["doc_id"]: r["s"] for r in odd.select("doc_id", toxicity.score(F.col("text"), model, spark).alias("s")).collect()}
    assert out[1] == out[2] == out[3] == 0 and out[5] > 0.9 and out[6] < 0.1 and all(0 <= s <= 1 for s in out.values())
    kept = toxicity.keep_civil(odd, model)
    assert kept.columns == odd.columns and 5 not in [r["doc_id"] for r in kept.collect()]
    assert toxicity.keep_civil(empty, model).count() == 0


def test_sentences_are_located(docs_of):
    model = toxicity.Model({"vile": 12.0}, -6.0)
    text = "A fine day. You vile thing! Bye."
    found = toxicity.offending(docs_of([(1, text, "en", "a"), (None, None, None, None)]), model).collect()
    assert [(r["id"], r["sentence"], text[r["start"] : r["end"]]) for r in found] == [(1, "You vile thing", "You vile thing")]


def test_sentences_keep_their_places_under_lower_case():
    text = "İİİİ ok. You VİLE ΣΑΣ vile thing. By"
    found = [(text[a:b], words) for a, b, words in toxicity.sentences(text)]
    assert [said for said, _ in found] == ["İİİİ ok", "You VİLE ΣΑΣ vile thing", "By"] and "vile" in found[1][1]
    assert toxicity.lowered("AÑB") == "añb" and len(toxicity.lowered(text)) == len(text)


def test_query_against_plain_noisy_or(spark):
    """Every score of the query, by the plain product over sentences."""
    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(toxicity.fold_of(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(documents, labels)
    out = {r["doc_id"]: r for r in toxicity.QUERIES["op5_toxicity"](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert out.keys() == texts.keys() and any(r["predicted"] for r in out.values())
    for i, text in texts.items():
        none = 1.0
        for sentence in re.split(r"[.!?\n]", (text or "").lower()):
            words = re.findall(r"\w+", sentence)
            for part in (words[k : k + 40] for k in range(0, len(words), 40)):
                said = {t for w in part for t in [w, *[w[:n] + "*" for n in (4, 5, 6, 7) if n < len(w)]]}
                none *= 1 - 1 / (1 + np.exp(-model.bias - sum(model.weights.get(t, 0.0) for t in said)))
        assert abs(out[i]["score"] - (1 - none)) < 1e-9 and out[i]["predicted"] == (1 - none >= toxicity.THRESHOLD)
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_training_is_bounded_by_rows_and_characters(spark, docs_of):
    rows = [(i, f"a vile thing {i}" if i % 2 else f"a fine thing {i}", "en", "a") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert "vile" in toxicity.fit(docs_of(rows), labels).weights
    assert toxicity.fit(docs_of(rows), labels, sample_chars=10).weights == {} == toxicity.fit(docs_of(rows), labels, sample=0).weights


def test_noisy_or_by_hand():
    weights, bias = {"bad": 3.0, "worse": 5.0}, -2.0
    p = [1 / (1 + np.exp(-z)) for z in (bias + 3.0, bias, bias + 8.0)]
    assert abs(toxicity.score_text("bad bad. fine. worse, bad", weights, bias) - (1 - np.prod([1 - x for x in p]))) < 1e-12


def test_no_labels(spark, docs_of, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(empty, labels).weights == {}
    one_kind = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of([(1, "a text", "en", "a"), (2, "b", "en", "a")]), one_kind)
    assert toxicity.score_text("anything at all", model.weights, model.bias) < 0.01


@pytest.mark.parametrize("place", [0, 100, 199])
def test_a_too_long_text_is_left_out_by_itself(spark, docs_of, place):
    """The model is that of the other rows, wherever the text beyond the bound stands in the sample's order."""
    texts = [(i, f"you vile filth number {i}" if i % 2 else f"a calm and pleasant day number {i}", "en", "a") for i in range(200)]
    order = [r["i"] for r in spark.range(200).toDF("i").orderBy(F.xxhash64("i"), "i").collect()]
    rest = [t for t in texts if t[0] != order[place]]
    long = [(i, "calm " * 5_000 if i == order[place] else t, g, s) for i, t, g, s in texts]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    assert toxicity.fit(docs_of(long), labels, sample_chars=20_000) == toxicity.fit(docs_of(rest), labels) and toxicity.fit(docs_of(rest), labels).weights
    with pytest.warns(UserWarning):
        assert toxicity.fit(docs_of(long), labels, sample_chars=3).weights == {}
