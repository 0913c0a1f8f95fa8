import collections
import math

import pytest
from pyspark.sql import functions as F

from tabularium.llm import quality

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "then the cats sang", "", None, "the the the the"] * 2 + ["ÿñ 日本", "one more line of text here"]


class Brute:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, texts):
        n = quality.ORDER
        counts = {k: collections.Counter() for k in range(1, n + 1)}
        for t in texts:
            s = quality.PAD * (n - 1) + (t or "")
            for i in range(n - 1, len(s)):
                counts[n][s[i - n + 1 : i + 1]] += 1
        for k in range(n - 1, 0, -1):
            for g, c in counts[k + 1].items():
                counts[k][g[1:]] += c if g[1:].startswith(quality.PAD) else 1
        self.counts, self.cut, self.total, self.left = counts, {}, collections.Counter(), collections.Counter()
        for k, c in counts.items():
            d = quality._discounts([sum(v == j for v in c.values()) for j in (1, 2, 3, 4)])
            self.cut[k] = lambda v, d=d: d[min(v, 3) - 1]
            for g, v in c.items():
                self.total[(k, g[:-1])] += v
                self.left[(k, g[:-1])] += self.cut[k](v)
        self.uniform = 1 / (len(counts[1]) + 1)

    def p(self, g):
        if not g:
            return self.uniform
        k, context = len(g), (len(g), g[:-1])
        if not self.total[context]:
            return self.p(g[1:])
        c = self.counts[k][g]
        return (c - self.cut[k](c) if c else 0) / self.total[context] + self.left[context] / self.total[context] * self.p(g[1:])

    def perplexity(self, text):
        s = quality.PAD * (quality.ORDER - 1) + text
        logs = [math.log(self.p(s[i - quality.ORDER + 1 : i + 1])) for i in range(quality.ORDER - 1, len(s))]
        return math.exp(-sum(logs) / len(logs))


@pytest.mark.parametrize("head", [0, 40, 10_000])
def test_perplexities_equal_brute_force(spark, docs_of, head):
    model = quality.train(docs_of([(i, t, "en", "a") for i, t in enumerate(TEXTS)]))
    brute = Brute(TEXTS)
    seen = ["the cat sat", "zebra!", "then a mat", "日本 ñ", "x", "the cat and the dog sat on a log"]
    scored = quality.perplexities(docs_of([(i, t, "en", "a") for i, t in enumerate(seen)]), model, head=head, batch_grams=12)
    out = {r["id"]: r["perplexity"] for r in scored.collect()}
    assert [out[i] for i in range(len(seen))] == pytest.approx([brute.perplexity(t) for t in seen], rel=1e-9)


def test_probabilities_sum_to_one():
    brute = Brute(TEXTS)
    letters = [*brute.counts[1], "Ω"]
    for context in ("the ", "a", "", "zz"):
        assert sum(brute.p((context + c)[-quality.ORDER :]) for c in letters) == pytest.approx(1)


def test_odd_rows(spark, odd, empty, documents):
    trusted = documents.select("doc_id").where("doc_id % 3 > 0")
    model = quality.train(documents)
    out = {r["id"]: r for r in quality.perplexities(odd, model).collect()}
    assert out[1]["perplexity"] is None and out[2]["perplexity"] is None and out[5]["perplexity"] > 1
    assert quality.perplexities(odd, model).count() == odd.count() and quality.perplexities(empty, model).count() == 0
    judged = quality.classify(empty, trusted)
    assert judged.count() == 0
    none = quality.classify(odd, trusted.where("doc_id < 0")).collect()
    assert len(none) == odd.count() and all(r["keep"] == (r["perplexity"] is not None) for r in none)


def test_grams_are_counted_alike_with_few_and_many_characters():
    for texts in (TEXTS, ["".join(map(chr, range(0x4E00, 0x4E00 + 9000))) + "aaaaaa", "aaaaaaa", "\x00\x01 a"]):
        texts = [t for t in texts if t]
        code, ends, _ = quality.joined(texts)
        grams, n = quality._distinct(code, ends)
        padded = [quality.PAD * (quality.ORDER - 1) + "".join("\x01" if c <= quality.PAD else c for c in t) for t in texts]
        expected = collections.Counter(t[i : i + quality.ORDER] for t in padded for i in range(len(t) - quality.ORDER + 1))
        assert dict(zip(grams, n.tolist())) == expected and len(grams) == len(expected)


def test_judge_by_hand(spark):
    held = [("en", float(x)) for x in range(1, 201)] + [("de", 7.0)] * 3 + [(None, 900.0), ("en", None)]
    scores = [(i, lang, 5, p) for i, (lang, p) in enumerate([("en", 199.0), ("en", 199.5), ("de", 7.0), ("de", 7.1), ("fr", 200.0), ("fr", 201.0), (None, 200.0), (None, 901.0), ("en", None), ("en", 199.0)])]
    rows = quality.judge(spark.createDataFrame(scores, "id long, lang string, n_chars long, perplexity double"), spark.createDataFrame(held, "lang string, perplexity double")).collect()

    def at(values):
        return sorted(values)[math.ceil(quality.QUANTILE * len(values)) - 1]

    own = {g: at([p for k, p in held if k == g and p is not None]) for g in ("en", "de")}
    whole = at([p for _, p in held if p is not None])
    expected = {i: (own.get(g, whole), p is not None and p <= own.get(g, whole)) for i, g, _, p in scores}
    assert {r["id"]: (r["threshold"], r["keep"]) for r in rows} == expected
    free = quality.judge(spark.createDataFrame(scores, "id long, lang string, n_chars long, perplexity double"), spark.createDataFrame([], "lang string, perplexity double")).collect()
    assert all(r["keep"] == (r["perplexity"] is not None) for r in free)


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.QUERIES["op9_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("i"), "quality")
    rows = out.join(labels, F.col("doc_id") == F.col("i")).collect()
    good, bad = [r["keep"] for r in rows if r["quality"] == 1], [r["keep"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)
