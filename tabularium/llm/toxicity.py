"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its
words and their first letters, so that one offensive stem covers its endings;
noisy-or combines them to the document's score. Only documents carry labels;
training pushes the noisy-or towards them, and the sentence scores then say where
the offence is.

The terms are chosen first: again and again the one that best tells the offending
documents not yet covered from the clean ones, by the likelihood ratio, until each
is covered some times over. Rare words that merely come along are left out.
"""

from __future__ import annotations

import warnings
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import fold_of, table

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
LONGEST = 40  # words; longer sentences count as several
STEM, STEM_LENGTHS = "*", (4, 5, 6, 7)  # the mark of a beginning, and its letters
CACHED_WORDS = 300_000
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def lowered(text: str) -> str:
    """The text in lower case, place by place: a character whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence of the text; those of over LONGEST words come in several pieces."""
    for m in SENTENCE.finditer(lowered(text)):
        found = [(w.start(), w.end(), w.group()) for w in WORD.finditer(m.group())]
        for at in range(0, len(found), LONGEST):
            part = found[at : at + LONGEST]
            yield m.start() + part[0][0], m.start() + part[-1][1], [w for _, _, w in part]


def terms(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *[word[:n] + STEM for n in STEM_LENGTHS if len(word) > n]]


def _document_terms(text: str) -> set[str]:
    return {t for w in set(WORD.findall(lowered(text))) for t in terms(w)}


def _ratio(hit: np.ndarray, miss: np.ndarray, offending: float, clean: float) -> np.ndarray:
    """Twice the log-likelihood ratio of terms that favour offending documents, 0 for the others."""
    expected = (hit + miss) * offending / (offending + clean)
    own = hit * np.log(np.maximum(hit, 1e-9) / np.maximum(expected, 1e-9))
    other = miss * np.log(np.maximum(miss, 1e-9) / np.maximum(hit + miss - expected, 1e-9))
    return np.where(hit > expected, 2 * (own + other), 0.0)


def choose(offending: list[str], clean: list[str], least_docs: int = 3, least_ratio: float = 15.0, cover: int = 8, most: int = 500) -> list[str]:
    """Terms that cover the offending texts ``cover`` times, best first.

    Texts are read one at a time, and only terms of offending ones are counted; no text's terms are held.
    """
    hits = Counter(t for text in offending for t in _document_terms(text))
    hits = {t: n for t, n in hits.items() if n >= least_docs}
    misses = Counter(t for text in clean for t in _document_terms(text) if t in hits)
    names = sorted(hits)
    hit, miss = np.array([hits[t] for t in names], float), np.array([misses[t] for t in names], float)
    strong = _ratio(hit, miss, len(offending), len(clean)) > least_ratio / 3
    names, miss = [t for t, keep in zip(names, strong) if keep], miss[strong]
    place = {t: i for i, t in enumerate(names)}
    pairs = [(d, place[t]) for d, text in enumerate(offending) for t in sorted(_document_terms(text) & place.keys())]
    doc, term = np.array(pairs, np.int32).reshape(-1, 2).T
    live, chosen = np.full(len(offending), cover), []
    while names and len(chosen) < most and live.any():
        open_ = float((live > 0).sum())
        weight = live / live.sum() * open_  # what is still to be covered counts as so many documents
        ratio = _ratio(np.bincount(term, weight[doc], minlength=len(names)), miss, open_, len(clean))
        ratio[[place[t] for t in chosen]] = 0
        best = int(ratio.argmax())
        if ratio[best] < least_ratio:
            break
        chosen.append(names[best])
        covered = doc[term == best]
        live[covered] = np.maximum(live[covered] - 1, 0)
    return chosen


def train(texts: list[str], labels: np.ndarray, rounds: int = 500, rate: float = 0.1, decay: float = 1e-6) -> Model:
    """Full-batch Adam on the noisy-or likelihood over the chosen terms. Repeated texts count once."""
    first: dict[tuple[str, bool], None] = dict.fromkeys((t or "", bool(y)) for t, y in zip(texts, labels))
    texts, labels = [t for t, _ in first], np.array([y for _, y in first], bool)
    if not len(texts) or not labels.any() or labels.all():
        return Model({}, -20.0 if not labels.any() else 20.0)
    chosen = choose([t for t, y in zip(texts, labels) if y], [t for t, y in zip(texts, labels) if not y])
    vocabulary = {t: i for i, t in enumerate(chosen)}
    term, sentence, doc, plain, n = [], [], [], np.zeros(len(texts)), 0
    for d, text in enumerate(texts):
        for _, _, words in sentences(text):
            ids = {vocabulary[t] for w in set(words) for t in terms(w) if t in vocabulary}
            if not ids:
                plain[d] += 1
                continue
            term += sorted(ids)
            sentence += [n] * len(ids)
            doc.append(d)
            n += 1
    term, sentence, doc = np.array(term, np.int32), np.array(sentence, np.int32), np.array(doc, np.int32)
    w, b = np.full(len(vocabulary), 2.0), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(sentence, w[term], minlength=n)
        none = np.bincount(doc, np.logaddexp(0, z), minlength=len(texts)) + plain * np.logaddexp(0, b)  # -log of "no sentence offends"
        q = np.exp(-none)
        pull = np.where(labels, -q / np.maximum(1 - q, 1e-9), 1.0) / len(texts)
        g = pull[doc] / (1 + np.exp(-z))
        gw, gb = np.bincount(term, g[sentence], minlength=len(w)) + decay * w, g.sum() + (pull * plain).sum() / (1 + np.exp(-b))
        m, v = 0.9 * m + 0.1 * gw, 0.98 * v + 0.02 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.98 * vb + 0.02 * gb**2
        step = rate * (1 - t / (rounds + 1)) * np.sqrt(1 - 0.98**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-8)
    return Model({x: float(w[i]) for x, i in vocabulary.items()}, float(b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 8000, sample_chars: int = 64_000_000) -> Model:
    """Learn from at most ``sample`` labelled rows of at most ``sample_chars`` characters together: those of smallest id hash.

    A text that would go beyond what is left of the characters is left out by itself, the next ones may still fit; if
    none of the labelled texts fits, a warning is given and nothing is learned. Rows without an id or label are no examples; of several labels
    of an id the largest counts. Null texts are empty ones, and repeated rows count once. Only the chosen ids' texts are
    read, each whole, and one task trains on them: both bounds are those of its memory. Other columns are not read.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).alias("y"))
    marks = marks.orderBy(F.xxhash64("i"), "i").limit(sample)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).join(F.broadcast(marks), "i")
    sizes = rows.select("i", "h", F.coalesce(F.length("t"), F.lit(0)).alias("n")).orderBy(F.xxhash64("i"), "h").limit(sample)
    held, chosen, left_out = sample_chars, [], 0
    for r in sizes.collect():  # at most ``sample`` rows of three numbers
        if r["n"] <= held:
            held -= r["n"]
            chosen.append((r["i"], r["h"]))
        else:
            left_out += 1
    if left_out and not chosen:
        warnings.warn(f"none of the labelled texts has at most {sample_chars} characters; nothing is learned", stacklevel=2)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sizes.schema.fields[:2])
    chosen = docs.sparkSession.createDataFrame(chosen, kinds).distinct()
    rows = rows.join(F.broadcast(chosen), ["i", "h"], "left_semi").select("i", "t", "y").dropDuplicates(["i", "t"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["i", "t"], na_position="first")
        model = train(frame["t"].tolist(), frame["y"].to_numpy() > 0)
        words = [None, *model.weights]
        return pd.DataFrame({"w": words, "x": [model.bias, *model.weights.values()]})

    learned = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "w string, x double").collect()
    return Model({r.w: r.x for r in learned if r.w is not None}, next((r.x for r in learned if r.w is None), -20.0))


def _soft(z: float) -> float:
    return float(np.logaddexp(0, z))


class Scorer:
    """Scores texts; what a word adds is looked up once."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.plain = weights, bias, _soft(bias)
        self.known: dict[str, tuple[str, ...]] = {}

    def sentence(self, words: list[str]) -> float:
        """The logit of one sentence."""
        known, found = self.known, set()
        for w in words:
            hit = known.get(w)
            if hit is None:
                hit = known[w] = tuple(t for t in terms(w) if t in self.weights)
            if hit:
                found.update(hit)
        if len(known) > CACHED_WORDS:
            known.clear()
        return self.bias + sum(self.weights[t] for t in sorted(found)) if found else self.bias

    def text(self, text: str | None) -> float:
        """Noisy-or over the sentences; an empty or null text scores 0."""
        total, plain = 0.0, 0
        for m in SENTENCE.findall(lowered(text or "")):
            words = WORD.findall(m)
            for at in range(0, len(words), LONGEST):
                z = self.sentence(words[at : at + LONGEST])
                if z == self.bias:
                    plain += 1
                else:
                    total += _soft(z)
        return float(-np.expm1(-(total + plain * self.plain)))


def score_text(text: str | None, weights: dict[str, float], bias: float) -> float:
    return Scorer(weights, bias).text(text)


def score(text: Column, model: Model, spark: SparkSession) -> Column:
    """Noisy-or of the text's sentence scores, 0 to 1; null and empty texts score 0, equal texts alike.

    A text of any length is scored whole, sentence by sentence.
    """
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield pd.Series([scorer.text(x) for x in batch], dtype="float64")

    return run(text)


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold; null and empty texts stay.

    All columns stay as they are, whatever their names; repeated rows stay or go alike; an empty table stays empty.
    """
    return docs.where(score(F.col(text_col), model, docs.sparkSession) < threshold)


def offending(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, start, end, sentence, score) of every sentence that scores ``least`` or more by itself.

    start and end are character places in the original text. A null id stays null; null and empty texts have no
    sentence; repeated rows give their sentences as often as they occur. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            out = []
            for i, text in zip(batch["id"].tolist(), batch["text"].tolist()):
                for a, b, words in sentences(text or ""):
                    p = float(1 / (1 + np.exp(-scorer.sentence(words))))
                    if p >= least:
                        out.append((None if pd.isna(i) else int(i), a, b, text[a:b], p))
            yield pd.DataFrame(out, columns=["id", "start", "end", "sentence", "score"]).astype({"id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, start long, end long, sentence string, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 3) == 1
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text"), model, spark).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
