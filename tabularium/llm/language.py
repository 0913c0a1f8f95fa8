"""Language identification by segmentation-marginalised unigrams.

For every language each piece of a fixed public vocabulary has a probability. A
word's probability is the sum over all of its segmentations into pieces, by the
forward algorithm; a text's is the product over its words. The probabilities are
fitted by expectation-maximisation, whose expected counts run over all
segmentations too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.llm.common import carried, fold_of, restored, table
from tabularium.llm.lookup import Lookup
from tabularium.llm.tokens import public_vocabulary

WORD = re.compile(r"[^\W\d_]+")  # letters, and numbers that are no digits; words() takes those out
START = "▁"
UNKNOWN = 1e-7  # probability of a letter that no piece covers, in every language
UNDETERMINED = "und"
#: Words remembered in a task; letters whose segmentations are summed at once; words of texts added up at once.
CACHED_WORDS, LETTERS_AT_ONCE, WORDS_AT_ONCE = 300_000, 400_000, 200_000
#: Sums below this are rescaled; it is looked for at every STEP-th letter.
TINY, STEP = 1e-150, 8


def letters(word: str) -> list[str]:
    """The runs of letters of one match of WORD."""
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


class Lattice:
    """The trie of pieces, walked by arrays from every place of many words at once."""

    def __init__(self, pieces: dict[str, int]):
        nodes, keys, children = {"": 0}, [], []
        for piece in sorted(pieces):
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                    keys.append(nodes[piece[: n - 1]] << 21 | ord(piece[n - 1]))
                    children.append(len(nodes) - 1)
        self.steps, self.children = Lookup(np.array(keys, np.uint64)), np.array([*children, -1], np.int64)
        self.piece = np.full(len(nodes), -1, np.int64)
        for piece, number in pieces.items():
            self.piece[nodes[piece]] = number
        self.numbers = sorted(pieces.values())
        self.size = max(self.numbers, default=-1) + 1  # also the number of an uncovered letter
        self.longest = max(map(len, pieces), default=1)


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """The lower-case pieces of letters of a public vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        bare = piece.removeprefix(START)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (piece == START or bare.isalpha() and bare == bare.lower()):
            found[piece] = i
    return Lattice(found)


class Segmentations:
    """All segmentations of some words, longest word first: edges between places, each with its piece."""

    def __init__(self, words: list[str], pieces: Lattice):
        self.order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        marked = [START + words[i] for i in self.order]
        self.lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        self.base = np.cumsum(self.lengths + 1) - self.lengths - 1  # a word of n letters has the places 0 to n
        self.reach = pieces.longest
        code = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        word = np.repeat(np.arange(len(marked)), self.lengths)
        first = np.cumsum(self.lengths) - self.lengths
        last = (first + self.lengths)[word]
        at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        uncovered, found, step = np.ones(len(code), bool), [], 0
        while len(at):
            node = pieces.children[pieces.steps.find(node.astype(np.uint64) << np.uint64(21) | code[at + step])]
            live = node >= 0
            at, node, step = at[live], node[live], step + 1
            piece = pieces.piece[node]
            whole = piece >= 0
            found.append((at[whole], np.full(int(whole.sum()), step), piece[whole]))
            if step == 1:
                uncovered[at[whole]] = False
            more = at + step < last[at]
            at, node = at[more], node[more]
        alone = np.flatnonzero(uncovered)
        found.append((alone, np.ones(len(alone), np.int64), np.full(len(alone), pieces.size)))
        at, size, self.piece = (np.concatenate(x) for x in zip(*found))
        self.word = word[at]
        self.start = at - first[self.word]
        self.end = self.start + size

    def sums(self, p: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(sum over the segmentations up to each place, log of the factor taken out of it), a column a language.

        p has a row for each piece. Backward, the sums run from the words' ends. Long words are rescaled on the way.
        """
        n = self.lengths
        a, b = (n[self.word] - self.end, n[self.word] - self.start) if backward else (self.start, self.end)
        by_start = np.argsort(a, kind="stable")
        source, target, piece = (self.base[self.word] + a)[by_start], (self.base[self.word] + b)[by_start], self.piece[by_start]
        total, languages = int(n.sum()) + len(n), p.shape[1]
        out, taken, logs = np.zeros((total, languages)), np.zeros((len(n), languages)), np.zeros((total, languages))
        out[self.base] = 1.0
        longest = int(n.max(initial=0))
        cut = np.searchsorted(a[by_start], np.arange(longest + 1))
        reaching = np.searchsorted(-n, -np.arange(longest + 1), side="right")  # words of at least s letters
        for s in range(longest + 1):
            here = self.base[: reaching[s]] + s
            if s % STEP == 0 and s:
                for w, g in zip(*np.nonzero(out[here] < TINY)):
                    value = out[here[w], g]
                    taken[w, g] += np.log(value)
                    out[here[w] : here[w] + min(self.reach, int(n[w]) - s) + 1, g] /= value
            if s >= STEP:
                logs[here] = taken[: reaching[s]]
            if s < longest:
                one = slice(cut[s], cut[s + 1])
                out[target[one]] += out[source[one]] * p[piece[one]]
        if backward:  # back to the places' own order
            place = np.repeat(self.base, n + 1)
            turned = place + np.repeat(n, n + 1) - (np.arange(total) - place)
            return out[turned], logs[turned]
        return out, logs

    def totals(self, p: np.ndarray) -> np.ndarray:
        """The words' log-probabilities, a row a word in the order given."""
        out, logs = self.sums(p)
        ends = self.base + self.lengths
        found = np.empty((len(ends), p.shape[1]))
        found[self.order] = np.log(out[ends]) + logs[ends]
        return found


def portions(words: list[str]) -> Iterator[list[str]]:
    """Words in lists of some LETTERS_AT_ONCE letters, or a single longer word."""
    held, size = [], 0
    for w in words:
        if held and size + len(w) > LETTERS_AT_ONCE:
            yield held
            held, size = [], 0
        held.append(w)
        size += len(w) + 2
    if held:
        yield held


def columns_of(languages: list[dict[int, float]], pieces: Lattice) -> np.ndarray:
    """The languages' probabilities as columns; the last row is that of an uncovered letter."""
    p = np.full((pieces.size + 1, len(languages)), UNKNOWN)
    for g, known in enumerate(languages):
        p[list(known.keys()), g] = list(known.values())
    return p


def word_logs(words: list[str], pieces: Lattice, p: np.ndarray) -> np.ndarray:
    """The words' log-probabilities, a row a word, a column a language."""
    return np.concatenate([np.zeros((0, p.shape[1])), *[Segmentations(part, pieces).totals(p) for part in portions(words)]])


def fit_language(words: Counter, pieces: Lattice, rounds: int = 3, smooth: float = 0.01) -> dict[int, float]:
    """Piece probabilities by expectation-maximisation over all segmentations of counted words, of whatever length."""
    names = sorted(words)
    held = [(Segmentations(part, pieces), np.array([words[w] for w in part], float)) for part in portions(names)]
    p = np.full((pieces.size + 1, 1), UNKNOWN)
    p[pieces.numbers, 0] = 1 / max(1, len(pieces.numbers))
    for _ in range(rounds):
        expected = np.zeros(pieces.size + 1)
        for found, count in held:
            a, log_a = (x[:, 0] for x in found.sums(p))
            b, log_b = (x[:, 0] for x in found.sums(p, backward=True))
            source, target = found.base[found.word] + found.start, found.base[found.word] + found.end
            whole = (np.log(a[found.base + found.lengths]) + log_a[found.base + found.lengths])[found.word]
            share = np.log(a[source]) + log_a[source] + np.log(p[found.piece, 0]) + np.log(b[target]) + log_b[target] - whole
            expected += np.bincount(found.piece, count[found.order][found.word] * np.exp(share), minlength=len(expected))
        kept = expected[pieces.numbers] + smooth
        p[pieces.numbers, 0] = kept / kept.sum()
    return dict(zip(pieces.numbers, p[pieces.numbers, 0].tolist()))


def fit(docs: DataFrame, vocabulary: str, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", docs_per_language: int = 150) -> dict[str, dict[int, float]]:
    """{language: {piece: probability}} from a bounded sample: per language the docs_per_language rows of smallest id hash.

    Ids are chosen on (language, id) alone; only the chosen rows' texts are read, whole. Each language is fitted in a
    task. Rows with a null language or text are no examples; repeated rows count as often as they are chosen. Other
    columns are not read, so their names cannot clash. An empty table gives an empty model.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("l"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i"))
    chosen = rows.select("l", "i").withColumn("r", rank).where(F.col("r") <= docs_per_language).select("l", "i").distinct()
    again = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), F.xxhash64("t")))
    texts = rows.join(F.broadcast(chosen), rows["l"].eqNullSafe(chosen["l"]) & rows["i"].eqNullSafe(chosen["i"]), "left_semi")
    texts = texts.withColumn("r", again).where(F.col("r") <= docs_per_language).select("l", "t")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        words: Counter = Counter()
        for text in frame["t"]:
            words.update(part for w in WORD.findall(text.lower()) for part in letters(w))
        p = fit_language(words, lattice(vocabulary))
        return pd.DataFrame({"l": frame["l"].iloc[0], "piece": list(p.keys()), "p": list(p.values())})

    learned: dict[str, dict[int, float]] = {}
    for x in texts.groupBy("l").applyInPandas(learn, "l string, piece int, p double").toLocalIterator():
        learned.setdefault(x.l, {})[x.piece] = x.p
    return dict(sorted(learned.items()))


class Predictor:
    """Language and posterior of texts; what a word adds is computed once."""

    def __init__(self, model: dict[str, dict[int, float]], pieces: Lattice):
        self.names, self.pieces, self.p = list(model), pieces, columns_of(list(model.values()), pieces)
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.logs, self.lettered = np.zeros((0, len(self.names))), np.zeros(0, bool)

    def _learn(self, words: set[str]) -> None:
        new = sorted(words.difference(self.rows))
        parts = [letters(w) for w in new]
        flat = word_logs([part for some in parts for part in some], self.pieces, self.p)
        owner = np.repeat(np.arange(len(new)), [len(some) for some in parts])
        logs = np.stack([np.bincount(owner, flat[:, g], minlength=len(new)) for g in range(len(self.names))], axis=1)
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.logs = np.concatenate([self.logs, logs])
        self.lettered = np.concatenate([self.lettered, np.array([bool(some) for some in parts], bool)])

    def _portion(self, found: list[list[str]]) -> list[tuple[str, float]]:
        flat = [w for words in found for w in words]
        if not flat or not self.names:
            return [(UNDETERMINED, 0.0)] * len(found)
        if len(self.rows) > CACHED_WORDS:
            self._forget()
        self._learn(set(flat))
        place = np.fromiter(map(self.rows.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(found)), [len(words) for words in found])
        total = np.stack([np.bincount(owner, self.logs[place, g], minlength=len(found)) for g in range(len(self.names))], axis=1)
        said = np.bincount(owner, self.lettered[place], minlength=len(found)) > 0
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1)[:, None]).sum(axis=1)
        return [(self.names[b], x) if ok else (UNDETERMINED, 0.0) for b, x, ok in zip(best.tolist(), score.tolist(), said.tolist())]

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, held, size = [], [], 0
        for text in texts:
            words = WORD.findall(text.lower()) if text else []
            held.append(words)
            size += len(words)
            if size > WORDS_AT_ONCE:
                out += self._portion(held)
                held, size = [], 0
        return out + self._portion(held)


def predict(text: Column, model: dict[str, dict[int, float]], vocabulary: str, spark: SparkSession) -> Column:
    """struct(lang, score): the likeliest language and its posterior under equal priors.

    A null text, one without a letter, or an empty model gives und with score 0. Ties go to the first name. Equal
    texts give equal values; texts are read whole, whatever their length.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.value, lattice(vocabulary))
        for batch in batches:
            yield pd.DataFrame(predictor.texts(batch.tolist()), columns=["lang", "score"])

    return run(text)


def keep_declared(docs: DataFrame, model: dict[str, dict[int, float]], vocabulary: str, lang_col: str = "lang", text_col: str = "text", sure: float = 0.99) -> DataFrame:
    """The rows of docs with letters whose declared language no sure prediction contradicts.

    Rows without letters go. A null declared language, or one the model has not learned, is not contradicted. All
    columns stay as they are, whatever their names; repeated rows each stay or go alike.
    """
    found, declared = predict(F.col(text_col), model, vocabulary, docs.sparkSession), F.col(f"row.{lang_col}")
    learned = declared.isin(*model) if model else F.lit(False)
    wrong = F.coalesce(learned & (declared != F.col("found.lang")) & (F.col("found.score") >= sure), F.lit(False))
    rows = docs.select(carried(docs), found.alias("found")).where((F.col("found.lang") != UNDETERMINED) & ~wrong)
    return restored(rows)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), public_vocabulary("piece_bpe_32k.model")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held_out), vocabulary)
    found = docs.select("doc_id", held_out.alias("held_out"), predict(F.col("text"), model, vocabulary, spark).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
