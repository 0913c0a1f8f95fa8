"""A quality classifier by perplexity: an interpolated modified Kneser-Ney model of character n-grams.

Training counts the highest order's n-grams over all trusted text; lower orders
count distinct continuations. Counts, discounts and back-off weights are tables
sharded by n-gram, made by group-bys and joins.

Scoring reads and hashes each text once. The model's most frequent n-grams, a
fixed number at most, are broadcast; where they settle a character, its
log-probability is added up at once, and only the n-grams of the other characters
go on, dealt into batches of bounded size. A batch asks for its distinct n-grams
and their back-off chain; the requests join the sharded table, and the answers
meet the batch again. No text is shuffled.

A document is kept if its perplexity is within its language's quantile over
trusted documents that were left out of training.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import broadcast_if_small, fold_of, table, written
from tabularium.llm.lookup import Lookup

ORDER = 5
#: Stands before a text's first character; characters up to it count as one.
PAD = "\x02"
#: n-grams in the broadcast table at most; unsettled n-grams of a batch; characters looked up at once.
HEAD, BATCH, AT_ONCE = 300_000, 300_000, 200_000
#: A row weighs as much as this many n-grams when batches are cut.
ROW = 10
#: Of trusted documents left out of training, this share lies within the threshold; one fold of FOLDS is left out.
QUANTILE, FOLDS = 0.995, 5
#: Discounts where too few n-grams are seen to estimate them.
USUAL = (0.5, 1.0, 1.5)


# ---- n-grams in a task


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, place of each real character there, number of its text); ORDER - 1 pads stand before each text.

    Code points up to the pad's become 1.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    found = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(found)) + (owner + 1) * (ORDER - 1)
    code = np.full(len(found) + len(texts) * (ORDER - 1), ord(PAD), np.uint64)
    code[place] = np.where(found <= ord(PAD), 1, found)
    return code, place, owner


def parts(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Runs of texts, each of about ``chars`` characters or a single longer text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(ORDER)]


def hashes(code: np.ndarray, ends: np.ndarray, n: int = ORDER) -> np.ndarray:
    """64-bit hashes of the n-grams that end at the given places."""
    if n == ORDER and 2 * len(ends) > len(code):  # dense: whole slices, then one choice
        out = np.zeros(len(code) - ORDER + 1, np.uint64)
        for i in range(n):
            out += (code[ORDER - 1 - i : len(code) - i] + np.uint64(1)) * _FACTORS[i]
        return out[ends - (ORDER - 1)]
    out = np.zeros(len(ends), np.uint64)
    for i in range(n):
        out += (code[ends - i] + np.uint64(1)) * _FACTORS[i]
    return out


def windows(code: np.ndarray, ends: np.ndarray) -> str:
    """The highest n-grams that end at the given places, one after the other."""
    return code[ends[:, None] + np.arange(1 - ORDER, 1)].astype("<u4").tobytes().decode("utf-32-le")


def grams_of(said: str) -> list[str]:
    """The n-grams that windows() wrote."""
    return [said[i : i + ORDER] for i in range(0, len(said), ORDER)]


def hash_of(grams: list[str]) -> np.ndarray:
    """The same hashes from strings of up to ORDER characters."""
    lengths = np.fromiter(map(len, grams), np.int64, len(grams))
    out = np.zeros(len(grams), np.uint64)
    for n in range(1, ORDER + 1):
        which = np.flatnonzero(lengths == n)
        if len(which):
            code = np.frombuffer("".join(grams[i] for i in which).encode("utf-32-le", "replace"), "<u4").astype(np.uint64).reshape(-1, n)
            for i in range(n):
                out[which] += (code[:, n - 1 - i] + np.uint64(1)) * _FACTORS[i]
    return out


class Table:
    """Log-probabilities and back-off weights by an n-gram's hash; what it lacks is looked up in the table below it."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, bow: np.ndarray, below: Table | None = None):
        self.lookup, self.below = Lookup(keys), below
        self.columns = {"logp": np.append(logp, np.nan), "bow": np.append(np.nan_to_num(bow), 0.0)}

    def holds(self, keys: np.ndarray) -> np.ndarray:
        return self.lookup.find(keys) >= 0

    def get(self, column: str, keys: np.ndarray) -> np.ndarray:
        """Values of logp (NaN where it is missing) or bow (then 0)."""
        at = self.lookup.find(keys)
        out = self.columns[column][at]
        if self.below is not None:
            rest = np.flatnonzero(at < 0)
            out[rest] = self.below.get(column, keys[rest])
        return out


def backed_off(known: Table, code: np.ndarray, ends: np.ndarray, unseen: float) -> np.ndarray:
    """Log-probabilities of the characters at the given places, each after those before it."""
    out, live = np.zeros(len(ends)), np.arange(len(ends))
    for n in range(ORDER, 0, -1):
        p = known.get("logp", hashes(code, ends[live], n))
        seen = ~np.isnan(p)
        out[live[seen]] += p[seen]
        live = live[~seen]
        if n > 1 and len(live):
            out[live] += known.get("bow", hashes(code, ends[live] - 1, n - 1))
    out[live] += unseen
    return out


# ---- training


def _distinct(code: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(highest n-gram, its count), each once. Where few different characters meet, n-grams are packed into integers."""
    present = np.zeros(0x110000, bool)
    present[code] = True
    letters = np.flatnonzero(present).astype(np.uint64)
    bits = max(1, (len(letters) - 1).bit_length())
    if bits * ORDER > 64:
        _, first, n = np.unique(hashes(code, ends), return_index=True, return_counts=True)
        return grams_of(windows(code, ends[first])), n
    number = np.zeros(0x110000, np.uint16)
    number[letters] = np.arange(len(letters))
    small, packed = number[code], np.zeros(len(ends), np.uint64)
    for i in range(ORDER):
        packed |= small[ends - i].astype(np.uint64) << np.uint64(bits * i)
    packed, n = np.unique(packed, return_counts=True)
    mask = np.uint64((1 << bits) - 1)
    found = np.stack([letters[((packed >> np.uint64(bits * i)) & mask).astype(np.int64)] for i in range(ORDER - 1, -1, -1)], axis=1)
    return grams_of(found.astype("<u4").tobytes().decode("utf-32-le")), n


def _count(chars_at_once: int = 3_000_000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, chars = [], 0

        def counted() -> pd.DataFrame:
            code, ends, _ = joined(held)
            grams, n = _distinct(code, ends)
            return pd.DataFrame({"gram": grams, "n": n})

        for batch in batches:
            for text in batch["text"]:
                held.append(text)
                chars += len(text)
                if chars >= chars_at_once:
                    yield counted()
                    held, chars = [], 0
        if held:
            yield counted()

    return run


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """The modified discounts from how many n-grams have counts 1, 2, 3 and 4."""
    if min(n) == 0:
        return USUAL
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(d if 0 < d < k else usual for d, k, usual in zip(found, (1, 2, 3), USUAL))


def train(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n, logp, bow): the model's table over all of texts.

    logp is the interpolated log-probability of the gram's last character after the others, null for what is only a
    context; bow the log of the weight left to lower orders after the gram as a context, null where it is none. The
    empty gram has the uniform distribution over the characters seen and one more. Null and empty texts add nothing;
    repeated rows count as often as they occur; texts of any length are counted whole. Only text_col is read, so other
    columns' names cannot clash. Without any text the table is that one row.
    """
    rows = texts.select(F.col(text_col).alias("text")).where(F.length("text") > 0)
    counted = rows.mapInPandas(_count(), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    whole = written(counted)
    # lower orders: how many different characters stand before a gram; at a text's start nothing does, and occurrences count
    ends = whole.select("gram", "n", F.explode(F.sequence(F.lit(1), F.lit(ORDER - 1))).alias("level"))
    ends = ends.select("level", F.right("gram", F.col("level")).alias("gram"), F.right("gram", F.col("level") + 1).alias("longer"), "n")
    shorter = ends.groupBy("level", "gram").agg(F.sum("n").alias("occurrences"), F.count_distinct("longer").alias("kinds"))
    shorter = written(shorter.select("level", "gram", F.when(F.col("gram").startswith(PAD), F.col("occurrences")).otherwise(F.col("kinds")).alias("n")))
    every = whole.select(F.lit(ORDER).alias("level"), "gram", "n").union(shorter)
    stats = {r["level"]: r for r in every.groupBy("level").agg(F.count("*").alias("all"), *[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()}
    uniform = -math.log((stats[1]["all"] if 1 in stats else 0) + 1)

    lower, tables = None, []
    for order in range(1, ORDER + 1):
        seen = stats.get(order)
        d1, d2, d3 = _discounts([seen[f"n{k}"] for k in (1, 2, 3, 4)] if seen else [0])
        n = F.col("n")
        cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        level = (whole if order == ORDER else shorter.where(F.col("level") == order)).select("gram", "n", F.substring("gram", 1, order - 1).alias("context"), F.substring("gram", 2, order).alias("shorter"), cut.alias("cut"))
        contexts = level.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts")).select("context", "total", (F.col("cuts") / F.col("total")).alias("left"))
        level = level.join(contexts, "context")
        if lower is None:
            below = F.lit(math.exp(uniform))
        else:
            level = level.join(lower, "shorter")
            below = F.col("p")
        level = written(level.select("gram", "n", ((n - F.col("cut")) / F.col("total") + F.col("left") * below).alias("q")))
        tables.append(level.select("gram", "n", F.log("q").alias("logp"), F.lit(None).cast("double").alias("bow")))
        tables.append(contexts.select(F.col("context").alias("gram"), F.lit(0).cast("long"), F.lit(None).cast("double"), F.log("left")))
        lower = level.select(F.col("gram").alias("shorter"), F.col("q").alias("p"))
    empty = texts.sparkSession.range(1).select(F.lit(""), F.lit(0).cast("long"), F.lit(uniform), F.lit(None).cast("double"))
    model = _union([*tables, empty]).groupBy("gram").agg(F.max("n").alias("n"), F.max("logp").alias("logp"), F.max("bow").alias("bow"))
    return written(model)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


# ---- scoring


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"h": hash_of(batch["gram"].tolist()).view(np.int64), "logp": batch["logp"], "bow": batch["bow"]})


def _head(model: DataFrame, most: int) -> Table:
    """The n-grams of the largest counts: all from a power of two on, most at most."""
    sizes = model.where("n > 0").groupBy(F.floor(F.log2("n")).alias("power")).count().collect()
    least, held = 64, 0
    for row in sorted(sizes, key=lambda r: -r["power"]):
        if held + row["count"] > most:
            break
        least, held = row["power"], held + row["count"]
    if not held:
        return Table(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    chosen = model.where((F.col("n") > 0) & (F.floor(F.log2(F.greatest("n", F.lit(1)))) >= least)).select("gram", "logp", "bow")
    found = chosen.mapInPandas(_hashed, "h long, logp double, bow double").toPandas()
    return Table(found["h"].to_numpy().view(np.uint64), found["logp"].to_numpy(float), found["bow"].to_numpy(float))


SETTLED = "batch long, id string, lang string, n_chars long, log_p double, missing string"


def _settle(shared, batch_grams: int):
    """Adds up what the broadcast n-grams settle; ``missing`` holds the highest n-grams of all other characters."""

    def settled(texts: list[str], known: Table) -> tuple[np.ndarray, list[str]]:
        sums, missing = np.zeros(len(texts)), [""] * len(texts)
        for a, b in parts(texts, AT_ONCE):
            code, ends, owner = joined(texts[a:b])
            if not len(ends):
                continue
            p = known.get("logp", hashes(code, ends))
            open_ = np.flatnonzero(np.isnan(p))
            sums[a:b] = np.bincount(owner, np.nan_to_num(p), minlength=b - a)
            if len(open_):
                said, of = windows(code, ends[open_]), owner[open_]
                edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
                for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    missing[a + int(of[i])] = said[ORDER * i : ORDER * j]
        return sums, missing

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, _ = shared.value
        first, weight = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            place = {text: i for i, text in enumerate(dict.fromkeys(batch["text"]))}  # equal texts are scored once
            sums, missing = settled(list(place), known)
            at = [place[text] for text in batch["text"]]
            said = [missing[i] for i in at]
            size = np.array([len(m) // ORDER + ROW for m in said], np.int64)
            upto = weight + np.cumsum(size)
            yield pd.DataFrame({"batch": first + (upto - size) // batch_grams, "id": batch["id"], "lang": batch["lang"], "n_chars": [len(t) for t in batch["text"]], "log_p": sums[at], "missing": said})
            weight = int(upto[-1]) if len(upto) else weight

    return run


def _ask(shared):
    """The distinct n-grams that each batch needs beyond the broadcast ones: the missing and their back-off chains."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, _ = shared.value
        now, wanted = None, set()

        def asked() -> pd.DataFrame:
            grams = list({g[i:j] for g in wanted for i in range(ORDER) for j in (ORDER - 1, ORDER) if j > i})
            new = np.flatnonzero(~known.holds(hash_of(grams)))
            return pd.DataFrame({"batch": now, "gram": [grams[i] for i in new]})

        for batch in batches:
            for number, said in zip(batch["batch"].tolist(), batch["missing"]):
                if number != now:
                    if wanted:
                        yield asked()
                    now, wanted = number, set()
                wanted.update(grams_of(said))
        if wanted:
            yield asked()

    return run


def _score(shared):
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        below, unseen = shared.value
        known = Table(hash_of(answers["gram"].tolist()), answers["logp"].to_numpy(float), answers["bow"].to_numpy(float), below)
        said = rows["missing"].tolist()
        code = np.frombuffer("".join(said).encode("utf-32-le"), "<u4").astype(np.uint64)
        p = backed_off(known, code, np.arange(ORDER - 1, len(code), ORDER), unseen)
        owner = np.repeat(np.arange(len(rows)), [len(m) // ORDER for m in said])
        return pd.DataFrame({"id": rows["id"], "lang": rows["lang"], "n_chars": rows["n_chars"], "log_p": rows["log_p"] + np.bincount(owner, p, minlength=len(rows))})

    return run


def perplexities(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", head: int = HEAD, batch_grams: int = BATCH) -> DataFrame:
    """(id, lang, n_chars, perplexity) of every row of docs; perplexity is null where a text is null or empty.

    Repeated rows each get their row; equal texts equal values, whatever batch they fall into. A text of any length is
    scored whole: a batch holds about batch_grams n-grams that the broadcast ones leave open, or one text's. Other
    columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    root = model.where("gram = ''").first()
    shared = spark.sparkContext.broadcast((_head(model, head), root["logp"] + (root["bow"] or 0.0)))

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = written(rows.mapInPandas(_settle(shared, batch_grams), SETTLED))
    asked = seen.where("missing <> ''").select("batch", "missing").mapInPandas(_ask(shared), "batch long, gram string")
    answers = asked.join(model.where("gram <> ''").select(F.col("gram").alias("known"), "logp", "bow"), F.col("gram") == F.col("known")).select(F.col("batch").alias("to_batch"), "gram", "logp", "bow")
    left = seen.where("missing <> ''").groupBy("batch").cogroup(answers.groupBy("to_batch")).applyInPandas(_score(shared), "id string, lang string, n_chars long, log_p double")
    scored = seen.where("missing = ''").select("id", "lang", "n_chars", "log_p").union(left)
    each = F.when(F.col("n_chars") > 0, F.exp(-F.col("log_p") / F.col("n_chars")))
    return scored.select(F.col("id").cast(kind).alias("id"), "lang", "n_chars", each.alias("perplexity"))


def judge(scores: DataFrame, calibration: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """scores with the language's ``threshold`` and ``keep``.

    calibration has (lang, perplexity) of trusted documents outside training; a language's threshold is the quantile
    of its perplexities, one of those values. A language without any, a null one included, takes the quantile over all
    of them; without any at all every document with a perplexity stays. A perplexity equal to the threshold stays;
    documents without a perplexity go. Repeated rows each keep their row.
    """
    known = calibration.where("perplexity IS NOT NULL")
    limit = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    overall = known.agg(limit.alias("x")).first()["x"]
    own = broadcast_if_small(known.where("lang IS NOT NULL").groupBy(F.col("lang").alias("of")).agg(limit.alias("own")), 100_000)
    rows = scores.join(own, F.col("lang") == F.col("of"), "left").withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double"))).drop("of", "own")
    within = F.col("perplexity") <= F.coalesce("threshold", F.lit(float("inf")))
    return rows.withColumn("keep", F.coalesce(within, F.lit(False)))


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(id, lang, n_chars, perplexity, threshold, keep) of every row of docs.

    trusted has one column of ids; their texts train the model, but for one fold of ids, which sets the thresholds.
    Repeated rows each get their row; null ids are scored, but never trusted. Other columns are not read.
    """
    ids = trusted.toDF("trusted").where("trusted IS NOT NULL").distinct()
    out = fold_of(F.col("trusted"), FOLDS) == 0
    train_ids = broadcast_if_small(ids.where(~out))
    model = train(docs.join(train_ids, docs[id_col] == train_ids["trusted"], "left_semi"), text_col)
    scores = written(perplexities(docs, model, id_col, text_col, lang_col))
    held = scores.join(ids.where(out), F.col("id") == F.col("trusted"), "left_semi").select("lang", "perplexity")
    return judge(scores, held, quantile)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Ids whose labels all say good."""
    return labels.groupBy(id_col).agg(F.min(label_col).alias("least")).where("least = 1").select(id_col)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, trusted_ids(labels)).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
