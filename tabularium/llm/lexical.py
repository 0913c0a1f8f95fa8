"""Ranked lexical search: a dual-sorted wavelet tree per shard of documents, searched best first for the exact top k.

A shard holds some of the documents, numbered by id, and the posting lists of
all their terms one after the other, each ordered by falling impact. That
sequence of document numbers is kept as a wavelet tree over the numbers: by
position a list is read from its largest impact on, by node it is cut to a range
of documents. Splitting a node is stable, so the first posting of a list within a
node has the list's largest impact there: the weighted sum of these firsts bounds
all documents of the node.

A search starts at the root with one interval a term and opens the nodes of
largest bound first, several at a time; a term goes on into the children that
hold some of its postings. Leaves are documents and get their exact scores; nodes
below the k-th best score found so far are never opened. A task carries its best
scores from shard to shard.

Shards are built where the documents are read, so postings are never shuffled.
Only counts of the corpus (documents, terms, document frequencies of the terms
asked for) and each task's best k go through Spark's exchanges.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.llm.common import table, written

#: Bytes of text and number of documents at which a shard is closed; a longer document is a shard by itself.
SHARD_BYTES, SHARD_DOCS = 16_000_000, 65_536
#: Characters of queries that one pass over the shards answers; more queries are dealt into several passes.
QUERY_CHARS = 16_000_000
#: Impacts are below 1,000,000; bounds hold them in steps of this size, rounded up.
STEP = 4096
#: Nodes opened at a time.
AT_ONCE = 128
#: What ends a term, as spaces; A-Z as a-z.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

SHARD = "n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<binary>, starts array<int>, tf binary, bits binary, ranks binary, bounds binary"

#: The arrays of a shard that are kept as bytes, and what they are made of.
BLOBS = {"tf": np.int64, "bits": np.uint64, "ranks": np.int32, "bounds": np.uint8}


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8").translate(_TERM_BYTES).split()


def _coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number, term number) of every term occurrence, in order, and the terms by number."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(texts).translate(_TERM_BYTES), np.uint8)
    solid = data != 32
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    start, size = edge[::2], edge[1::2] - edge[::2]
    until = np.searchsorted(start, np.cumsum(lengths + 1))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(until, prepend=0))
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
    return owner, words.indices.to_numpy().astype(np.int64), words.dictionary


def _postings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(term, text, occurrences) by term and text, the texts' lengths in terms, and the terms."""
    owner, code, words = _coded(texts)
    pair, tf = np.unique(code * len(texts) + owner, return_counts=True)
    return pair // max(len(texts), 1), pair % max(len(texts), 1), tf, np.bincount(owner, minlength=len(texts)), words


@dataclass
class Totals:
    """Counts over all documents: how many have a term, their terms with repeats, and document frequencies."""

    documents: int
    terms: int
    frequencies: dict[bytes, int] = field(default_factory=dict)

    def weight(self, term: bytes) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.frequencies.get(term, 0) + 1)))

    def damping(self, length: int) -> int:
        return 25 + (75 * length * self.documents) // self.terms


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The texts that aren't empty, about SHARD_BYTES at a time."""
    texts, held = [], 0
    for batch in batches:
        for text in batch.column(0).cast(pa.large_binary()).to_pylist():
            if text:
                texts.append(text)
                held += len(text)
                if held >= SHARD_BYTES:
                    yield texts
                    texts, held = [], 0
    if texts:
        yield texts


def totals(docs: DataFrame, asked: Iterable[bytes] = (), text_col: str = "text") -> Totals:
    """Totals of the documents, with the frequencies of the terms asked for: one row a term comes back."""
    asked = pa.array(sorted(set(asked)), pa.large_binary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, terms = np.zeros(len(asked), np.int64), 0, 0
        for texts in _parts(batches):
            code, _, _, lengths, words = _postings(texts)
            at = pc.index_in(words, asked).to_numpy(zero_copy_only=False)
            found = at[code]
            held += np.bincount(found[~np.isnan(found)].astype(np.int64), minlength=len(asked)).astype(np.int64)
            documents, terms = documents + int((lengths > 0).sum()), terms + int(lengths.sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array([None, *asked.take(some).to_pylist()], pa.binary()),
                "documents": pa.array([documents, *held[some].tolist()], pa.int64()),
                "terms": pa.array([terms, *[0] * len(some)], pa.int64()),
            }
        )

    counted = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "term binary, documents long, terms long")
    rows = counted.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).collect()
    whole = next((r for r in rows if r["term"] is None), None)
    frequencies = {bytes(r["term"]): r["documents"] for r in rows if r["term"] is not None}
    return Totals(whole["documents"], whole["terms"], frequencies) if whole else Totals(0, 0)


def _damped(lengths: np.ndarray, total: Totals) -> np.ndarray:
    return np.array([total.damping(n) for n in lengths.tolist()], np.int64)


def _impact(tf: np.ndarray, damping: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * damping)


def _height(n_docs: int) -> int:
    return max(1, int(n_docs - 1).bit_length())


def build(ids: list[int | None], texts: list[bytes], total: Totals) -> dict:
    """One shard: documents by id (those without one last), lists by term and falling impact, and the tree's levels."""
    by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    code, doc, tf, lengths, words = _postings([texts[i] for i in by_id])
    impact = _impact(tf, _damped(lengths, total)[doc])
    by_impact = np.argsort((code << 20) + (1_000_000 - impact), kind="stable")  # documents stay in order among equals
    code, doc, tf, impact = code[by_impact], doc[by_impact], tf[by_impact], impact[by_impact]
    height, n = _height(len(ids)), len(doc)
    width = n // 64 + 1
    bits, ranks = np.zeros((height, width), np.uint64), np.zeros((height, width), np.int32)
    bounds, bound = np.zeros((height, n), np.uint8), (-(-impact // STEP)).astype(np.uint8)
    doc = doc.astype(np.uint16 if height <= 16 else np.uint32)
    for level in range(height):
        prefix, bounds[level] = doc >> (height - 1 - level), bound
        padded = np.zeros(width * 64, np.uint8)
        padded[:n] = prefix & 1
        bits[level] = np.packbits(padded, bitorder="little").view(np.uint64)
        ranks[level, 1:] = np.cumsum(np.bitwise_count(bits[level]))[:-1]
        order = np.argsort(prefix, kind="stable").astype(np.int32)
        doc, bound, tf = doc[order], bound[order], tf[order]
    return {
        "n_docs": len(ids), "n_terms": n, "ids": pa.array([ids[i] for i in by_id], pa.int64()), "lengths": lengths, "terms": words.cast(pa.binary()),
        "starts": np.searchsorted(code, np.arange(len(words) + 1)).astype(np.int32), "tf": tf, "bits": bits.ravel(), "ranks": ranks.ravel(), "bounds": bounds.ravel(),
    }


def _shards(batches: Iterator[pa.RecordBatch], total: Totals, shard_bytes: int, shard_docs: int) -> Iterator[dict]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            if text and ids and (held + len(text) > shard_bytes or len(ids) >= shard_docs):
                yield build(ids, texts, total)
                ids, texts, held = [], [], 0
            if text:
                ids.append(doc_id), texts.append(text)
                held += len(text)
    if ids:
        yield build(ids, texts, total)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def index(docs: DataFrame, total: Totals, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The shards, one row each, of all documents that have a text; built lazily, without a shuffle.

    Documents are held by whole texts; null ids stay null, repeated rows are documents of their own, and other columns
    are not read. Postings keep their occurrences, so shards can be written, read again and searched by any query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, total, shard_bytes, shard_docs):
            columns = []
            for name, value in shard.items():
                if name in BLOBS:
                    columns.append(pa.array([value.tobytes()], pa.binary()))
                elif name.startswith("n_"):
                    columns.append(pa.array([value], pa.int64()))
                else:
                    items = pa.array(value) if isinstance(value, np.ndarray) else value
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items))
            yield pa.RecordBatch.from_arrays(columns, list(shard))

    return _read(docs, id_col, text_col).mapInArrow(run, SHARD)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The shards of index rows."""
    for batch in batches:
        for row in range(batch.num_rows):
            held = {name: batch.column(name)[row] for name in batch.schema.names}
            shard = {name: np.frombuffer(held[name].as_buffer(), kind) for name, kind in BLOBS.items()}
            shard |= {name: held[name].as_py() for name in ("n_docs", "n_terms")} | {name: held[name].values for name in ("ids", "terms")}
            yield shard | {name: held[name].values.to_numpy() for name in ("lengths", "starts")}


class Tree:
    """A shard ready for searches."""

    def __init__(self, shard: dict, total: Totals):
        self.n, self.height = shard["n_terms"], _height(shard["n_docs"])
        self.width = self.n // 64 + 1
        self.terms, self.ids, self.starts = shard["terms"], shard["ids"], shard["starts"]
        self.damping = _damped(shard["lengths"], total)
        self.tf, self.bits, self.ranks, self.bounds = (shard[name] for name in BLOBS)
        # the first place of each document in the order of the leaves, which is where a node's range begins on every level
        held = np.zeros(1 << self.height, np.int64)
        leaf, count = self._leaves()
        held[leaf] = count
        self.first = np.concatenate([[0], np.cumsum(held)])

    def _leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents that have postings, and how many: the root's whole range, pushed down level by level."""
        prefix, start, end = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, self.n, np.int64)
        for level in range(self.height):
            low, high = self.rank(level, start), self.rank(level, end)
            ones = high - low
            middle = end - ones
            prefix = np.stack([2 * prefix, 2 * prefix + 1], 1).ravel()
            start, end = np.stack([start, middle], 1).ravel(), np.stack([middle, end], 1).ravel()
            some = end > start
            prefix, start, end = prefix[some], start[some], end[some]
        return prefix, end - start

    def rank(self, level, place: np.ndarray) -> np.ndarray:
        """How many ones stand before a place of a level."""
        word = level * self.width + (place >> 6)
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[word] + np.bitwise_count(self.bits[word] & below)

    def best(self, left: np.ndarray, right: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best of ``best``, (score, id or None), and of this shard's documents for the terms of these intervals.

        Ties go to the smaller id, documents without an id last.
        """
        level, prefix, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, np.iinfo(np.int64).max)
        left, right = left[None, :], right[None, :]
        while len(bound):
            bar = best[-1][0] if len(best) == k else 1
            if len(bound) > AT_ONCE:
                order = np.argpartition(-bound, AT_ONCE)
                now, later = order[:AT_ONCE], order[AT_ONCE:]
            else:
                now, later = np.arange(len(bound)), np.arange(0)
            now, later = now[bound[now] >= bar], later[bound[later] >= bar]
            kids = self._opened(level[now], prefix[now], left[now], right[now])
            leaf = kids[0] == self.height
            if leaf.any():
                best = self._taken(kids, leaf, weights, k, best, bar)
            kids = [x[~leaf] for x in kids]
            at = np.minimum(kids[0][:, None] * self.n + kids[2], len(self.bounds) - 1)
            reach = np.where(kids[2] < kids[3], self.bounds[at].astype(np.int64) * STEP, 0) @ weights
            some = reach >= max(bar, 1)
            level, prefix, left, right = (np.concatenate([old[later], new[some]]) for old, new in zip((level, prefix, left, right), kids))
            bound = np.concatenate([bound[later], reach[some]])
        return best

    def _opened(self, level: np.ndarray, prefix: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        """Both children of each node: levels, prefixes and the terms' intervals, children without postings left out."""
        deep = self.height - level
        start, middle = self.first[prefix << deep], self.first[((2 * prefix + 1) << (deep - 1))]
        base = self.rank(level, start)[:, None]
        low, high = self.rank(level[:, None], left) - base, self.rank(level[:, None], right) - base
        sides = [(2 * prefix, left - low, right - high), (2 * prefix + 1, middle[:, None] + low, middle[:, None] + high)]
        made = [np.concatenate([level + 1] * 2), *(np.concatenate([a[i] for a in sides]) for i in range(3))]
        some = (made[2] < made[3]).any(axis=1)
        return [x[some] for x in made]

    def _taken(self, kids: list[np.ndarray], leaf: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, int]], bar: int) -> list[tuple[int, int]]:
        _, doc, left, right = (x[leaf] for x in kids)
        held = left < right
        tf = self.tf[np.where(held, left, 0)]
        score = np.where(held, _impact(tf, self.damping[doc][:, None]), 0) @ weights
        found = [(int(score[i]), self.ids[int(doc[i])].as_py()) for i in np.flatnonzero(score >= bar)]
        return sorted(best + found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k] if found else best


def _asked(items: list[tuple[int | None, str | None]], total: Totals) -> list[list[tuple[bytes, int]]]:
    """Each item's terms with their weights, repeats counted."""
    return [[(term, times * total.weight(term)) for term, times in sorted(Counter(terms_of(text)).items())] for _, text in items]


def _search(shards: Iterator[dict], asked: list[list[tuple[bytes, int]]], total: Totals, k: int) -> pa.RecordBatch:
    """The k best documents of all the shards of a task for each query; one shard is held at a time."""
    terms = sorted({term for query in asked for term, _ in query})
    place = {term: i for i, term in enumerate(terms)}
    queries = [(np.array([place[t] for t, _ in q], np.int64), np.array([w for _, w in q], np.int64)) for q in asked]
    wanted = pa.array(terms, pa.binary())
    best: list[list[tuple[int, int | None]]] = [[] for _ in queries]
    for shard in shards:
        tree = Tree(shard, total)
        at = pc.index_in(wanted, tree.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        for q, (codes, weights) in enumerate(queries):
            here = at[codes]
            here, own = here[here >= 0], weights[here >= 0]
            if len(here):
                best[q] = tree.best(tree.starts[here].astype(np.int64), tree.starts[here + 1].astype(np.int64), own, k, best[q])
    rows = [(q, doc_id, score) for q, found in enumerate(best) for score, doc_id in found]
    kinds = {"query": pa.int32(), "doc_id": pa.int64(), "score": pa.int64()}
    return pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})


def _best_of_all(found: DataFrame, items: list[tuple[int | None, str | None]], k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = found.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "query int, item_id long")
    return top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


FOUND = "query int, doc_id long, score long"


def search(shards: DataFrame, total: Totals, items: list[tuple[int | None, str | None]], k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of all shards for each item, a bounded list of (id, text).

    total must hold the frequencies of the items' terms. Items without a term, or whose terms no document holds, get
    no rows.
    """
    asked = _asked(items, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _search(_kept(batches), asked, total, k)

    return _best_of_all(shards.mapInArrow(run, FOUND), items, k)


def search_once(docs: DataFrame, total: Totals, items: list[tuple[int | None, str | None]], k: int, id_col: str, text_col: str, shard_bytes: int, shard_docs: int) -> DataFrame:
    """What search() finds in index(): each shard is searched by the task that builds it and then let go."""
    asked = _asked(items, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _search(_shards(batches, total, shard_bytes, shard_docs), asked, total, k)

    return _best_of_all(_read(docs, id_col, text_col).mapInArrow(run, FOUND), items, k)


def ranked(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text",
    query_chars: int = QUERY_CHARS, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, ties to the smaller id.

    Queries of up to query_chars characters are answered in one pass over the shards; more are dealt by a hash into
    blocks of about that size, each with a pass over shards that are then written once. Null and empty texts have no
    terms: such documents are in no result, such items have none. Equal rows of queries are one query, rows of one id
    and different texts each get their ranks; null ids are passed on. Repeated documents each have their place; those
    without an id come last among equal scores. Very long texts are whole shards of their own. Other columns are not
    read. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    items = queries.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{query_col}`").cast("string").alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // query_chars))
    shards, result = None, None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        held = sorted(((r["item"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
        total = totals(docs, (term for _, text in held for term in terms_of(text)), text_col)
        if not total.documents:
            break
        if blocks == 1:
            return search_once(docs, total, held, k, id_col, text_col, shard_bytes, shard_docs)
        shards = shards or written(index(docs, total, id_col, text_col, shard_bytes, shard_docs))
        found = search(shards, total, held, k)
        result = found if result is None else result.union(found)
    return result if result is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS words FROM documents),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(words))::BIGINT AS n_terms FROM docs WHERE len(words) > 0),
wanted AS (
  SELECT item_id, text, term, count(*) AS times
  FROM (SELECT item_id, text, unnest({words}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
found AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(words) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM found, total GROUP BY term, n_docs),
scored AS (
  SELECT item_id, text, rid, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(words) * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN found USING (term) JOIN weight USING (term) JOIN docs USING (rid), total GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id, rid) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 10"""


QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLES = {"op11_ranked_search": _oracle()}
