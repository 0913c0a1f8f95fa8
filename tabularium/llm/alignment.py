"""Cross-tokenizer alignment: token interval tables per Arrow batch, joined in DuckDB; counts of id pairs merged in Spark.

Texts are cut where both tokenizers start anew: before a single space between two
characters that are no white space. Such pieces repeat, so each distinct one is
encoded once by tokenizer A (byte-level) and B (sentence pieces); a worker keeps
what it found for a bounded number of them. The new pieces of a batch are laid on
one byte axis, and DuckDB works on their two interval tables:

* ASOF joins give each A token the first and the last B token that it overlaps,
  a range join between both gives all overlaps;
* overlaps that end at the same byte are links, and their ends cut both token
  lists into groups, numbered by window sums.

Texts whose pieces don't give back their bytes are encoded again as one piece. A
text for which that fails, too, has no tokens.

Each text's digest and its linked pairs, one number a pair, are written once. From
these, tasks add up how often each pair is linked and Spark merges their sums.
Linked tokens end together, so the bytes of one end with those of the other, and
the number of pairs is bounded by the vocabularies' bytes, not by the corpus. That
table goes to the tasks that give each text's links their counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import table, written
from tabularium.llm.tokens import _bytes_of, encoder, public_vocabulary

#: Bytes of text that are aligned at a time; a longer text is a batch by itself.
BATCH_BYTES = 1_000_000
#: How many pieces, and bytes of pieces, a worker knows at most; beyond, it forgets all and starts anew.
KNOWN, KNOWN_BYTES = 250_000, 5_000_000
#: Fixed value: the character that stands for a space in sentence pieces.
SPACE = "▁"

ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
PAIRS = "pair long, n long"

_SPANS = """
CREATE OR REPLACE TEMP TABLE spans AS
SELECT a.piece, a.place, a.id, a.stop, f.place AS first, l.place AS last
FROM a ASOF JOIN b f ON f.start <= a.start ASOF JOIN b l ON l.start < a.stop"""
_OVERLAPS = """
SELECT s.piece, s.place AS a_place, b.place AS b_place, s.id AS a, b.id AS b, s.stop = b.stop AS link
FROM spans s JOIN b ON b.place BETWEEN s.first AND s.last"""
_LINKS = f"CREATE OR REPLACE TEMP TABLE links AS SELECT piece, a_place, b_place, a, b FROM ({_OVERLAPS}) WHERE link"
_PAIRS = "SELECT piece, (a::BIGINT << 32) | b AS pair FROM {found} ORDER BY piece"
_PARTS = """
SELECT coalesce(sum(ends::INTEGER) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part
FROM (SELECT place, place IN (SELECT {side}_place FROM links) AS ends FROM {side}) ORDER BY place"""


class Side:
    """One tokenizer: ids of pieces, and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]):
        self.encode = encode
        self.tokens = pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(t) for t in tokens], np.int64)

    def laid(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many of each text, whether the text's tokens give back its bytes)."""
        counts, ids = [], []
        for at in range(0, len(texts), 20_000):  # few lists of ids at a time
            lists = self.encode(texts[at : at + 20_000])
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.int32, int(counts[-1].sum())))
        counts, ids = np.concatenate(counts), np.concatenate(ids)
        owner = np.repeat(np.arange(len(texts)), counts)
        good = np.bincount(owner, self.sizes[ids], minlength=len(texts)).astype(np.int64) == np.diff(offsets)
        said = np.frombuffer(self.tokens.take(pa.array(ids[good[owner]])).buffers()[2] or b"", np.uint8)
        size = np.diff(offsets)
        wrong = np.flatnonzero(said != data[np.repeat(good, size)])
        if len(wrong):
            good[np.flatnonzero(good)[np.searchsorted(np.cumsum(size[good]), wrong, side="right")]] = False
        return ids, counts, good


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """A, a byte-level tokenizer file (.json), and B, a sentence piece model; both encode a piece as if after a space."""
    whole, pieces = encoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    with open(path_a, encoding="utf-8") as file:
        said = json.load(file)
    byte, added = _bytes_of(), {t["id"]: t["content"].encode() for t in said["added_tokens"]}
    named = {n: token for token, n in said["model"]["vocab"].items()}
    tokens_a = [added[n] if n in added else bytes(byte[c] for c in named[n]) if n in named else b"" for n in range(max(*named, *added) + 1)]

    def bytes_of(n: int) -> bytes:
        piece = pieces.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(n) else piece.replace(SPACE, " ").encode()

    encode_a = lambda texts: [whole.encode_plain(" " + t) for t in texts]
    encode_b = lambda texts: pieces.encode(texts, num_threads=1)
    return Side(encode_a, tokens_a), Side(encode_b, [bytes_of(n) for n in range(pieces.get_piece_size())])


def pair_bound(path_a: str, path_b: str) -> int:
    """More pairs than can ever be linked: of two tokens that end together, one's bytes end with the other's."""
    a, b = sides(path_a, path_b)
    ids: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
    for side, held in zip((a, b), ids):
        for token in side.tokens.to_pylist():
            held[token] = held.get(token, 0) + 1
    total = 0
    for side, other in ((0, 1), (1, 0)):
        for token, n in ids[side].items():
            total += n * sum(ids[other].get(token[i:], 0) for i in range(side, len(token)))  # equal bytes count once
    return total


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of the spaces at which pieces begin: single ones, between an ASCII or two-byte character and one that
    cannot be white space. Fewer cuts than possible are right, too; the pieces are only longer then."""
    at = np.flatnonzero(data[1:-1] == 32) + 1
    after, before, lead = data[at + 1], data[at - 1], data[np.maximum(at - 2, 0)]
    plain = (before > 32) & (before < 0x7F)
    two = (before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
    next_plain = ((after > 32) & (after < 0x7F)) | ((after >= 0xC3) & (after <= 0xDF))
    return at[(plain | two) & next_plain]


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of runs that start somewhere and have so many places each, one run after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


@lru_cache(maxsize=1)
def _duck() -> duckdb.DuckDBPyConnection:
    """One small engine a worker; it never writes to disk, its batches are bounded."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


class Known:
    """What is known of pieces: tokens, groups, the groups' ids as text, linked pairs, and whether the bytes come back."""

    NUMBERS = ("n_a", "n_b", "n_groups", "good")

    def __init__(self, a: Side, b: Side, link: str):
        self.a, self.b, self.link = a, b, link
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bytes = 0
        self.numbers = {name: np.zeros(0, np.int64) for name in self.NUMBERS}
        self.ends = {"text": np.zeros(1, np.int64), "pairs": np.zeros(1, np.int64)}
        self.runs = {"text": np.zeros(0, np.uint8), "pairs": np.zeros(0, np.int64)}

    def places(self, pieces: Sequence[bytes]) -> np.ndarray:
        """Where each of these distinct pieces is known; those that are new are aligned first."""
        if len(self.place) + len(pieces) > KNOWN or self.bytes > KNOWN_BYTES:
            self.forget()
        new = [p for p in pieces if p not in self.place]
        if new:
            self._learn(new)
        return np.fromiter((self.place[p] for p in pieces), np.int64, len(pieces))

    def _learn(self, new: list[bytes]) -> None:
        texts, offsets = [p[1:].decode() for p in new], np.concatenate([[0], np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))])
        data = np.frombuffer(b"".join(new), np.uint8)
        (ids_a, n_a, good_a), (ids_b, n_b, good_b) = self.a.laid(texts, data, offsets), self.b.laid(texts, data, offsets)
        good = good_a & good_b
        intervals = [_interval(side, ids, n, good) for side, ids, n in ((self.a, ids_a, n_a), (self.b, ids_b, n_b))]
        groups, counts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        text, ends, pairs = np.zeros(0, np.uint8), np.zeros(len(new) + 1, np.int64), np.zeros(0, np.int64)
        if good.any():
            duck = _duck()
            for name, interval in zip("ab", intervals):
                duck.register(name, interval)
            duck.execute(_SPANS), duck.execute(_LINKS)
            groups, ends, text = told(grouped(intervals), len(new))
            found = duck.execute(_PAIRS.format(found="links" if self.link == "end" else f"({_OVERLAPS})")).fetchnumpy()
            counts, pairs = np.bincount(found["piece"], minlength=len(new)), found["pair"].astype(np.int64)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.bytes += int(offsets[-1])
        for name, values in zip(self.NUMBERS, (n_a, n_b, groups, good)):
            self.numbers[name] = np.concatenate([self.numbers[name], values])
        for name, run, until in (("text", text, ends[1:]), ("pairs", pairs, np.cumsum(counts))):
            self.ends[name] = np.concatenate([self.ends[name], until + self.ends[name][-1]])
            self.runs[name] = np.concatenate([self.runs[name], run])

    def runs_of(self, name: str, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the runs of these places one after the other, how long each is)."""
        start = self.ends[name][places]
        counts = self.ends[name][places + 1] - start
        return self.runs[name][_places(start, counts)], counts


def _interval(side: Side, ids: np.ndarray, counts: np.ndarray, good: np.ndarray) -> pa.Table:
    """The tokens of all good pieces, one after the other: place, piece, id and their bytes from start to stop."""
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    stay = good[owner]
    ids, owner = ids[stay], owner[stay]
    stop = np.cumsum(side.sizes[ids])
    return pa.table({"place": np.arange(len(ids)), "piece": owner, "id": ids, "start": stop - side.sizes[ids], "stop": stop})


def grouped(intervals: list[pa.Table]) -> dict[str, np.ndarray]:
    """part, side (A: 0), piece and id of every token whose links are found, by part, side and place."""
    parts = [_duck().execute(_PARTS.format(side=side)).fetchnumpy()["part"] for side in "ab"]
    # both sides are in order: a token comes after all of the other side's earlier parts, B after A within one
    places = [np.searchsorted(other, own, side=way) + np.arange(len(own)) for own, other, way in ((parts[0], parts[1], "left"), (parts[1], parts[0], "right"))]
    held = {"part": parts, "side": [np.full(len(p), n, np.int8) for n, p in enumerate(parts)]}
    held |= {name: [table[name].to_numpy() for table in intervals] for name in ("piece", "id")}
    merged = {name: np.empty(len(parts[0]) + len(parts[1]), values[0].dtype) for name, values in held.items()}
    for name, values in held.items():
        for at, own in zip(places, values):
            merged[name][at] = own
    return merged


def told(found: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many groups each of n pieces has, and their ids as text, ``a,a|b;`` a group: where pieces end, and the bytes."""
    part, side, piece = found["part"], found["side"], found["piece"]
    last = np.concatenate([part[1:] != part[:-1], [True]])
    turn = np.concatenate([side[1:] != side[:-1], [True]])
    mark = pa.array([",", "|", ";"], pa.large_string()).take(pa.array(np.where(last, 2, np.where(turn, 1, 0))))
    said = pc.binary_join_element_wise(pa.array(found["id"]).cast(pa.large_string()), mark, pa.scalar("", pa.large_string()))
    ends = np.frombuffer(said.buffers()[1], np.int64)[: len(said) + 1]
    until = np.searchsorted(piece, np.arange(n), side="right")  # pieces follow each other as their groups do
    return np.bincount(piece[last], minlength=n), np.concatenate([[0], ends[until]]), np.frombuffer(said.buffers()[2], np.uint8)[: ends[-1]]


def pieces_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct pieces of the texts, each text with a space before it; all pieces in order; where each text's end)."""
    data = np.frombuffer(b"".join(chain.from_iterable((b" ", t) for t in texts)), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    begins = np.concatenate([[0], ends[:-1]])
    starts = np.sort(np.concatenate([begins, cuts(data)]), kind="stable")  # two sorted runs: merged, where unique would sort
    starts = starts[np.diff(starts, prepend=-1) > 0]
    offsets = np.concatenate([starts, [len(data)]]).astype(np.int64)
    held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return held.dictionary.to_pylist(), held.indices.to_numpy().astype(np.int64), np.searchsorted(starts, ends)


def aligned(texts: list[bytes], known: Known) -> dict[str, list | np.ndarray]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each text, none of them empty."""
    pieces, order, until = pieces_of(texts)
    places = known.places(pieces)[order]
    begins = np.concatenate([[0], until[:-1]]).astype(np.int64)
    rows = _rows(known, places, begins, until)
    for n in np.flatnonzero(~rows.pop("good")):
        again = _rows(known, known.places([b" " + texts[n]]), np.zeros(1, np.int64), np.ones(1, np.int64))
        none = {"groups_sha256": "", "pairs": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
        ok = again.pop("good")[0]
        for name, value in again.items():
            rows[name][n] = value[0] if ok else none.get(name, 0)
    return rows


def _rows(known: Known, places: np.ndarray, begins: np.ndarray, until: np.ndarray) -> dict[str, list | np.ndarray]:
    rows = {name: np.add.reduceat(known.numbers[name][places], begins) for name in ("n_a", "n_b", "n_groups")}
    rows["good"] = np.logical_and.reduceat(known.numbers["good"][places].astype(bool), begins)
    text, size = known.runs_of("text", places)
    text, ends = memoryview(text), np.concatenate([[0], np.cumsum(size)])
    rows["groups_sha256"] = [hashlib.sha256(text[ends[i] : max(ends[j] - 1, ends[i])]).hexdigest() for i, j in zip(begins, until)]
    pairs, counts = known.runs_of("pairs", places)
    ends = np.concatenate([[0], np.cumsum(counts)])
    kinds, code = np.unique(pairs, return_inverse=True)
    owner = np.repeat(np.arange(len(begins)), ends[until] - ends[begins])
    met, times = np.unique(owner * max(len(kinds), 1) + code, return_counts=True)
    rows["n_links"] = ends[until] - ends[begins]
    cut = np.searchsorted(met, np.arange(1, len(begins)) * max(len(kinds), 1))
    rows["pairs"], rows["times"] = np.split(kinds[met % max(len(kinds), 1)] if len(met) else met, cut), np.split(times, cut)
    return rows


@lru_cache(maxsize=2)
def _known(path_a: str, path_b: str, link: str) -> Known:
    return Known(*sides(path_a, path_b), link)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def alignments(
    docs: DataFrame, path_a: str, path_b: str, link: str = "end", id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times.

    pairs are the text's distinct linked pairs of ids (A's id times 2 to the 32 plus B's), times how often each. Tokens
    are linked if their bytes end together or, with link="overlap", if they share any. Null and empty texts, and those
    whose tokens don't give back their bytes, have zeros, no pairs and an empty digest. Null ids are passed on, repeated
    rows each get their row, very long texts are batches of their own; other columns are not read. An empty table gives
    an empty result.
    """
    if link not in ("end", "overlap"):
        raise ValueError("link is end or overlap")

    def made(ids: list, texts: list[bytes | None]) -> pa.RecordBatch:
        full = np.flatnonzero([bool(t) for t in texts])
        rows = aligned([texts[i] for i in full], _known(path_a, path_b, link)) if len(full) else {}
        columns = {}
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            columns[name] = np.zeros(len(ids), np.int64)
            columns[name][full] = rows.get(name, [])
        said, sizes = np.full(len(ids), "", object), np.zeros(len(ids), np.int64)
        said[full], sizes[full] = rows.get("groups_sha256", []), [len(p) for p in rows.get("pairs", [])]
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *rows.get(name, [])]), kind)) for name, kind in (("pairs", pa.int64()), ("times", pa.int32()))]
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), **columns, "groups_sha256": pa.array(said, pa.string()), "pairs": lists[0], "times": lists[1]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                if ids and held + len(text.as_buffer() or b"") > batch_bytes:
                    yield made(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id), texts.append(text.as_py())
                held += len(texts[-1] or b"")
        if ids:
            yield made(ids, texts)

    return _read(docs, id_col, text_col).mapInArrow(run, ALIGNED)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times) of all links of a batch."""
    sizes = batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(batch.num_rows), sizes)
    return owner, batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how often each pair of ids is linked over all alignments; tasks add up first, one number a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, pair, times = _flat(batch)
            keys, at = np.unique(np.concatenate([keys, pair]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, times]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"pair": keys, "n": sums})

    return rows.select("pairs", "times").mapInArrow(run, PAIRS).groupBy("pair").agg(F.sum("n").alias("n"))


def pairs(docs: DataFrame, path_a: str, path_b: str, link: str = "end", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(a, b, n): how often over all texts ids of A and B are linked; see alignments() for links and odd rows."""
    rows = alignments(docs.withColumn("_none", F.lit(None).cast("long")), path_a, path_b, link, "_none", text_col, batch_bytes)
    return pair_counts(rows).select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The alignments by ends, each with n_best and count_sum in the place of its pairs.

    A link's count is how often its pair of ids is linked in all of docs; n_best counts the links whose pair is its B
    id's most frequent one, ties included, count_sum adds the counts of all links. Odd rows are those of alignments().

    The pairs' counts are held by every task: at most ``pair_bound`` rows, whatever the corpus.
    """
    rows = written(alignments(docs, path_a, path_b, "end", id_col, text_col, batch_bytes))
    found = pair_counts(rows).toArrow().sort_by("pair")
    pair, n = found["pair"].to_numpy(), found["n"].to_numpy()
    b = pair & 0xFFFFFFFF
    most = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, b, n)
    held = rows.sparkSession.sparkContext.broadcast((pair, n, n == most[b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for batch in batches:
            owner, met, times = _flat(batch)
            at = np.searchsorted(pair, met)
            sums = np.zeros((2, batch.num_rows), np.int64)
            if len(at):
                np.add.at(sums[0], owner, times * best[at])
                np.add.at(sums[1], owner, times * n[at])
            columns = {name: batch.column(name) for name in ("id", "n_a", "n_b", "n_groups", "n_links")}
            yield pa.RecordBatch.from_pydict(columns | {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": batch.column("groups_sha256")})

    return rows.mapInArrow(run, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return align(docs, public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
