"""Best-fit packing of documents into fixed-length token sequences.

Leaves: every task tokenizes its documents, cuts the long ones and packs the
pieces best-fit, longest first. Bins that are nearly full, or that have no room
for the emptiest bin left, are final. The others become items themselves: they
meet in fewer and fewer merge groups, dealt anew each round, where best-fit runs
again until one group holds all of them. A group is a bounded number of bins; it
grows while rounds help little, up to a bound of a task's memory. Only bin numbers
and fills move between tasks; texts and ids stay in the task that read them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import durable, table
from tabularium.llm.tokens import encoder, public_vocabulary

CAPACITY = 2048
END_ID = 0
#: Merge groups grow to this many times their size while rounds help little.
WIDEST = 32


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit, largest first: (bin of each item, its offset there, fill of each bin)."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room for exactly r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += size
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return where, offset, fills


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    starts = ([0] if first else []) + list(range(first, length, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


LEAF = "id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"


def _leaf(path: str, capacity: int, end_id: int, leaf_pieces: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, base, held = encoder(path).encode_ordinary, TaskContext.get().partitionId() << 33, []

        def packed() -> pd.DataFrame:
            nonlocal base, held
            frame = pd.DataFrame(held, columns=["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
            frame["id"] = frame["id"].astype("Int64")
            where, offset, fills = best_fit(frame["length"].to_numpy(), capacity)
            frame["bin"], frame["at"], frame["fill"] = where + base, offset, np.array(fills)[where]
            base, held = base + len(fills), []
            return frame

        for batch in batches:
            for doc, text in zip(batch["id"].tolist(), batch["text"].tolist()):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for n, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    held.append((None if pd.isna(doc) else int(doc), n, start, length, zlib.crc32(part.tobytes()), *[part.astype(np.int32)] * with_ids))
            if len(held) >= leaf_pieces:
                yield packed()
        if held:
            yield packed()

    return run


def _merge(level: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([pd.DataFrame({"bin": [], "fill": []}, dtype="int64"), *batches], ignore_index=True)
        if len(frame):
            where, offset, fills = best_fit(frame["fill"].to_numpy(), capacity)
            base = (level << 57) | (TaskContext.get().partitionId() << 33)
            yield pd.DataFrame({"bin": frame["bin"], "parent": where + base, "at": offset, "fill": np.array(fills)[where]})

    return run


def _mergeable(bins: DataFrame, capacity: int) -> DataFrame:
    """The bins with room for the emptiest one; no other can ever be merged."""
    least = bins.agg(F.min("fill")).first()[0]
    return bins.where(F.col("fill") <= capacity - (least or 0))


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    slack: int = 32,
    leaf_pieces: int = 200_000,
    group_bins: int = 100_000,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A null text is an empty one: a single piece that holds the end id. Repeated rows are packed as often as they
    occur; a null id stays null. Other columns are not read. An empty table gives an empty result.
    A bin with less than ``slack`` room counts as full. A leaf packs some ``leaf_pieces`` pieces at once, a merge group
    about ``group_bins`` bins, and up to WIDEST times as many if rounds help little: bounds of a task's memory, not of
    the result. Ties are placed by bin number. Columns whose names clash with the result's are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = LEAF.replace("bin long", "ids array<int>, bin long") if with_ids else LEAF
    pieces = durable(rows.mapInPandas(_leaf(vocabulary, capacity, end_id, leaf_pieces, with_ids), schema))
    full = F.col("fill") > capacity - slack
    open_bins = _mergeable(pieces.where(~full).groupBy("bin").agg(F.first("fill").alias("fill")), capacity)
    placed = open_bins.select("bin", F.col("bin").alias("top"), F.lit(0).cast("long").alias("base"))
    count, level, size = open_bins.count(), 0, group_bins
    while count > 1:
        level += 1
        groups = -(-count // size)
        dealt = open_bins.repartition(groups, F.xxhash64("bin", F.lit(level))).sortWithinPartitions(F.desc("fill"), "bin")
        merged = durable(dealt.mapInPandas(_merge(level, capacity), "bin long, parent long, at long, fill long"))
        step = merged.select(F.col("bin").alias("top"), "parent", F.col("at").alias("more"))
        placed = placed.join(step, "top", "left").select("bin", F.coalesce("parent", "top").alias("top"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        open_bins = _mergeable(merged.where(~full).groupBy(F.col("parent").alias("bin")).agg(F.first("fill").alias("fill")), capacity)
        before, count = count, open_bins.count()
        if groups == 1:
            break
        if count > 0.98 * before:
            if size >= WIDEST * group_bins:
                break
            size *= 2
    out = pieces.join(placed, "bin", "left")
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return out.select(*names, F.coalesce("top", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pack(..., with_ids=True); a sequence is bounded by the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLES: dict[str, str] = {}
