"""SimHash near-duplicates: 64-bit fingerprints linked by pigeonring filtering.

The 64 bits form a ring of 8 segments of 8 bits. If two fingerprints differ in at
most ``radius`` bits, some segment starts a chain of which every prefix of l
segments differs in at most floor(l * radius / 8) bits. With radius 3 the first
two segments of that chain are equal, the next ones up to the fifth hold at most
one difference between them. Equal leading segments are a join key; the longer
prefixes prune pairs before the full Hamming check.

Copies collapse to one row per fingerprint before any pairing. A bucket of a key
is compared inside one task only up to ``block`` fingerprints; larger buckets are
split into blocks, each pair of which is a task's group of its own. A group
returns a spanning forest of its links, never all pairs, and components of the
forests equal the components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import carried, durable, restored, table
from tabularium.llm.components import connected_components

SEGMENTS, WIDTH = 8, 8
SEED = 42


def simhash(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer. Words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(flat[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts)
        )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([simhash(x, shingle) for x in batch], dtype="int64")

    return run(text)


def budget(length: int, radius: int) -> int:
    return length * radius // SEGMENTS


def chain_for(count: int) -> int:
    """Segments in the key: the fewest that keep the mean bucket of evenly spread fingerprints below 512."""
    for chain in (2, 3, 4):
        if count < 512 << (WIDTH * chain - (0, 1, 1)[chain - 2]):
            return chain
    return 5


def _keys(prints: DataFrame, radius: int, chain: int) -> DataFrame:
    """Rows (bucket, turned): the fingerprint turned so that its chain starts at the top bit, and the chain's key.

    Segments of the key without budget are taken as they are. Where the budget is one bit, the key is repeated with
    each of the further bits masked, so that fingerprints one bit apart share a key.
    """
    exact = max(n for n in range(SEGMENTS + 1) if budget(n, radius) == 0)
    if chain < 1 or exact < 1 or budget(chain, radius) > 1:
        raise ValueError("the key's segments must stay within a budget of one bit")
    masks = [0] if chain <= exact else [1 << b for b in range(WIDTH * (chain - exact))]
    turns = []
    for s in range(SEGMENTS):
        turned = F.col("print") if s == 0 else F.shiftleft("print", s * WIDTH).bitwiseOR(F.shiftrightunsigned("print", 64 - s * WIDTH))
        turns.append(F.struct(F.lit(s).alias("at"), turned.alias("turned")))
    rows = prints.select(F.explode(F.array(*turns)).alias("x")).select("x.at", "x.turned")
    rows = rows.select("at", "turned", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    key = F.shiftrightunsigned("turned", 64 - WIDTH * chain).bitwiseAND(F.bitwise_not("mask"))
    return rows.select(F.xxhash64("at", "mask", key).alias("bucket"), F.col("at").cast("byte").alias("at"), "turned")


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For n nodes and links u-v, the smallest node of each one's component."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _links_of(group: np.ndarray, turned: np.ndarray, at: np.ndarray, radius: int, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between the rows of each run of equal group; rows come sorted by group."""
    n = len(group)
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    last = np.repeat(edge[1:], np.diff(edge))
    root, us, vs, held = np.arange(n), [], [], 0
    live, step = np.arange(n), 1
    while True:
        live = live[live + step < last[live]]
        if not len(live):
            break
        u = live
        apart = turned[u] ^ turned[u + step]
        for length in range(1, SEGMENTS + 1):
            ok = np.bitwise_count(apart >> np.uint64(64 - WIDTH * length)) <= (radius if length == SEGMENTS else budget(length, radius))
            u, apart = u[ok], apart[ok]
            if not len(u):
                break
        us.append(u)
        vs.append(u + step)
        held += len(u)
        step += 1
        if held > 2_000_000:
            root = forest(n, np.concatenate([*us, np.arange(n)]), np.concatenate([*vs, root]))
            us, vs, held = [], [], 0
    root = forest(n, np.concatenate([*us, np.arange(n)]), np.concatenate([*vs, root]))
    child = np.flatnonzero(root != np.arange(n))
    shift = (at.astype(np.uint64) * np.uint64(WIDTH))
    back = np.where(shift == 0, turned, (turned >> shift) | (turned << (np.uint64(64) - np.maximum(shift, np.uint64(1)))))
    return back[child].view(np.int64), back[root[child]].view(np.int64)


def _link_batches(radius: int, chain: int, rows_at_once: int = 400_000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(frame: pd.DataFrame) -> pd.DataFrame:
            u, v = _links_of(frame["pair_group"].to_numpy(), frame["turned"].to_numpy().view(np.uint64), frame["at"].to_numpy(), radius, chain)
            return pd.DataFrame({"a": u, "b": v})

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= rows_at_once:
                frame = pd.concat(held, ignore_index=True)
                group = frame["pair_group"].to_numpy()
                cut = int(np.searchsorted(group, group[-1], side="left"))
                if cut:
                    yield done(frame.iloc[:cut])
                held = [frame.iloc[cut:]]
        if held:
            yield done(pd.concat(held, ignore_index=True))

    return run


def links(prints: DataFrame, radius: int = 3, chain: int | None = None, block: int = 4096) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints within radius.

    prints has one column ``print`` (long) of distinct fingerprints without nulls.
    """
    chain = chain or chain_for(prints.count())
    rows = _keys(prints, radius, chain)
    size = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(size, "bucket").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("turned"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("pair_group"), "at", "turned")
    rows = rows.repartition("pair_group").sortWithinPartitions("pair_group")
    return rows.mapInPandas(_link_batches(radius, chain), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, chain: int | None = None) -> DataFrame:
    """(id, print, component_id) for every row of docs.

    Null and empty texts have fingerprint zero, linked like any other. component_id is the smallest non-null id
    reachable over links, null if there is none. Repeated rows and repeated ids each keep their row. Other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    marked = durable(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("print")))
    part = _rooted(durable(marked.groupBy("print").agg(F.min("id").alias("first"))), radius, chain)
    least = part.groupBy("root").agg(F.min("first").alias("component_id"))
    part = part.join(least, "root").select("print", "component_id")
    return marked.join(part, "print").select("id", "print", "component_id")


def _rooted(prints: DataFrame, radius: int, chain: int | None) -> DataFrame:
    """(print, first, root) for prints of (print, first): root is the smallest fingerprint of the component."""
    part = connected_components(links(prints.select("print"), radius, chain), "a", "b").toDF("print", "root")
    return prints.join(part, "print", "left").select("print", "first", F.coalesce("root", "print").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, chain: int | None = None) -> DataFrame:
    """One row of docs for each near-duplicate group, all columns kept.

    It is the row with the group's smallest id and, of rows with that id, the smallest text hash; a row without an id
    stays only where the group has no id at all. Of equal rows any one stays. Repeated ids in different groups each
    keep their row.
    """
    key = lambda i, text: F.struct(i.isNull().alias("unknown"), i.alias("id"), F.xxhash64(text).alias("hash"))
    marked = docs.select(key(F.col(id_col), F.col(text_col)).alias("key"), fingerprint(F.col(text_col)).alias("print"))
    part = _rooted(durable(marked.groupBy("print").agg(F.min("key").alias("first"))), radius, chain)
    stay = part.groupBy("root").agg(F.min("first").alias("key")).select("key")
    rows = docs.select(carried(docs), key(F.col(id_col), F.col(text_col)).alias("key")).join(stay, "key", "left_semi")
    return restored(rows.dropDuplicates(["key"]))  # combined before the shuffle, however often a row repeats


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLES: dict[str, str] = {}
