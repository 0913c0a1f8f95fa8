"""Approximate nearest neighbours by randomly rotated one-bit codes.

Unit vectors are centred, rotated at random and kept as one sign bit per
dimension, with two scalars: the residual's length and its inner product with its
own code. From bits and scalars the inner product with any query is estimated
without bias, within a known error bound. In every block of queries and codes,
vectors whose upper bound reaches the best lower bounds are reranked exactly; all
others are never compared in full.

Every query meets every code, in blocks of bounded size: on vectors without
clusters, cells of an inverted file lose neighbours (half of the cells searched
found under 0.95 of them), while the bits of all vectors are cheap to scan. Equal
vectors are one class with its smallest ids, so copies are neither coded nor
compared again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.common import durable, table

SEED = 42
#: Error bounds hold this many standard deviations of an estimate.
DEVIATIONS = 2.5
CODE_BLOCK, QUERY_BLOCK = 16_384, 4_096


@lru_cache(maxsize=4)
def rotation(dimensions: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def _stack(column: pd.Series, dtype: str) -> np.ndarray:
    """The vectors as rows of doubles, each scaled by a power of two so that squares neither overflow nor vanish.

    Such a scale changes no digit, and cosines do not depend on it.
    """
    rows = np.frombuffer(b"".join(column), dtype).reshape(len(column), -1).astype(np.float64)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def encode(vectors: np.ndarray, centre: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, residual length, residual's inner product with its code) of each row."""
    d = vectors.shape[1]
    residual = _units(vectors) - centre
    length = np.sqrt((residual * residual).sum(axis=1))
    turned = residual @ rotation(d, seed).T / np.maximum(length, 1e-30)[:, None]
    own = np.abs(turned).sum(axis=1) / np.sqrt(d)
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, own, 1.0)


def estimates(bits: np.ndarray, length: np.ndarray, own: np.ndarray, queries: np.ndarray, centre: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosine, error bound) of each query (row) with each code (column)."""
    d = queries.shape[1]
    units = _units(queries)
    signs = (np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
    inner = (units @ rotation(d, seed).T).astype(np.float32) @ signs.T
    scale = (length / own).astype(np.float32)
    error = length * np.sqrt(np.maximum(1 - own * own, 0)) / own * DEVIATIONS / np.sqrt(max(d - 1, 1))
    return (units @ centre).astype(np.float32)[:, None] + inner * scale, error.astype(np.float32) + np.float32(1e-5)


def best(codes: dict[str, np.ndarray], queries: np.ndarray, centre: np.ndarray, least: int, seed: int = SEED, at_once: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, cosine) of the ``least`` nearest codes of each query; ties go to the code of the smaller ``first``."""
    rows, columns, scores = [], [], []
    norms = np.sqrt((codes["vectors"] ** 2).sum(axis=1))
    for at in range(0, len(queries), at_once):
        part = queries[at : at + at_once]
        near, error = estimates(codes["bits"], codes["length"], codes["own"], part, centre, seed)
        if near.shape[1] > least:
            bar = np.partition(near - error, -least, axis=1)[:, -least]
            q, c = np.nonzero(near + error >= bar[:, None])
        else:
            q, c = (x.ravel() for x in np.indices(near.shape))
        own = np.sqrt((part * part).sum(axis=1))
        exact = (codes["vectors"][c] * part[q]).sum(axis=1) / (norms[c] * own[q])
        order = np.lexsort((codes["first"][c], -exact, q))
        q, c, exact = q[order], c[order], exact[order]
        stay = np.arange(len(q)) - np.searchsorted(q, np.arange(len(part)))[q] < least
        rows.append(q[stay] + at), columns.append(c[stay]), scores.append(exact[stay])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(scores)


def _clean(dtype: str):
    """id, length, key and bytes of every vector of finite numbers that are not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype) + np.dtype(dtype).type(0)  # null: NaN; -0 and 0 are one
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            good = (np.bincount(owner, ~np.isfinite(flat), minlength=len(size)) == 0) & (np.bincount(owner, flat != 0, minlength=len(size)) > 0)
            data, width, rows = flat.tobytes(), flat.dtype.itemsize, np.flatnonzero(good)
            vectors = [data[width * a : width * (a + n)] for a, n in zip(start[rows].tolist(), size[rows].tolist())]
            keys = [hashlib.md5(v).hexdigest() for v in vectors]
            columns = [batch.column("id").take(pa.array(rows)), pa.array(size[rows], pa.int32()), pa.array(keys, pa.string()), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "size", "key", "vector"])

    return run


def _sums(dtype: str):
    """Per task, the sum of its unit vectors by dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = 0.0, 0
        for batch in batches:
            if len(batch):
                total, n = total + _units(_stack(batch["vector"], dtype)).sum(axis=0), n + len(batch)
        if n:
            yield pd.DataFrame({"place": np.arange(len(total)), "total": total, "n": n})

    return run


def _encode(dtype: str, centre: np.ndarray, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                bits, length, own = encode(_stack(batch["vector"], dtype), centre, seed)
                yield batch.assign(bits=[x.tobytes() for x in bits], length=length, own=own)

    return run


def _search(dtype: str, centre: np.ndarray, least: int, seed: int):
    def run(codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if codes.empty or queries.empty:
            return pd.DataFrame({"query": [], "ids": [], "score": []})
        held = {"bits": np.frombuffer(b"".join(codes["bits"]), np.uint8).reshape(len(codes), -1), "length": codes["length"].to_numpy(), "own": codes["own"].to_numpy(), "first": codes["ids"].map(lambda ids: ids[0]).to_numpy(), "vectors": _stack(codes["vector"], dtype)}
        q, c, score = best(held, _stack(queries["query_vector"], dtype), centre, least, seed)
        return pd.DataFrame({"query": queries["query_key"].to_numpy()[q], "ids": codes["ids"].to_numpy()[c], "score": score})

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: int = SEED,
    code_block: int = CODE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): the k rows of vectors of largest cosine for each id of queries, its own row left out.

    queries has one column of ids of vectors. Vectors null, zero or with null or non-finite components, those whose
    length is not the most frequent one (the smaller of two), and rows without an id take no part. Ties go to the
    smaller id. Repeated rows count once; ids name vectors. Fewer candidates than k give fewer ranks; no candidates or
    queries give an empty result. Other columns are not read.
    """
    dtype = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = durable(rows.mapInArrow(_clean(dtype), "id long, size int, key string, vector binary"))
    common = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    size = common["size"] if common else 1
    rows = rows.where(F.col("size") == size)

    # the k + 1 smallest ids of a class are all that any query needs of it
    rank = F.dense_rank().over(Window.partitionBy("key").orderBy("id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    classes = few.groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("vector").alias("vector"))
    sums = rows.mapInPandas(_sums(dtype), "place int, total double, n long").groupBy("place").agg((F.sum("total") / F.sum("n")).alias("mean"))
    centre = np.zeros(size)
    for r in sums.collect():
        centre[r["place"]] = r["mean"]
    codes = durable(classes.mapInPandas(_encode(dtype, centre, seed), "key string, ids array<long>, vector binary, bits binary, length double, own double"))

    asked = rows.join(queries.toDF("asked").where("asked IS NOT NULL").distinct(), F.col("id") == F.col("asked"), "left_semi").select("id", "key").distinct()
    asked = durable(asked)
    wanted = codes.join(asked.select("key").distinct(), "key", "left_semi").select("key", "vector")
    code_blocks, query_blocks = max(1, -(-codes.count() // code_block)), max(1, -(-wanted.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocked = codes.withColumn("c", F.pmod(F.xxhash64("key"), F.lit(code_blocks)).cast("int")).withColumn("q", every(query_blocks))
    asking = wanted.withColumn("q", F.pmod(F.xxhash64("key"), F.lit(query_blocks)).cast("int")).withColumn("c", every(code_blocks))
    asking = asking.select(F.col("key").alias("query_key"), F.col("vector").alias("query_vector"), F.col("q").alias("query_q"), F.col("c").alias("query_c"))
    pairs = blocked.groupBy("c", "q").cogroup(asking.groupBy("query_c", "query_q")).applyInPandas(_search(dtype, centre, k + 1, seed), "query string, ids array<long>, score double")

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    top = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("query", "score", F.explode("ids").alias("found"))
    found = asked.withColumnRenamed("id", "query_id").join(top, F.col("key") == F.col("query")).where("found <> query_id")
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "found")
    found = found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("found").alias("id"), "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where(F.col("vec_id") % 50 == 0).select("vec_id")
    return nearest(vectors, queries).withColumnRenamed("id", "vec_id")


QUERIES = {"op3_nearest_neighbours": op3_nearest_neighbours}
ORACLES: dict[str, str] = {}
