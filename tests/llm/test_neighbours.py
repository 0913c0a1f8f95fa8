import numpy as np
from pyspark.sql import functions as F

from tabularium.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, key string, size int"


def cosines(vectors, q):
    x = vectors.astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    return (x * x[q]).sum(axis=1) / (norms * norms[q])


def brute(ids, vectors, query, k):
    x = vectors.astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    q = int(np.flatnonzero(ids == query)[0])
    score = (x * x[q]).sum(axis=1) / (norms * norms[q])
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != query]
    return ids[order[:k]].tolist(), score[order[:k]]


def test_recall_and_scores(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32)
    found = {}
    for r in neighbours.QUERIES["op3_nearest_neighbours"](spark, sf).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = total = 0
    for query in ids[ids % 50 == 0].tolist():
        near, scores = brute(ids, vectors, query, 5)
        mine = [found[query][i + 1] for i in range(5)]
        hit, total = hit + len(set(near) & {i for i, _ in mine}), total + 5
        exact = dict(zip(ids.tolist(), cosines(vectors, int(np.flatnonzero(ids == query)[0]))))
        assert np.allclose([s for _, s in mine], [exact[i] for i, _ in mine], atol=1e-12)
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0])) and query not in [i for i, _ in mine]
        assert np.allclose(mine[0][1], scores[0]) or mine[0][1] < scores[0]
    assert hit / total >= 0.98


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 12)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 3]] if i < 300 else [float(x) for x in base[i % 40]], "x", 1) for i in range(600)]
    rows += [(1000, None, "x", 1), (1001, [0.0] * 12, "x", 1), (1002, [None] + [1.0] * 11, "x", 1), (1003, [float("nan")] * 12, "x", 1), (1004, [1.0, 2.0], "x", 1), (None, [1.0] * 12, "x", 1), rows[0], rows[100]]
    df = spark.createDataFrame(rows, SCHEMA)
    out = neighbours.nearest(df, df.where(F.col("vec_id") % 50 == 0).select("vec_id"), code_block=7, query_block=3)
    found = {}
    for r in out.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    ids = np.arange(600)
    vectors = np.array([r[1] for r in rows[:600]], dtype=np.float32)
    assert sorted(found) == list(range(0, 600, 50))
    for query in found:
        near, scores = brute(ids, vectors, query, 5)
        mine = sorted(found[query])
        assert [i for _, i, _ in mine] == near and np.allclose([s for *_, s in mine], scores)


def test_huge_and_tiny_components(spark):
    """Finite doubles whose squares overflow or vanish are vectors like any other; their cosines are those of the scaled ones."""
    base = np.random.default_rng(2).standard_normal((30, 6))
    rows = [(i, [float(y) for y in base[i] * s], "", 1) for i, s in enumerate([1e200, 1e-200, 1.0, 1e307, 1e-300] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string, size int")
    out = neighbours.nearest(df, df.select("vec_id")).collect()
    assert len(out) == 150
    for query in range(30):
        near, scores = brute(np.arange(30), base, query, 5)
        mine = sorted((r["rank"], r["id"], r["score"]) for r in out if r["query_id"] == query)
        assert [i for _, i, _ in mine] == near and np.allclose([s for *_, s in mine], scores)


def test_scaled_copies_tie_by_id(spark):
    rows = [(i, [float(1 << i), 0.0], "", 1) for i in range(20)] + [(100, [1.0, 1.0], "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = neighbours.nearest(df, df.where("vec_id IN (7, 100)").select("vec_id"), code_block=4).collect()
    found = {q: [r["id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (7, 100)}
    assert found == {7: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}


def test_empty_and_few(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(df, df.select("vec_id")).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], "", 1), (1, [0.0, 1.0], "", 1)], SCHEMA)
    assert [(r["query_id"], r["rank"], r["id"]) for r in neighbours.nearest(two, two.where("vec_id = 0").select("vec_id")).collect()] == [(0, 1, 1)]


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal((20, 64))
    centre = np.zeros(64)
    bits, length, own = neighbours.encode(x, centre)
    near, error = neighbours.estimates(bits, length, own, q, centre)
    exact = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    assert abs((near - exact).mean()) < 2e-3 and (abs(near - exact) <= error).mean() > 0.98
