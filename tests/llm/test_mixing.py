import collections
import hashlib
import math

import pytest

from tabularium.llm import mixing

SF = "op1_source_mixing"


def test_query_equals_sql(spark, sf, duck, same_rows):
    same_rows(mixing.QUERIES[SF](spark, sf), duck, mixing.ORACLES[SF])


def poisson(seed, key, rate):
    parts = max(1, math.ceil(rate / mixing.PART))
    mean, total = rate / parts, 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}|{key}|{j}".encode()).hexdigest()[:13], 16) / (1 << 52)
        p = c = math.exp(-mean)
        n = 0
        while c <= u and n < mixing.TERMS:
            n += 1
            p *= mean / n
            c += p
        total += n
    return total


def test_odd_rows_against_brute_force(spark, odd):
    weights, rest = {"a": 0.5, "absent": 0.3}, 0.5
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    mass = collections.Counter()
    for _, t, s in rows:
        mass[s] += len((t or "").encode()) + 1
    total, others = sum(mass.values()), sum(v for k, v in mass.items() if k != "a")
    expected = collections.Counter()
    for i, t, s in rows:
        rate = weights["a"] / 1.0 * total / mass["a"] if s == "a" else rest / 1.0 * total / others
        key = str(i) if i is not None else "text " + hashlib.md5((t or "").encode()).hexdigest()
        for c in range(poisson(42, key, rate)):
            expected[(i, t, s, c)] += 1
    out = mixing.mix(odd, weights, rest)
    assert collections.Counter((r["doc_id"], r["text"], r["source"], r["copy"]) for r in out.collect()) == expected
    assert [c for c in out.columns if c not in ("copy", "shuffle_key")] == [c for c in odd.columns if c != "copy"]


def test_large_rates_keep_their_mean(docs_of):
    rows = [(i, "x" * 9, "en", "rare" if i < 50 else "common") for i in range(1000)]
    out = mixing.mix(docs_of(rows), {"rare": 1.0, "common": 1.0})
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(counts["rare"] - 500) < 4 * 500**0.5 and abs(counts["common"] - 500) < 4 * 500**0.5
    many = mixing.mix(docs_of(rows), {"rare": 1.0}, target_bytes=50 * 10 * 40).where("source = 'rare'").count()
    assert abs(many - 2000) < 4 * 2000**0.5


def test_empty_and_wrong_weights(empty, odd):
    assert mixing.mix(empty, {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"nobody": 1.0})


def test_no_python_in_the_plan(spark, sf):
    plan = mixing.QUERIES[SF](spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
