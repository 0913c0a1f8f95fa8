import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabularium.llm import simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(prints, radius=3):
    """Smallest position reachable over links, by trying all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", "a", "A b", "one two three", "Uno dos tres cuatro", "ÑANDÚ\x0bx y\x1fz", "x " * 50_000])
def test_fingerprint(text):
    assert simhash.simhash(text) % (1 << 64) == fingerprint(text)


@pytest.mark.parametrize("chain,block", [(2, 4096), (3, 5), (4, 2), (5, 3)])
def test_links_have_the_components_of_all_pairs(spark, chain, block):
    rng = np.random.default_rng(3)
    prints = set()
    for base in rng.integers(0, 1 << 63, 60).tolist():
        now = base
        for _ in range(rng.integers(1, 8)):
            prints.add(now)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                now ^= 1 << bit
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    out = simhash.connected_components(simhash.links(df, chain=chain, block=block), "a", "b").collect()
    mine = {}
    for r in out:
        mine.setdefault(r["root"], set()).add(r["node"])
    theirs = {}
    for p, c in zip(signed, components(prints)):
        theirs.setdefault(c, set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(g) for g in theirs.values() if len(g) > 1)


def test_query_against_all_pairs(spark, sf, documents):
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [fingerprint(r["text"]) for r in rows]
    expected = {(r["doc_id"], f"{p:016x}", rows[c]["doc_id"]) for r, p, c in zip(rows, prints, components(prints))}
    assert {tuple(r) for r in simhash.QUERIES["op8_simhash_near_dedup"](spark, sf).collect()} == expected


def test_odd_rows(odd, empty):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    by_id = {r["id"]: r for r in out}
    assert by_id[1]["print"] == by_id[2]["print"] == by_id[3]["print"] == 0 and by_id[3]["component_id"] == 1
    assert by_id[7]["component_id"] == 6
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 5, 6, 8, 9]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_copies_do_not_multiply_pairs(docs_of):
    df = docs_of([(i, "the same words in every copy of this text", "en", "a") for i in range(5000)])
    out = simhash.near_duplicates(df).agg(F.count("*").alias("n"), F.max("component_id").alias("c")).first()
    assert (out["n"], out["c"]) == (5000, 0)


def test_groups_without_ids_each_keep_one(docs_of):
    texts = ["the first of two texts that nobody gave an id", "quite another one without id that is about rivers", "a document with an id and a copy without", "words under an id that is given twice"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (4, texts[2]), (None, texts[2]), (3, texts[2]), (3, texts[3]), (None, None), (None, "")]
    kept = simhash.keep_one(docs_of([(i, t, "en", "a") for i, t in rows]))
    out = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    assert sorted(out, key=str) == sorted([(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (None, "")], key=str)
