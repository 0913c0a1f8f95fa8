import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabularium.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, rank int"
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item, rank, doc, score) by the plain formula over every document."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for doc, tf, n in held:
            score = 0
            for t in terms(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_query_equals_its_sql(spark, sf, duck, same_rows):
    same_rows(lexical.op11_ranked_search(spark, sf), duck, lexical.ORACLES["op11_ranked_search"])


@pytest.mark.parametrize("how", [{}, {"shard_docs": 2}, {"shard_bytes": 60, "query_chars": 20}, {"k": 2, "shard_docs": 3}, {"k": 1000}])
def test_odd_rows_and_any_cut_into_shards_and_passes(spark, odd, how):
    """Nulls, empty and long texts, repeats, ties, null ids: the same ranks however shards and passes are cut."""
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "same text WORD again"), (1, "same text WORD again"), (2, "ñandú same same 日本語"), (3, None), (4, ""), (5, "nowhere-to-be-found"), (None, "text here"), (6, "!!! --"), (6, "without id")]
    asked = spark.createDataFrame([(i, t, 0, 0) for i, t in items], ITEMS)
    assert rows_of(lexical.ranked(odd, asked, **how)) == brute(docs, items, how.get("k", 10))


def test_many_documents_of_few_words(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    odds = 1 / np.arange(1, 61)
    docs = [(int(i) // 2, " ".join(rng.choice(vocabulary, rng.integers(0, 40), p=odds / odds.sum()))) for i in range(700)]
    items = [(i, " ".join(rng.choice(vocabulary, 9))) for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert rows_of(lexical.ranked(df, asked)) == want
    assert rows_of(lexical.ranked(df, asked, shard_docs=37)) == want


def test_a_written_index_answers_other_queries(spark, tmp_path):
    docs = [(i, f"alpha beta{i % 7} gamma{i % 3} " * (i % 5 + 1)) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lexical.index(df, lexical.totals(df), shard_docs=8).write.parquet(str(tmp_path / "index"))
    items = [(1, "beta3 gamma1"), (2, "alpha")]
    total = lexical.totals(df, {t for _, text in items for t in lexical.terms_of(text)})
    assert rows_of(lexical.search(spark.read.parquet(str(tmp_path / "index")), total, items)) == brute(docs, items)


def test_empty_tables(spark, empty, odd):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "text", 0, 0)], ITEMS)
    assert lexical.ranked(empty, some).count() == 0 and lexical.ranked(odd, none).count() == 0
    assert lexical.ranked(spark.createDataFrame([(1, "... !"), (2, None)], "doc_id long, text string"), some).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=12), min_size=1, max_size=40), st.lists(st.sampled_from("abcdefghz"), min_size=1, max_size=9), st.integers(1, 6))
def test_tree_against_the_formula(texts, query, k):
    docs = [(i, " ".join(words)) for i, words in enumerate(texts)]
    counted = Counter(t.encode() for _, text in docs for t in set(terms(text)))
    total = lexical.Totals(sum(bool(w) for w in texts), sum(map(len, texts)), dict(counted))
    if not total.documents:
        return
    tree = lexical.Tree(lexical.build([i for i, _ in docs], [t.encode() for _, t in docs], total), total)
    place = {t: i for i, t in enumerate(tree.terms.to_pylist())}
    asked = [(place[t], n * total.weight(t)) for t, n in Counter(q.encode() for q in query).items() if t in place]
    at, weights = np.array([a for a, _ in asked], np.int64), np.array([w for _, w in asked], np.int64)
    best = tree.best(tree.starts[at].astype(np.int64), tree.starts[at + 1].astype(np.int64), weights, k, []) if len(at) else []
    assert [(0, r, d, s) for r, (s, d) in enumerate(best, 1)] == sorted(brute(docs, [(0, " ".join(query))], k), key=lambda x: x[1])
