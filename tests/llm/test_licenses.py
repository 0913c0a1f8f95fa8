import re

from tabularium.llm import licenses

NAME = "op2_license_scan"


def test_query_equals_sql(spark, sf, duck, same_rows):
    same_rows(licenses.QUERIES[NAME](spark, sf), duck, licenses.ORACLES[NAME])


def brute(text, phrases, notices, threshold):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places, labels, score = [], set(), 0.0
    for phrase, label in phrases.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        if found:
            labels.add(label)
            score = 1.0
    base = set(labels)
    for at in range(0, max(1, len(words)), licenses.STRIDE):
        block = set(words[at : at + licenses.BLOCK])
        for label, notice in notices.items():
            t = set(notice.split())
            if len(t & block) >= threshold * len(t):
                labels.add(label)
                score = max(score, len(t & block) / len(t))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_planted_and_odd_texts(docs_of, odd):
    mit, apache = licenses.NOTICES["mit-permission"], licenses.NOTICES["apache-2-notice"]
    rows = [
        (1, "MIT License mit license, MIT LICENSE", None, None),
        (2, "filler " * 250 + mit + " tail " * 300, None, None),
        (3, " ".join(w for i, w in enumerate(mit.split()) if i % 12), None, None),
        (4, " ".join(mit.split()[:20]), None, None),
        (5, "pad " * 127 + "GNU General-Public/License " + "pad " * 500 + apache.upper(), None, None),
        (6, "the of and to in a is that for it as was with be by on not he his but at are this have from", None, None),
    ]
    for df in (docs_of(rows), odd):
        out = licenses.scan(df).collect()
        mine = sorted(map(str, [(r["id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in out]))
        theirs = sorted(map(str, [(r["doc_id"], *x[:6], round(x[6], 9)) for r in df.collect() for x in [brute(r["text"], licenses.PHRASES, licenses.NOTICES, licenses.THRESHOLD)]]))
        assert mine == theirs


def test_empty(empty):
    assert licenses.scan(empty).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = licenses.QUERIES[NAME](spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval"))
