import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import urls

PAGES = "page_id long, url string, html string"


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [(len(h + p), -n, h + p, v) for n, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def differs(part, of, all_part, all_of):
    return bool(of and all_of) and abs(part / of - all_part / all_of) > math.sqrt(math.log(40) / 2) * (of**-0.5 + all_of**-0.5)


def shown(segment):
    return "".join(f"%{ord(c):02X}" if c in "%*{|}" else c for c in segment)


def brute(rows, rules, labels, depth):
    """(page, host, path, rule, verdict, template) one page at a time over plain dictionaries."""
    said = {}
    for i, good in labels:
        said[i] = said.get(i, True) and good
    pages = []
    for i, url in rows:
        host, path = parsed(url)
        rule, verdict = rule_of(host, path, rules)
        good = verdict == "allow" if rule else said.get(i)
        pages.append({"id": i, "host": host, "path": path, "rule": rule, "ruled": verdict, "good": good, "s": [x for x in path.split("/") if x], "node": ""})
    for level in range(depth):
        nodes = defaultdict(lambda: defaultdict(list))
        for p in pages:
            if len(p["s"]) > level:
                nodes[p["host"], p["node"]][p["s"][level]].append(p)
        steps = {}
        for node, segments in nodes.items():
            total = sum(map(len, segments.values()))
            stay = {s: (len(held), sum(len(p["s"]) == level + 1 for p in held), sum(bool(p["good"]) for p in held), sum(p["good"] is not None for p in held)) for s, held in segments.items() if len(held) >= 8 and 20 * len(held) >= total}
            n, ends, good, labelled = (sum(x) for x in zip(*stay.values())) if stay else (0, 0, 0, 0)
            like = [s for s, x in stay.items() if not differs(x[1], x[0], ends, n) and not differs(x[2], x[3], good, labelled)]
            for s in stay:
                steps[node, s] = "{" + "|".join(sorted(map(shown, like))) + "}" if s in like and len(like) > 1 else shown(s)
        for p in pages:
            if len(p["s"]) > level:
                p["node"] += "/" + steps.get(((p["host"], p["node"]), p["s"][level]), "*")
    for p in pages:
        p["node"] += "/**" if len(p["s"]) > depth else ""
    count = lambda of: (Counter(of(p) for p in pages if p["good"]), Counter(of(p) for p in pages if p["good"] is not None))
    (g, n), (hg, hn) = count(lambda p: (p["host"], p["node"])), count(lambda p: p["host"])
    share = (sum(hg.values()) + 1) / (sum(hn.values()) + 2)
    out = []
    for p in pages:
        key = (p["host"], p["node"])
        purity = (g[key] + 4 * (hg[p["host"]] + 4 * share) / (hn[p["host"]] + 4)) / (n[key] + 4)
        out.append((p["id"], p["host"], p["path"], p["rule"], p["ruled"] or ("block" if purity < 0.5 else "allow"), p["node"], round(purity, 12), n[key]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r[0], r["host"], r["path"], r["rule"], r["verdict"], r["template"], round(r["purity"], 12), r["n_labelled"]) for r in df.collect()), key=repr)


def site():
    """Hosts with languages, numbered pages, an unwanted branch, a branch that ends early and deep paths."""
    rng, rows, labels = np.random.default_rng(3), [], []
    for i in range(1500):
        host = rng.choice(["a.example.net", "B.example.net", "shop.example.com", "tiny.org"], p=[0.5, 0.2, 0.28, 0.02])
        first = rng.choice(["en", "es", "de", "fr", "tag", "about"], p=[0.3, 0.2, 0.2, 0.1, 0.15, 0.05])
        tail = {"tag": f"/{rng.integers(900)}/{rng.choice(['x', 'y'])}", "about": ""}.get(first, f"/{rng.integers(5000)}")
        rows.append((i, f"http{'s' * (i % 2)}://{host}/{first}{tail}{rng.choice(['', '/', '?q=/1', '#top', '//'])}"))
        if rng.random() < 0.6:
            labels.append((i, bool(rng.random() < (0.1 if first == "tag" else 0.9))))
    rows += [(5000 + i, f"https://a.example.net/{'/'.join(f'd{j}' for j in range(i))}") for i in range(12) for _ in range(9)]
    rows += [(6000 + i, f"https://m.example.net/{s}") for s in ("a*b", "{x|y}", "100%", "ü ñ") for i in range(10)]
    return rows, labels


@pytest.mark.parametrize("rules, depth", [(urls.RULES, 6), ([], 3), ([("block", "net", "/de/"), ("allow", "a.example.net", ""), ("block", "com", "/")], 6)])
def test_equals_brute_force(spark, rules, depth):
    rows, labels = site()
    df, told = spark.createDataFrame([(*r, "") for r in rows], PAGES), spark.createDataFrame(labels + labels[:5] + [(labels[0][0], False)], "doc_id long, good boolean")
    out = urls.judge(df, rules, told, depth=depth).cache()
    want = brute(rows, rules, labels + [(labels[0][0], False)], depth)
    assert rows_of(out) == want
    if not rules:
        verdicts = {(r[1], r[5]): r[4] for r in want}
        assert verdicts["a.example.net", "/tag/*/{x|y}"] == "block" and any(n == "/{de|en|es|fr}/*" and v == "allow" for (_, n), v in verdicts.items())


@pytest.mark.parametrize(
    "url, host, path",
    [
        ("http://A.Example.NET/En/1?x=/y#z", "a.example.net", "/En/1"), ("x://h", "h", ""), ("x://h?q/a", "h", ""), ("x://h#/a", "h", ""), ("://", "", ""), ("no scheme/at/all", "", ""), (None, "", ""), ("", "", ""),
        ("http:///a/b", "", "/a/b"), ("a://b://c/d", "b:", "//c/d"), ("http://ÄÖ.de/ß", "ÄÖ.de", "/ß"), ("http://h:80/p", "h:80", "/p"), ("http://h/a\nb/c", "h", "/a\nb/c"),
    ],
)
def test_host_and_path(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "url string").select(*urls.host_and_path(F.col("url")))
    assert tuple(df.first()) == (host, path) == parsed(url)


@pytest.mark.parametrize(
    "host, path, want",
    [
        ("example.org", "/en/12", ("example.org/en/1", "block")), ("x.example.org", "/es/", ("example.org/es/", "block")), ("notexample.org", "/es/", ("org/", "allow")), ("org", "/", ("org/", "allow")),
        ("a.org", "", (None, None)), ("a.net", "/de/", (None, None)), ("a.com", "/de/1", ("com/de/", "block")), ("com", "/fr/", ("com/fr/", "allow")), ("a.com", "/fr", (None, None)), ("", "", (None, None)), ("a.org.", "/x", (None, None)),
    ],
)
def test_rules(spark, host, path, want):
    df = spark.createDataFrame([(host, path)], "host string, path string").select(urls.fitting(urls.RULES, "host", "path").alias("f"))
    assert tuple(df.select("f.rule", "f.verdict").first()) == want == rule_of(host, path, urls.RULES)


def test_sql_agrees(spark, sf, duck, same_rows, tmp_path):
    same_rows(urls.op13_url_filter(spark, sf), duck, urls.ORACLES["op13_url_filter"])
    rows, labels = site()
    spark.createDataFrame([(*r, "") for r in rows] + [(None, None, None), (1, "x", "")], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    told = [(i, int(good), 0) for i, good in labels] + [(7, None, 1), (8, 1, None), (9, None, 0), (None, 1, 0), (10, 0, 0), (10, 1, 0)]
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    c = duckdb.connect()
    for name in ("pages", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    same_rows(urls.op13_url_filter(spark, str(tmp_path)), c, urls.ORACLES["op13_url_filter"])


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None), (1, None), (None, "http://a.b/c"), (2, ""), (3, "http://a.b/" + "x/" * 20_000), (4, "http://a.b/c"), (4, "http://a.b/c")]
    schema = PAGES + ", host string, node string, segments string, _h string, good string, n_labelled int"
    df = spark.createDataFrame([(*r, "", "x", "x", "x", "x", "x", 1) for r in rows], schema)
    assert rows_of(urls.judge(df, urls.RULES)) == brute(rows, urls.RULES, [], 6)
    assert urls.judge(spark.createDataFrame([], schema), urls.RULES).count() == 0
    with pytest.raises(ValueError):
        urls.fitting([("allow", "a", str(i)) for i in range(10_001)], "host", "path")
