"""URL filters: listed rules first, then a tree of path templates for each host, judged by labelled pages.

Paths are cut into segments and laid into one tree a host, level by level. At a
node, a segment that holds a share of the node's pages stays as it is; all others
(ids, names, dates) become one wildcard. Of the segments that stay, those whose
shares of good pages and of pages that end there do not differ from the node's as
a whole, by Hoeffding's bound, are merged into one branch, whose subtrees are then
counted together.

A template, a path through the tree, is rejected if its share of good pages among
the labelled ones is too small. The share is smoothed by its host's, and that by
the share of all hosts, so a template without labels follows its host.

Each level is a count by host, node and segment, combined before it is shuffled;
what a level decides is a small table (at most 1 / SHARE segments a node) that the
next level joins to the narrow table of pages.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import broadcast_if_small, table, written

# Fixed values: (verdict, host, beginning of the path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Levels of a tree; what follows in a longer path is one tail.
DEPTH = 6
#: A segment stays if it has at least this many pages and one in SHARE of its node's.
LEAST, SHARE = 8, 20
#: sqrt(ln(2 / 0.05) / 2): Hoeffding's factor for one error in twenty.
HOEFFDING = 1.3581015157406195
#: Pages that the host's share of good ones counts as, and the share below which a template is rejected.
PRIOR, PURITY = 4, 0.5
RULES_AT_MOST = 10_000
WILDCARD, TAIL = "*", "/**"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands after the first ://, up to the first of / ? # (A-Z lower-cased), then up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    lower = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return lower, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(rules: Sequence[tuple[str, str, str]], host: str, path: str) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), ties to the one listed first; null if none does.

    Rules are found by the host's suffixes, each a look-up in a table by host, then by the path's beginning.
    """
    if len(rules) > RULES_AT_MOST:
        raise ValueError(f"at most {RULES_AT_MOST} rules are held in a plan")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list[Column]] = {}
    for place, (verdict, rule_host, rule_path) in enumerate(rules):
        rule = rule_host + rule_path
        by_host.setdefault(rule_host, []).append(
            F.struct(F.lit(len(rule)).alias("length"), F.lit(-place).alias("place"), F.lit(rule_path).alias("path"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        )
    held = F.create_map(*[c for name, found in by_host.items() for c in (F.lit(name), F.array(*found))])
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = F.flatten(F.filter(F.transform(suffixes, lambda s: F.element_at(held, s)), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(met, lambda r: F.startswith(F.col(path), r["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _shown(segment: Column) -> Column:
    """A segment as it stands in a template: the template's own marks are escaped."""
    marks = {"%": "%25", "*": "%2A", "{": "%7B", "|": "%7C", "}": "%7D"}
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), marks.items(), segment)


def _differs(part: str, of: str, all_part: str, all_of: str) -> Column:
    """Whether two shares differ by more than chance; shares of nothing do not."""
    apart = F.abs(F.col(part) / F.nullif(F.col(of), F.lit(0)) - F.col(all_part) / F.nullif(F.col(all_of), F.lit(0)))
    bound = F.lit(HOEFFDING) * (1 / F.sqrt(F.nullif(F.col(of), F.lit(0))) + 1 / F.sqrt(F.nullif(F.col(all_of), F.lit(0))))
    return F.coalesce(apart > bound, F.lit(False))


def _kept(pages: DataFrame, level: int) -> DataFrame:
    """(host, node, segment, step): the segments of a level that stay, and the branch that each belongs to."""
    here = pages.where(F.size("segments") >= level).withColumn("segment", F.element_at("segments", level))
    ends = F.sum(F.when(F.size("segments") == level, 1).otherwise(0)).alias("ends")
    counted = here.groupBy("host", "node", "segment").agg(F.count("*").alias("n"), ends, F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    total = here.groupBy("host", "node").agg(F.count("*").alias("total"))
    some = counted.where(F.col("n") >= LEAST).join(total, ["host", "node"]).where(F.col("n") * SHARE >= F.col("total")).drop("total")
    pool = some.groupBy("host", "node").agg(*[F.sum(name).alias(f"all_{name}") for name in ("n", "ends", "good", "labelled")])
    like = ~(_differs("ends", "n", "all_ends", "all_n") | _differs("good", "labelled", "all_good", "all_labelled"))
    some = some.join(pool, ["host", "node"]).select("host", "node", "segment", like.alias("like"), _shown(F.col("segment")).alias("shown"))
    alike = some.where("like").groupBy("host", "node").agg(F.array_sort(F.collect_list("shown")).alias("names"))
    branch = F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}"))
    step = F.when(F.col("like") & (F.size("names") > 1), branch).otherwise(F.col("shown"))
    return some.join(alike, ["host", "node"], "left").select("host", "node", "segment", step.alias("step"))


def _down(pages: DataFrame, kept: DataFrame, level: int) -> DataFrame:
    """The pages one level further down their tree."""
    held = kept.select(F.col("host").alias("_h"), F.col("node").alias("_n"), F.col("segment").alias("_s"), "step")
    segment = F.get("segments", F.lit(level - 1))
    met = (F.col("host") == F.col("_h")) & (F.col("node") == F.col("_n")) & (segment == F.col("_s"))
    step = F.when(F.size("segments") >= level, F.concat(F.lit("/"), F.coalesce("step", F.lit(WILDCARD)))).otherwise("")
    return pages.join(held, met, "left").withColumn("node", F.concat("node", step)).drop("_h", "_n", "_s", "step")


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = (), labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
    depth: int = DEPTH, purity: float = PURITY,
) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, template, purity, n_labelled.

    labels has ids and whether a page is good (id, good): a page that a rule fits is labelled by the rule's verdict, any
    other by its id's labels, bad if one of them is false. A page that no rule fits is blocked if its template's smoothed
    share of good pages is below ``purity``. Null urls and those without :// have an empty host and path, and make one
    template. Null ids are passed on and have no label, repeated rows count each; paths of more than ``depth`` segments
    share their tail; empty segments are left out. Other columns are not read. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    read = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    read = read.withColumn("fits", fitting(rules, "host", "path")).select("id", "host", "path", "fits.rule", F.col("fits.verdict").alias("ruled"))
    if labels is None:
        read = read.withColumn("said", F.lit(None).cast("boolean"))
    else:
        told = labels.toDF("told", "good").where("told IS NOT NULL AND good IS NOT NULL").groupBy("told").agg(F.min("good").alias("said"))
        read = read.join(told, F.col("id") == F.col("told"), "left").drop("told")
    good = F.when(F.col("ruled").isNull(), F.col("said")).otherwise(F.col("ruled") == "allow")
    read = read.select(
        "id", "host", "path", "rule", "ruled", F.filter(F.split("path", "/"), lambda s: s != "").alias("segments"),
        F.coalesce(good.cast("int"), F.lit(0)).alias("good"), good.isNotNull().cast("int").alias("labelled"), F.lit("").alias("node"),
    )
    read = written(read)
    for level in range(1, min(depth, read.agg(F.max(F.size("segments"))).first()[0] or 0) + 1):
        kept = written(_kept(read, level))
        read = _down(read, broadcast_if_small(kept), level)
    read = read.withColumn("node", F.concat("node", F.when(F.size("segments") > depth, TAIL).otherwise("")))

    templates = read.groupBy("host", "node").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    hosts = templates.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("labelled").alias("host_labelled"))
    whole = hosts.agg(((F.sum("host_good") + 1) / (F.sum("host_labelled") + 2)).alias("share"))
    hosts = hosts.crossJoin(F.broadcast(whole)).select("host", ((F.col("host_good") + PRIOR * F.col("share")) / (F.col("host_labelled") + PRIOR)).alias("host_share"))
    share = (F.col("good") + PRIOR * F.col("host_share")) / (F.col("labelled") + PRIOR)
    held = written(templates.join(hosts, "host").select(F.col("host").alias("_h"), F.col("node").alias("_n"), share.alias("purity"), F.col("labelled").alias("n_labelled")))
    judged = read.join(broadcast_if_small(held), (F.col("host") == F.col("_h")) & (F.col("node") == F.col("_n")))
    verdict = F.coalesce("ruled", F.when(F.col("purity") < purity, "block").otherwise("allow"))
    return judged.select("id", "host", "path", "rule", verdict.alias("verdict"), F.col("node").alias("template"), "purity", "n_labelled")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    good = F.when(bad, False).when(F.col("quality") == 1, True)
    return judge(table(spark, sf_dir, "pages"), RULES, labels.select("doc_id", good)).withColumnRenamed("id", "page_id")


def _differs_sql(part: str, of: str) -> str:
    apart = f"abs({part} / nullif({of}, 0) - all_{part} / nullif(all_{of}, 0))"
    return f"coalesce({apart} > {HOEFFDING} * (1 / sqrt(nullif({of}, 0)) + 1 / sqrt(nullif(all_{of}, 0))), false)"


def _oracle() -> str:
    rules = ", ".join(f"({n}, '{verdict}', '{host}', '{path}')" for n, (verdict, host, path) in enumerate(RULES))
    shown = reduce(lambda c, x: f"replace({c}, '{x[0]}', '{x[1]}')", {"%": "%25", "*": "%2A", "{": "%7B", "|": "%7C", "}": "%7D"}.items(), "segment")
    parts = [f"""
WITH url AS (
  SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT rid, page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host
  FROM url),
rules(place, verdict, rule_host, rule_path) AS (VALUES {rules}),
fits AS (
  SELECT rid, rule_host || rule_path AS rule, verdict AS ruled FROM parsed, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule_host || rule_path) DESC, place) = 1),
told AS (
  SELECT doc_id, bool_and(quality = 1 AND coalesce(toxic, 0) <> 1) AS said FROM labels
  WHERE doc_id IS NOT NULL AND (quality IN (0, 1) OR toxic = 1) GROUP BY doc_id),
known AS (
  SELECT rid, page_id, host, path, rule, ruled, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments,
         CASE WHEN ruled IS NULL THEN said ELSE ruled = 'allow' END AS fine
  FROM parsed LEFT JOIN fits USING (rid) LEFT JOIN told ON told.doc_id = page_id),
down0 AS (SELECT *, coalesce(fine::INTEGER, 0) AS good, (fine IS NOT NULL)::INTEGER AS labelled, '' AS node FROM known)"""]  # fmt: skip
    for level in range(1, DEPTH + 1):
        parts.append(f""",
counted{level} AS (
  SELECT host, node, segments[{level}] AS segment, count(*) AS n, count(*) FILTER (WHERE len(segments) = {level}) AS ends, sum(good) AS good, sum(labelled) AS labelled,
         sum(count(*)) OVER (PARTITION BY host, node) AS total
  FROM down{level - 1} WHERE len(segments) >= {level} GROUP BY host, node, segment),
some{level} AS (
  SELECT *, sum(n) OVER same AS all_n, sum(ends) OVER same AS all_ends, sum(good) OVER same AS all_good, sum(labelled) OVER same AS all_labelled
  FROM counted{level} WHERE n >= {LEAST} AND n * {SHARE} >= total WINDOW same AS (PARTITION BY host, node)),
like{level} AS (
  SELECT host, node, segment, {shown} AS shown, NOT ({_differs_sql("ends", "n")} OR {_differs_sql("good", "labelled")}) AS same FROM some{level}),
kept{level} AS (
  SELECT host, node, segment, CASE WHEN same AND count(*) FILTER (WHERE same) OVER w > 1
    THEN '{{' || array_to_string(list_sort(list(shown) FILTER (WHERE same) OVER w), '|') || '}}' ELSE shown END AS step
  FROM like{level} WINDOW w AS (PARTITION BY host, node)),
down{level} AS (
  SELECT d.* REPLACE (d.node || CASE WHEN len(segments) >= {level} THEN '/' || coalesce(step, '{WILDCARD}') ELSE '' END AS node)
  FROM down{level - 1} d LEFT JOIN kept{level} k ON k.host = d.host AND k.node = d.node AND k.segment = d.segments[{level}])""")
    parts.append(f""",
leaf AS (SELECT * REPLACE (node || CASE WHEN len(segments) > {DEPTH} THEN '{TAIL}' ELSE '' END AS node) FROM down{DEPTH}),
template AS (SELECT host, node, sum(good) AS good, sum(labelled) AS labelled FROM leaf GROUP BY host, node),
whole AS (SELECT (sum(good) + 1) / (sum(labelled) + 2) AS share FROM template),
hosts AS (SELECT host, (sum(good) + {PRIOR} * any_value(share)) / (sum(labelled) + {PRIOR}) AS host_share FROM template, whole GROUP BY host),
held AS (SELECT host, node, (good + {PRIOR} * host_share) / (labelled + {PRIOR}) AS purity, labelled::BIGINT AS n_labelled FROM template JOIN hosts USING (host))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, node AS template, purity, n_labelled
FROM leaf JOIN held USING (host, node)""")
    return "".join(parts)


QUERIES = {"op13_url_filter": op13_url_filter}
ORACLES = {"op13_url_filter": _oracle()}
