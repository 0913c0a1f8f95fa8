"""Mixing sources to target weights by Poisson replication, with Spark SQL functions only.

A source's mean repetition rate is the factor that brings its bytes to its share
of the target. Each document gets a Poisson count with that mean: a uniform
number from a hash of seed and id is inverted through the distribution's
cumulative sums. Documents are exploded by their count and dealt out by a hash of
id and copy, so order and neighbours are random, but the same on every run and on
every retried task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import broadcast_if_small, carried, restored, table

#: Rates above this are drawn as a sum of equal parts, each below it.
PART = 16.0
#: Terms of a part's cumulative sums; for a mean of 16 or less the rest is below 1e-30.
TERMS = 96
#: Production weights: shares of the mixture's bytes; the other sources share REST in proportion to their bytes.
WEIGHTS = {"src0": 0.10, "src1": 0.08, "src2": 0.05, "src3": 0.05, "src5": 0.12}
REST = 0.60


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts joined by '|'."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """The Poisson distribution's cumulative sums for 0, 1, ... TERMS - 1."""

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        c = state["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(state["all"], F.array(c)).alias("all"))

    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda state: state["all"])


def rates(docs: DataFrame, weights: dict[str, float], rest: float, source: Column, mass: Column, target_bytes: float | None = None) -> DataFrame:
    """(source, mass, rate): one row per source; a null source is a source too."""
    listed = F.lit(None).cast("double")
    for name, weight in weights.items():
        listed = F.when(F.col("source") == F.lit(name), F.lit(float(weight))).otherwise(listed)
    sizes = docs.select(source.alias("source"), mass.alias("mass")).groupBy("source").agg(F.sum("mass").alias("mass")).withColumn("weight", listed)
    others = F.col("weight").isNull()
    total = sizes.agg(
        F.coalesce(F.sum("mass"), F.lit(0)).alias("mass"),
        F.coalesce(F.sum(F.when(others, F.col("mass"))), F.lit(0)).alias("others"),
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weights"),
    ).first()
    everything = total["weights"] + (rest if total["others"] else 0.0)
    if total["mass"] and everything <= 0:
        raise ValueError("the weights of the sources present must have a positive sum")
    target = float(target_bytes if target_bytes is not None else total["mass"])
    mine = F.when(others, F.lit(rest / (everything or 1) * target) / F.lit(float(total["others"] or 1))).otherwise(
        F.col("weight") / F.lit(everything or 1.0) * F.lit(target) / F.col("mass").cast("double")
    )
    return sizes.select("source", "mass", mine.alias("rate"))


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    rest: float = 0.0,
    target_bytes: float | None = None,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every column of docs, ``copy`` (from 0) and ``shuffle_key``; one row per copy, globally shuffled.

    weights: source -> share of the target; sources not named, null included, share ``rest`` in proportion to their
    bytes. Weights are normalised over the sources present. target_bytes: size of the mixture, the corpus's own if not
    given. A document weighs its text's bytes plus one, so null and empty texts count too. A null id draws by its text.
    Repeated rows, and rows with one id in one source, draw the same count. Columns of docs called copy or shuffle_key
    are replaced. An empty table gives an empty result.
    """
    source, text = F.col(source_col).cast("string"), F.col(text_col)
    mass = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)
    known = rates(docs, weights, rest, source, mass, target_bytes)
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(PART)), F.lit(1)).cast("int")
    known = known.select("source", parts.alias("parts"), cumulative(F.col("rate") / parts).alias("sums"))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    rows = docs.select(carried(docs, "copy", "shuffle_key"), source.alias("mine"), key.alias("key"))
    small = broadcast_if_small(known, 100_000)
    rows = rows.join(small, rows["mine"].eqNullSafe(small["source"]))
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: uniform(F.lit(str(seed)), F.col("key"), j.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("sums", lambda c: c <= u)))
    rows = rows.select("row", "key", count.alias("count")).where("count > 0")
    rows = rows.select("row", "key", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), "key", F.col("copy").cast("string")).cast("binary"))
    rows = rows.select("row", "copy", order.alias("shuffle_key"))
    return restored(rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key"), "copy", "shuffle_key")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), WEIGHTS, REST)
    return mixed.select("doc_id", "source", "copy", "shuffle_key", "text")


def mixing_sql(documents: str, weights: dict[str, float], rest: float, columns: str, seed: int = 42) -> str:
    """DuckDB SQL for the same mixture of a table with ids, text and source."""
    listed = ", ".join(f"('{name}', {weight!r}::DOUBLE)" for name, weight in weights.items())
    return f"""
WITH RECURSIVE listed(name, weight) AS (VALUES {listed}),
sizes AS (SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS mass FROM {documents} GROUP BY source),
known AS (SELECT s.source, s.mass, l.weight FROM sizes s LEFT JOIN listed l ON s.source = l.name),
total AS (
  SELECT sum(mass) AS mass, coalesce(sum(mass) FILTER (weight IS NULL), 0) AS others,
         coalesce(sum(weight), 0) + CASE WHEN count(*) FILTER (weight IS NULL) > 0 THEN {rest!r}::DOUBLE ELSE 0 END AS everything
  FROM known),
rate AS (
  SELECT source, CASE WHEN weight IS NULL THEN {rest!r}::DOUBLE / everything * total.mass / others
                      ELSE weight / everything * total.mass / known.mass END AS rate
  FROM known, total),
part AS (SELECT source, greatest(ceil(rate / {PART!r}), 1)::INT AS parts, rate / greatest(ceil(rate / {PART!r}), 1)::INT AS mean FROM rate),
sums AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM part
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM sums WHERE k + 1 < {TERMS}),
listed_sums AS (SELECT source, list(c ORDER BY k) AS sums FROM sums GROUP BY source),
draw AS (
  SELECT d.*, coalesce(d.doc_id::VARCHAR, 'text ' || md5(coalesce(d.text, ''))) AS key, p.parts, s.sums
  FROM {documents} d JOIN part p ON d.source IS NOT DISTINCT FROM p.source JOIN listed_sums s ON d.source IS NOT DISTINCT FROM s.source),
counted AS (
  SELECT *, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(sums, lambda c:
    c <= ('0x' || substr(md5('{seed}|' || key || '|' || j), 1, 13))::BIGINT::DOUBLE / {1 << 52}))))::INT AS n
  FROM draw),
copies AS (SELECT *, unnest(range(n)) AS copy_no FROM counted)
SELECT {columns} FROM copies"""


ORDER_SQL = "copy_no::INT AS copy, md5('42|order|' || key || '|' || copy_no) AS shuffle_key"
QUERIES = {"op1_source_mixing": op1_source_mixing}
ORACLES = {"op1_source_mixing": mixing_sql("documents", WEIGHTS, REST, f"doc_id, source, {ORDER_SQL}, text")}
