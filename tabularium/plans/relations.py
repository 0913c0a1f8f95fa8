"""Relations between tables: safety, enrichment, effective-dated costs, intervals, returns, goals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators import joins as J
from tabularium.operators import labels as L
from tabularium.operators import reshape as R
from tabularium.plans.star import exact, sales, table


def safe_join_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return J.relation_stats(lines, J.struct_key("l_orderkey"), orders, J.struct_key("o_orderkey"))


def safe_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders enriched with their customer after the relation is proved, summed by segment."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = J.safe_left_join(orders, customer, ["o_custkey"], ["c_custkey"], leave_out=("c_acctbal",))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("rows"), F.sum(exact(F.col("o_totalprice"), 2)).cast("double").alias("amount"))


def reference_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.reference_quality(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderpriority"])


def unique_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders all have one status, as a reference of customer to status."""
    return J.unique_reference(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus"])


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_size <= 40")
    return J.referential_integrity(table(spark, sf_dir, "lineitem"), "l_partkey", parts, "p_partkey", "lineitem.part")


def attribute_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.attribute_consistency(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")


def asof_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit price of a part on the latest earlier day it was shipped without return, for each returned line."""
    lines = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    facts = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    history = lines.where("l_returnflag <> 'R'").select("l_partkey", "l_shipdate", "price")
    return J.asof_join(facts, history, "l_partkey", "l_shipdate", "l_shipdate", "price", "cost")


def interval_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines priced by their supplier's rate of the quarter; quarters without a rate leave their lines out."""
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    quarter = F.trunc("day", "quarter")
    rates = lines.groupBy("l_suppkey", quarter.alias("since")).agg(F.count("*").alias("rate")).where("(l_suppkey + month(since)) % 7 <> 0")
    rates = rates.withColumn("until", F.last_day(F.add_months("since", 2))).withColumnRenamed("l_suppkey", "supplier")
    met = J.interval_join(lines, rates, "l_suppkey", "day", "supplier", "since", "until", ["rate"])
    return met.groupBy("l_suppkey").agg(F.count("*").alias("rows"), F.sum(F.col("rate") * F.col("l_quantity").cast("long")).alias("priced"))


def returns_netting(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sales(spark, sf_dir).withColumn("units", F.col("l_quantity").cast("long"))
    sold = lines.where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.sum("net").alias("amount"), F.sum("units").alias("units"))
    back = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document"), F.col("net").alias("back_amount"), F.col("units").alias("back_units"))
    out = J.net_returns(sold, "l_orderkey", "amount", "units", back, "document", "back_amount", "back_units")
    return out.select("l_orderkey", F.col("returned_amount").cast("double").alias("returned_amount"), F.col("net_amount").cast("double").alias("net_amount"), F.col("net_quantity").cast("long").alias("net_quantity"))


def goals_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A goal by priority and month: a flat amount; actual: the orders' totals."""
    orders = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("priority"), exact(F.col("o_totalprice"), 2).alias("amount"))
    goals = orders.select("month", "priority").distinct().withColumn("goal", F.lit(10_000_000).cast("decimal(18,2)"))
    found = J.goals_vs_actual(goals, orders.where("priority <> '5-LOW'"), ["month", "priority"], "goal", "amount")
    return found.select("month", "priority", F.col("goal").cast("double").alias("goal"), F.col("actual").cast("double").alias("actual"), "met")


def append_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet per year of orders, the odd years without a column, appended and counted by origin."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    first, last = orders.agg(F.min("year"), F.max("year")).first()
    sheets = {str(y): orders.where(F.col("year") == y).drop("year", *["o_orderpriority"] * (y % 2)) for y in range(first, last + 1)}
    whole = R.append(sheets)
    return whole.groupBy("origin").agg(F.count("*").alias("rows"), F.count("o_orderpriority").alias("priorities"), F.sum(exact(F.col("o_totalprice"), 2)).cast("double").alias("amount"))


def resolve_unique_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One supplier per part and month of all lines: the only one, or the only one among returned lines."""
    lines = table(spark, sf_dir, "lineitem").withColumn("part_month", F.concat_ws("/", F.col("l_partkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM")))
    return J.resolve_unique(lines, "part_month", ["l_suppkey"], F.col("l_returnflag") == "R")


def precedence_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's price from its own row, else the reference price, else nothing, with the source that gave it."""
    part = table(spark, sf_dir, "part").where("p_size <= 40").select("p_partkey", "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    own = F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice") / F.col("l_quantity"))
    value, source = L.by_authority({"line": own, "reference": F.col("p_retailprice")})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", value.alias("price"), source.alias("source"))


def recode_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations recoded by a book in which some codes are missing and one has two labels."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    book = L.codebook(nation.union(spark.range(1).select(F.lit(3), F.lit("OTHER NAME"))), "code", "label")
    coded = L.recode(table(spark, sf_dir, "customer"), "c_nationkey", book, "nation")
    return coded.groupBy("nation", "nation_status").agg(F.count("*").alias("rows"))


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return R.latest_snapshot(orders, ["o_custkey"], "o_orderdate")


def semi_join_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have at least one returned line, by priority."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    kept = table(spark, sf_dir, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


QUERIES = {
    "safe_join_stats": safe_join_stats, "safe_left_join": safe_left_join, "reference_dedup": reference_dedup, "unique_reference": unique_reference, "orphans": orphans,
    "attribute_mismatch": attribute_mismatch, "asof_cost": asof_cost, "interval_rate": interval_rate, "returns_netting": returns_netting, "goals_vs_actual": goals_vs_actual,
    "append_sheets": append_sheets, "resolve_unique_candidate": resolve_unique_candidate, "precedence_coalesce": precedence_coalesce, "recode_codebook": recode_codebook,
    "latest_snapshot": latest_snapshot, "semi_join_documents": semi_join_documents,
}

_NET = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"
ORACLES = {
    "safe_join_stats": """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS k, count(*) AS m FROM orders GROUP BY 1),
b AS (SELECT l.k AS a, r.k AS b, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM l FULL JOIN r ON l.k = r.k),
s AS (SELECT sum(n)::BIGINT AS left_rows, sum(m)::BIGINT AS right_rows, count(a) AS left_keys, count(b) AS right_keys, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS common_keys,
  coalesce(sum(n) FILTER (a IS NOT NULL AND b IS NOT NULL), 0)::BIGINT AS left_matched_rows, coalesce(sum(m) FILTER (a IS NOT NULL AND b IS NOT NULL), 0)::BIGINT AS right_matched_rows,
  count(*) FILTER (b IS NOT NULL AND m > 1) AS right_repeated_keys, count(*) FILTER (a IS NOT NULL AND n > 1) AS left_repeated_keys,
  sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN n * m ELSE n END)::BIGINT AS projected_rows FROM b),
c AS (SELECT *, left_matched_rows::DOUBLE / left_rows AS coverage, right_matched_rows::DOUBLE / right_rows AS reverse_coverage, common_keys::DOUBLE / least(left_keys, right_keys) AS overlap,
  CASE WHEN left_repeated_keys > 0 THEN 'many' ELSE 'one' END || '_to_' || CASE WHEN right_repeated_keys > 0 THEN 'many' ELSE 'one' END AS cardinality FROM s)
SELECT *, right_repeated_keys = 0 AND coverage >= 0.6 AND reverse_coverage >= 0.6 AND overlap >= 0.6 AND projected_rows = left_rows AS safe FROM c""",
    "safe_left_join": "SELECT c_mktsegment, count(*) AS rows, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS amount FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "reference_dedup": """
WITH k AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS v FROM orders GROUP BY 1)
SELECT count(*) AS keys, count(*) FILTER (n > 1) AS repeated_keys, count(*) FILTER (v > 1) AS conflicting_keys, 0::BIGINT AS rows_without_key FROM k""",
    "unique_reference": "SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1",
    "orphans": """
WITH p AS (SELECT p_partkey FROM part WHERE p_size <= 40), o AS (SELECT l_partkey, p_partkey FROM lineitem LEFT JOIN p ON l_partkey = p_partkey)
SELECT 'lineitem.part' AS relation, count(*) AS rows, count(p_partkey) AS valid, count(*) - count(p_partkey) AS orphans, 0::BIGINT AS without_key, count(p_partkey)::DOUBLE / count(*) * 100 AS coverage_pct,
  (SELECT string_agg(l_partkey, ', ' ORDER BY l_partkey) FROM (SELECT DISTINCT l_partkey FROM o WHERE p_partkey IS NULL ORDER BY 1 LIMIT 5)) AS examples FROM o""",
    "attribute_mismatch": "SELECT count(*) AS compared, count(*) FILTER (s_nationkey <> c_nationkey) AS different FROM supplier JOIN customer ON s_suppkey = c_custkey",
    "asof_cost": """
WITH h AS (SELECT l_partkey AS k, l_shipdate AS d, min(l_extendedprice / l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2 HAVING min(l_extendedprice / l_quantity) = max(l_extendedprice / l_quantity))
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, h.v AS cost, h.d AS cost_since FROM (SELECT * FROM lineitem WHERE l_returnflag = 'R') f ASOF LEFT JOIN h ON f.l_partkey = h.k AND f.l_shipdate >= h.d""",
    "interval_rate": """
WITH q AS (SELECT l_suppkey AS s, date_trunc('quarter', l_shipdate)::DATE AS since, count(*) AS rate FROM lineitem GROUP BY 1, 2), r AS (SELECT * FROM q WHERE (s + month(since)) % 7 <> 0)
SELECT l_suppkey, count(*) AS rows, sum(rate * l_quantity::BIGINT)::BIGINT AS priced FROM lineitem JOIN r ON l_suppkey = s AND l_shipdate::DATE BETWEEN since AND last_day(since + INTERVAL 2 MONTH) GROUP BY 1""",
    "returns_netting": f"""
WITH s AS (SELECT l_orderkey, sum({_NET}) AS a, sum(l_quantity::BIGINT) AS u FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
b AS (SELECT l_orderkey AS k, sum({_NET}) AS a, sum(l_quantity::BIGINT) AS u FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey, coalesce(b.a, 0)::DOUBLE AS returned_amount, (s.a - coalesce(b.a, 0))::DOUBLE AS net_amount, (s.u - coalesce(b.u, 0))::BIGINT AS net_quantity FROM s LEFT JOIN b ON l_orderkey = k""",
    "goals_vs_actual": """
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS priority, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders),
g AS (SELECT DISTINCT month, priority FROM o), s AS (SELECT month, priority, sum(a) AS a FROM o WHERE priority <> '5-LOW' GROUP BY 1, 2)
SELECT g.month, g.priority, 10000000::DOUBLE AS goal, coalesce(a, 0)::DOUBLE AS actual, coalesce(a, 0) >= 10000000 AS met FROM g LEFT JOIN s ON g.month = s.month AND g.priority = s.priority""",
    "append_sheets": """
SELECT year(o_orderdate)::VARCHAR AS origin, count(*) AS rows, count(CASE WHEN year(o_orderdate) % 2 = 0 THEN o_orderpriority END) AS priorities, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS amount
FROM orders GROUP BY year(o_orderdate)""",
    "resolve_unique_candidate": """
WITH k AS (SELECT l_partkey || '/' || strftime(l_shipdate, '%Y-%m') AS part_month, count(DISTINCT l_suppkey) AS n, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS p,
  min(l_suppkey) AS a, min(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS b FROM lineitem GROUP BY 1)
SELECT part_month, CASE WHEN n = 1 THEN 'unique' WHEN p = 1 THEN 'preferred' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN a WHEN p = 1 THEN b END AS l_suppkey FROM k""",
    "precedence_coalesce": """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN l_extendedprice / l_quantity ELSE p_retailprice END AS price,
  CASE WHEN l_returnflag = 'N' THEN 'line' WHEN p_retailprice IS NOT NULL THEN 'reference' END AS source FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON l_partkey = p_partkey""",
    "recode_codebook": """
SELECT CASE WHEN c_nationkey = 3 OR c_nationkey >= 20 THEN c_nationkey::VARCHAR ELSE n_name END AS nation, CASE WHEN c_nationkey = 3 THEN 'conflict' WHEN c_nationkey >= 20 THEN 'unmapped' ELSE 'mapped' END AS nation_status, count(*) AS rows
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "latest_snapshot": """
SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_orderstatus DESC) AS r FROM orders) WHERE r = 1""",
    "semi_join_documents": "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
}
