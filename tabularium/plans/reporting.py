"""Report tables over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators import reports as R
from tabularium.plans.star import exact, table


def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.numeric_summary(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return found.select("column", "values", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "least", "most")


def brand_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distribution(table(spark, sf_dir, "part"), F.col("p_brand"))


def catalogue_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts at their price, with a cost of their size by 40 up to size 45."""
    part = table(spark, sf_dir, "part").withColumn("cost", F.when(F.col("p_size") <= 45, (F.col("p_size") * 40).cast("double")))
    found = R.catalogue_profile(part, F.col("p_retailprice"), F.col("cost"))
    return found.select("products", F.round("mean_price", 6).alias("mean_price"), F.round("median_price", 6).alias("median_price"), F.round("mean_cost", 6).alias("mean_cost"), F.round("potential_margin_pct", 6).alias("potential_margin_pct"), "without_cost", "below_cost", "outliers")


def stock_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as stock rows of their ship date."""
    rows = table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return R.stock_cut(rows, F.col("day"), F.col("l_partkey"), F.col("l_quantity").cast("long"), F.lit(10), exact(F.col("l_extendedprice"), 2) / 10)


def customer_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(exact(F.col("o_totalprice"), 2)).cast("double").alias("amount"))
    found = R.chart_series(groups, "o_custkey", "amount")
    return found.select("label", F.round("value", 2).alias("value"), "rank", F.round("cumulative_pct", 6).alias("cumulative_pct"))


def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(exact(F.col("o_totalprice"), 2)).cast("double").alias("amount"))
    return R.heat_scale(cells, "amount").withColumn("intensity", F.round("intensity", 6))


QUERIES = {f.__name__: f for f in (numeric_profile, brand_distribution, catalogue_profile, stock_cut, customer_chart, heat_map)}
ORACLES = {
    "numeric_profile": """
SELECT 'p_size' AS "column", count(p_size) AS values, round(avg(p_size), 6) AS mean, round(median(p_size)::DOUBLE, 6) AS median, min(p_size)::DOUBLE AS least, max(p_size)::DOUBLE AS most FROM part
UNION ALL SELECT 'p_retailprice', count(p_retailprice), round(avg(p_retailprice), 6), round(median(p_retailprice), 6), min(p_retailprice), max(p_retailprice) FROM part""",
    "brand_distribution": "SELECT p_brand AS label, count(*) AS rows, count(*)::DOUBLE / (SELECT count(*) FROM part) * 100 AS share_pct FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "catalogue_profile": """
WITH c AS (SELECT p_retailprice AS p, CASE WHEN p_size <= 45 THEN p_size * 40.0::DOUBLE END AS c FROM part), q AS (SELECT quantile_cont(c, 0.25) AS a, quantile_cont(c, 0.75) AS b FROM c)
SELECT count(*) AS products, round(avg(p), 6) AS mean_price, round(median(p), 6) AS median_price, round(avg(c), 6) AS mean_cost, round(avg((p - c) / p * 100), 6) AS potential_margin_pct,
  count(*) FILTER (c IS NULL OR c <= 0) AS without_cost, count(*) FILTER (c > p) AS below_cost, (SELECT count(*) FROM c, q WHERE c > b + (b - a) * 1.5) AS outliers FROM c""",
    "stock_cut": """
SELECT max(l_shipdate)::DATE AS day, count(DISTINCT l_partkey) AS products, sum(l_quantity::BIGINT)::DOUBLE AS stock, sum(l_quantity::BIGINT * CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE / 10 AS value,
  count(*) FILTER (l_quantity < 10) AS below_minimum, count(*) FILTER (l_quantity < 0) AS negative FROM lineitem WHERE l_shipdate::DATE = (SELECT max(l_shipdate)::DATE FROM lineitem)""",
    "customer_chart": """
WITH g AS (SELECT o_custkey::VARCHAR AS label, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS value FROM orders GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS r FROM g),
s AS (SELECT label, value, r AS rank FROM t WHERE r <= 12 UNION ALL SELECT 'Otros', sum(value), 13 FROM t WHERE r > 12 HAVING count(*) > 0)
SELECT label, round(value, 2) AS value, rank, round(sum(value) OVER (ORDER BY rank) / sum(value) OVER () * 100, 6) AS cumulative_pct FROM s""",
    "heat_map": """
WITH c AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS amount FROM orders GROUP BY 1, 2)
SELECT *, round(greatest(-1.0, least(1.0, amount / (SELECT quantile_cont(abs(amount), 0.95) FROM c))), 6) AS intensity FROM c""",
}
