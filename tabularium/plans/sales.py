"""Sales analytics: evolution, profitability, distributions, rankings, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators import aggregates as A
from tabularium.operators import reshape as R
from tabularium.plans.star import COSTED_SQL, SALES_SQL, costed, exact, sales, table

EXPENSES = 1_000_000.0


def monthly_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.monthly(sales(spark, sf_dir), F.col("l_shipdate"), F.col("net"))
    return found.select("month", "net", "rows", "covered_to_day", "partial", "prior_net", "change_pct")


MONTHLY_SQL = f"""
m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, sum(net)::DOUBLE AS net, count(*) AS rows, max(day(l_shipdate))::INT AS covered_to_day, max(day(last_day(l_shipdate))) AS days
      FROM ({SALES_SQL}) GROUP BY 1),
monthly AS (SELECT month, net, rows, covered_to_day, lead(month) OVER (ORDER BY month) IS NULL AND covered_to_day < days AS partial, lag(net) OVER (ORDER BY month) AS prior_net FROM m)"""


def monthly_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.monthly(costed(spark, sf_dir), F.col("l_shipdate"), F.col("net"), F.col("cost"))
    return found.select("month", "net", "paired_net", "cost", "profit", "margin_pct", "coverage_pct")


def group_profit_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.group_profit(costed(spark, sf_dir), F.col("p_brand"), F.col("net"), F.col("cost"))
    return found.select("group", "net", "gross", "rows", "paired_rows", "paired_net", "cost", "profit", "margin_pct", "coverage_pct", "net_share_pct")


GROUP_SQL = f"""
g AS (SELECT p_brand AS "group", sum(net)::DOUBLE AS net, sum(net) FILTER (net > 0)::DOUBLE AS gross, count(*) AS rows, count(cost) AS paired_rows,
             coalesce(sum(net) FILTER (cost IS NOT NULL), 0)::DOUBLE AS paired_net, coalesce(sum(cost), 0)::DOUBLE AS cost FROM ({COSTED_SQL}) GROUP BY 1)"""


def customer_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = sales(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    groups = rows.groupBy("o_custkey").agg(F.sum("net").alias("net"))
    found = A.running_share(groups, "o_custkey", "net")
    return found.select("o_custkey", F.col("net").cast("double").alias("net"), "rank", F.col("running").cast("double").alias("running"), "cumulative_pct")


def weekday_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_weekday(sales(spark, sf_dir), F.col("l_shipdate"), F.col("net"))


def month_dim_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("amount", exact(F.col("o_totalprice"), 2))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return A.month_matrix(rows, F.col("o_orderdate"), F.col("n_name"), F.col("amount"))


def amount_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(table(spark, sf_dir, "orders"), F.col("o_totalprice"))


def discount_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rate_buckets(sales(spark, sf_dir), F.col("l_discount"), F.col("net"))


def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.outlier_fences(table(spark, sf_dir, "orders"), F.col("o_totalprice"), 1.5, 4)
    return found.select("n", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), F.round("upper_fence", 4).alias("upper_fence"), "outliers")


def period_over_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.period_over_period(sales(spark, sf_dir), F.col("l_shipdate"), F.col("net"))


def projection_3m(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = A.monthly(sales(spark, sf_dir), F.col("l_shipdate"), F.col("net"))
    return A.projection(months).withColumn("quarter_change_pct", F.round("quarter_change_pct", 6))


def portfolio_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.portfolio(A.group_profit(costed(spark, sf_dir), F.col("p_brand"), F.col("net"), F.col("cost"))).select("group", "quadrant")


def break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = costed(spark, sf_dir).agg(*[c.alias(n) for n, c in A.measures(F.col("net"), F.col("cost")).items()])
    return A.break_even(total, F.lit(EXPENSES))


def currency_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.element_at(F.array(*[F.lit(x) for x in ("US$ ", "$ ", "€", "CLP ", "UF ", "")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.concat(marks, F.col("o_totalprice").cast("string")).alias("amount"))
    return A.currency_counts(rows, F.col("amount"))


def stock_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_size") * 100).alias("on_hand"))
    sold = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("units"))
    return R.stock_cover(stock, sold, "part", "on_hand", "units", 2500)


def product_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which brand leads by net, by profit and has the lowest margin."""
    groups = A.group_profit(costed(spark, sf_dir), F.col("p_brand"), F.col("net"), F.col("cost"))
    first = lambda value, sign: F.min_by("group", F.when(F.col(value).isNotNull(), F.struct(sign * F.col(value), "group")))  # noqa: E731  ties: the smaller name
    return groups.agg(first("net", -1).alias("by_net"), first("profit", -1).alias("by_profit"), first("margin_pct", 1).alias("lowest_margin"))


def customer_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("amount", exact(F.col("o_totalprice"), 2))
    by_customer = orders.groupBy("o_custkey").agg(F.sum("amount").alias("amount"))
    found = by_customer.agg(F.count("*").alias("customers"), F.max("amount").cast("double").alias("largest"), F.sum("amount").cast("double").alias("all_sales"))
    return found.select("customers", "largest", (F.col("largest") / F.col("all_sales") * 100).alias("concentration_pct"))


def average_ticket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net per document and per line, units, and documents."""
    by_document = sales(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("net").alias("net"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("units"))
    total = by_document.agg(F.sum("net").cast("double").alias("net"), F.sum("n").alias("lines"), F.sum("units").alias("units"), F.count("*").alias("documents"))
    return total.select("documents", "lines", "units", (F.col("net") / F.col("documents")).alias("per_document"), (F.col("net") / F.col("lines")).alias("per_line"))


QUERIES = {
    "monthly_evolution": monthly_evolution, "monthly_profit": monthly_profit, "group_profit_brand": group_profit_brand, "customer_pareto": customer_pareto,
    "weekday_sales": weekday_sales, "month_dim_matrix": month_dim_matrix, "amount_histogram": amount_histogram, "discount_buckets": discount_buckets,
    "iqr_outliers": iqr_outliers, "period_over_period": period_over_period, "projection_3m": projection_3m, "portfolio_quadrants": portfolio_quadrants,
    "break_even": break_even, "currency_detection": currency_detection, "stock_cover": stock_cover, "product_leaders": product_leaders,
    "customer_concentration": customer_concentration, "average_ticket": average_ticket,
}

_STEPS = " ".join(f"WHEN l_discount <= {high} THEN '{name}'" for high, name in A.RATE_BUCKETS)
ORACLES = {
    "monthly_evolution": f"WITH {MONTHLY_SQL} SELECT *, CASE WHEN prior_net <> 0 THEN (net - prior_net) / abs(prior_net) * 100 END AS change_pct FROM monthly",
    "monthly_profit": f"""
WITH g AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, sum(net)::DOUBLE AS net, count(*) AS rows, count(cost) AS paired_rows,
  coalesce(sum(net) FILTER (cost IS NOT NULL), 0)::DOUBLE AS paired_net, coalesce(sum(cost), 0)::DOUBLE AS cost FROM ({COSTED_SQL}) GROUP BY 1)
SELECT month, net, paired_net, cost, CASE WHEN paired_rows > 0 THEN paired_net - cost END AS profit,
  CASE WHEN paired_rows > 0 AND paired_net <> 0 THEN (paired_net - cost) / paired_net * 100 END AS margin_pct, paired_rows::DOUBLE / rows * 100 AS coverage_pct FROM g""",
    "group_profit_brand": f"""
WITH {GROUP_SQL}
SELECT *, CASE WHEN paired_rows > 0 THEN paired_net - cost END AS profit, CASE WHEN paired_rows > 0 AND paired_net <> 0 THEN (paired_net - cost) / paired_net * 100 END AS margin_pct,
  paired_rows::DOUBLE / rows * 100 AS coverage_pct, net / (SELECT sum(net)::DOUBLE FROM ({COSTED_SQL}) WHERE net > 0) * 100 AS net_share_pct FROM g""",
    "customer_pareto": f"""
WITH c AS (SELECT o_custkey, sum(net) AS net FROM ({SALES_SQL}) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
r AS (SELECT o_custkey, net, row_number() OVER w AS rank, sum(net) OVER (w ROWS UNBOUNDED PRECEDING) AS running, sum(net) OVER () AS total FROM c WHERE net > 0 WINDOW w AS (ORDER BY net DESC, o_custkey))
SELECT o_custkey, net::DOUBLE AS net, rank, running::DOUBLE AS running, running::DOUBLE / total::DOUBLE * 100 AS cumulative_pct FROM r""",
    "weekday_sales": f"SELECT (isodow(l_shipdate) - 1)::INT AS weekday, sum(net)::DOUBLE AS net, count(*) AS rows FROM ({SALES_SQL}) GROUP BY 1",
    "month_dim_matrix": """
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, n_name, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT n_name FROM o GROUP BY 1 ORDER BY sum(amount) DESC, n_name LIMIT 8)
SELECT month, CASE WHEN n_name IN (SELECT n_name FROM t) THEN n_name ELSE 'Otros' END AS "group", sum(amount)::DOUBLE AS net FROM o GROUP BY 1, 2""",
    "amount_histogram": """
WITH s AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(DISTINCT o_totalprice) AS d FROM orders),
l AS (SELECT lo, hi, least(12, greatest(6, round(sqrt(n))::INT)) AS bins, (hi - lo) / least(12, greatest(6, round(sqrt(n))::INT)) AS width FROM s WHERE n >= 20 AND d >= 4),
e AS (SELECT i::INT AS bin, lo + i * width AS lower, CASE WHEN i = bins - 1 THEN hi ELSE lo + (i + 1) * width END AS upper, i = bins - 1 AS last FROM l, range(0, 12) t(i) WHERE i < bins)
SELECT bin, lower, upper, count(o_totalprice) AS rows FROM e LEFT JOIN orders ON o_totalprice >= lower AND (o_totalprice < upper OR last AND o_totalprice <= upper) GROUP BY 1, 2, 3""",
    "discount_buckets": f"""
SELECT CASE WHEN l_discount IS NULL THEN 'Sin dato' WHEN l_discount = 0 THEN 'Sin descuento' WHEN l_discount < 0 OR l_discount > 1 THEN 'Fuera de rango' {_STEPS} END AS bucket,
  sum(net)::DOUBLE AS net, count(*) AS rows FROM ({SALES_SQL}) GROUP BY 1""",
    "iqr_outliers": """
WITH q AS (SELECT count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT n, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 + (q3 - q1) * 1.5, 4) AS upper_fence, (SELECT count(*) FROM orders WHERE o_totalprice > q3 + (q3 - q1) * 1.5) AS outliers FROM q""",
    "period_over_period": f"""
WITH e AS (SELECT max(l_shipdate)::DATE AS e FROM lineitem),
p AS (SELECT e, date_trunc('month', e)::DATE AS s, (date_trunc('month', e) - INTERVAL 1 MONTH)::DATE AS b, e < last_day(e) AS partial FROM e),
w AS (SELECT *, CASE WHEN partial THEN least((b + (day(e)::INT - 1))::DATE, last_day(b)) ELSE last_day(b) END AS u FROM p),
r AS (SELECT coalesce(sum(net) FILTER (l_shipdate::DATE >= s), 0)::DOUBLE AS current, coalesce(sum(net) FILTER (l_shipdate::DATE <= u), 0)::DOUBLE AS previous,
  count(*) FILTER (l_shipdate::DATE >= s) AS current_rows, any_value(partial) AS partial, any_value(e) AS until FROM ({SALES_SQL}), w WHERE l_shipdate::DATE BETWEEN b AND e)
SELECT *, CASE WHEN previous <> 0 THEN (current - previous) / abs(previous) * 100 END AS change_pct FROM r""",
    "projection_3m": f"""
WITH {MONTHLY_SQL},
f AS (SELECT month, net, lag(net) OVER (ORDER BY month) AS before FROM monthly WHERE NOT partial),
g AS (SELECT max(month) AS last, arg_max(net, month) AS net, avg(greatest(-0.5, least(0.5, (net - before) / before))) FILTER (before > 0) AS growth FROM f HAVING count(*) >= 2 AND count(*) FILTER (before <= 0) = 0),
q AS (SELECT sum(net) AS quarter FROM (SELECT net FROM f ORDER BY month DESC LIMIT 3)),
e AS (SELECT g.*, quarter, datediff('month', (last || '-01')::DATE, ((SELECT max(month) FROM monthly) || '-01')::DATE) AS gap FROM g, q),
p AS (SELECT strftime((last || '-01')::DATE + to_months((gap + i)::INT), '%Y-%m') AS month, round(greatest(0.0, net * pow(1 + growth, gap + i)), 2) AS net, growth, quarter FROM e, range(1, 4) t(i))
SELECT month, net, round(growth * 100, 1) AS growth_pct, CASE WHEN quarter <> 0 THEN round((sum(net) OVER () - quarter) / abs(quarter) * 100, 6) END AS quarter_change_pct FROM p""",
    "portfolio_quadrants": f"""
WITH {GROUP_SQL},
s AS (SELECT "group", (paired_net - cost) / paired_net * 100 AS m, net / (SELECT sum(gross) FROM g) * 100 AS s FROM g WHERE paired_rows > 0 AND paired_net <> 0),
t AS (SELECT median(m) AS mm, median(s) AS ms FROM s)
SELECT "group", CASE WHEN m >= mm AND s >= ms THEN 'estrella' WHEN s >= ms THEN 'vaca_lechera' WHEN m >= mm THEN 'oportunidad' ELSE 'problema' END AS quadrant FROM s, t""",
    "break_even": f"""
WITH t AS (SELECT sum(net) FILTER (cost IS NOT NULL)::DOUBLE AS paired_net, sum(cost)::DOUBLE AS cost FROM ({COSTED_SQL}))
SELECT (paired_net - cost) / paired_net AS gross_margin, CASE WHEN paired_net > cost THEN {EXPENSES}::DOUBLE / ((paired_net - cost) / paired_net) END AS break_even_sales,
  paired_net - cost * 0.9::DOUBLE AS profit_cost_minus_10, paired_net - cost * 0.95::DOUBLE AS profit_cost_minus_5, paired_net - cost * 1.05::DOUBLE AS profit_cost_plus_5, paired_net - cost * 1.1::DOUBLE AS profit_cost_plus_10 FROM t""",
    "currency_detection": """
SELECT CASE o_orderkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'CLP' WHEN 2 THEN 'EUR' WHEN 3 THEN 'CLP' WHEN 4 THEN 'UF' END AS currency, count(*) AS values FROM orders WHERE o_orderkey % 6 < 5 GROUP BY 1""",
    "stock_cover": """
WITH s AS (SELECT l_partkey AS part, sum(l_quantity)::DOUBLE AS units FROM lineitem GROUP BY 1),
r AS (SELECT p_partkey AS part, p_size * 100 AS stock, coalesce(units, 0)::DOUBLE AS units FROM part LEFT JOIN s ON p_partkey = part),
c AS (SELECT *, CASE WHEN units > 0 THEN stock / (units / 2500) END AS cover_days FROM r)
SELECT part, stock::BIGINT AS stock, units, cover_days, CASE WHEN cover_days IS NULL THEN 'sin_datos' WHEN cover_days < 7 THEN 'critico' WHEN cover_days < 15 THEN 'alto' WHEN cover_days < 30 THEN 'medio' ELSE 'sano' END AS state FROM c""",
    "product_leaders": f"""WITH {GROUP_SQL}
SELECT (SELECT "group" FROM g ORDER BY net DESC, "group" LIMIT 1) AS by_net, (SELECT "group" FROM g WHERE paired_rows > 0 ORDER BY paired_net - cost DESC, "group" LIMIT 1) AS by_profit,
  (SELECT "group" FROM g WHERE paired_rows > 0 AND paired_net <> 0 ORDER BY (paired_net - cost) / paired_net * 100, "group" LIMIT 1) AS lowest_margin""",
    "customer_concentration": """
WITH c AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS a FROM orders GROUP BY 1)
SELECT count(*) AS customers, max(a)::DOUBLE AS largest, max(a)::DOUBLE / sum(a)::DOUBLE * 100 AS concentration_pct FROM c""",
    "average_ticket": f"""
SELECT count(DISTINCT l_orderkey) AS documents, count(*) AS lines, sum(l_quantity::BIGINT)::BIGINT AS units, sum(net)::DOUBLE / count(DISTINCT l_orderkey) AS per_document, sum(net)::DOUBLE / count(*) AS per_line FROM ({SALES_SQL})""",
}
