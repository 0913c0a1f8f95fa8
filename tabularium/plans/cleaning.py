"""Parsing, labels, duplicates, identity and other checks of data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions import text as T
from tabularium.functions.dates import date_profile, parse_date, with_date
from tabularium.functions.numbers import conventions, parse_column, parse_number, with_number
from tabularium.operators import labels as L
from tabularium.operators import quality as Q
from tabularium.operators import reshape as R
from tabularium.plans.star import exact, table


def written_amount(value: Column, style: Column) -> Column:
    """An amount in one of four local styles: $ 1.234.567,89, US$1,234,567.89, (1.234.567,89), 1234567,89 un."""
    english = F.format_number(value, 2)
    latin = F.translate(english, ",.", ".,")
    bare = F.translate(F.replace(english, F.lit(","), F.lit("")), ".", ",")
    return F.when(style == 0, F.concat(F.lit("$ "), latin)).when(style == 1, F.concat(F.lit("US$"), english)).when(style == 2, F.concat(F.lit("("), latin, F.lit(")"))).otherwise(F.concat(bare, F.lit(" un")))


def written_date(day: Column, style: Column) -> Column:
    """A day as yyyy-MM-dd, dd/MM/yyyy, "5 de mayo de 1998", or with a time."""
    names = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.month(day))
    said = F.concat_ws(" de ", F.dayofmonth(day).cast("string"), name, F.year(day).cast("string"))
    return F.when(style == 0, F.date_format(day, "yyyy-MM-dd")).when(style == 1, F.date_format(day, "dd/MM/yyyy")).when(style == 2, said).otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss"))


def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("written", written_amount(F.col("l_extendedprice"), F.col("l_orderkey") % 4))
    return with_number(lines.select("l_orderkey", "l_linenumber", "l_partkey", "written"), F.col("written"), "amount").drop("written")


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("written", written_date(F.col("l_shipdate"), F.col("l_orderkey") % 4))
    return with_date(lines.select("l_orderkey", "l_linenumber", "l_partkey", "written"), F.col("written"), "day").drop("written")


def column_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conventions voted by a column of mostly latin amounts, and the order of a column of dates of both orders."""
    orders = table(spark, sf_dir, "orders")
    english = F.format_number("o_totalprice", 2)
    amount = F.when(F.col("o_orderkey") % 9 == 1, F.concat((F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(",250"))).when(F.col("o_orderkey") % 9 == 2, "n/a").otherwise(F.translate(english, ",.", ".,"))
    day = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(F.col("o_orderkey") % 5 == 1, "pendiente").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    texts = orders.select(amount.alias("amount"), day.alias("day"))
    numbers = conventions(texts, "amount").withColumnRenamed("ambiguous", "ambiguous_numbers")
    days = date_profile(texts, "day").withColumnRenamed("ambiguous", "ambiguous_dates")
    return numbers.join(F.broadcast(days))  # one row each


def plain_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole thousands written 850.000, read by the column's own convention."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.translate(F.format_number(F.col("p_size") * 1000, 0), ",", ".").alias("written"))
    return parse_column(parts, "written", "amount").select("p_partkey", "amount")


def _styled(name: Column, style: Column) -> Column:
    return F.when(style == 0, F.upper(name)).when(style == 1, F.lower(name)).otherwise(F.initcap(name))


def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(_styled(F.col("p_type"), F.col("p_partkey") % 3).alias("kind"))
    return L.canonical_labels(part, F.col("kind"))


def standardized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", _styled(F.col("p_type"), F.col("p_partkey") % 3).alias("kind"))
    return L.standardize_labels(part, "kind")


def fuzzy_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of which every hundredth lacks its last letter."""
    name = F.col("p_name")
    part = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 100 == 7, F.substr(name, F.lit(1), F.length(name) - 1)).otherwise(name).alias("name"))
    return L.similar_labels(part, F.col("name"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicate_summary(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_quantity", "l_discount", "l_tax"])


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_quantity", "l_discount"], "l_orderkey")


def duplicate_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.classify_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_returnflag"], ["l_linestatus"])


def row_id_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.row_id_conflicts(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag"), "l_orderkey")


def identity_inconsistencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.identity_inconsistencies(table(spark, sf_dir, "part"), "p_name", "p_brand")


def structural_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that purchases lack but for one in 61, and errors for one in 31; filled elsewhere but for one in 40."""
    key = F.col("event_id")
    lacks = F.when(F.col("event_type") == "purchase", key % 61 != 0).when(F.col("event_type") == "error", key % 31 != 0).otherwise(key % 40 == 0)
    events = table(spark, sf_dir, "events").select("event_type", F.when(~lacks, F.col("value")).cast("string").alias("value"), F.when(key % 40 != 0, "k").alias("k"))
    return Q.structural_nulls(events, "event_type", ["value", "k"])


def quality_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text: amounts and dates spoiled, statuses in small letters, some rows twice, two customers a name."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("customer"), F.concat(F.lit("Cliente "), F.floor(F.col("o_custkey") / 2).cast("string")).alias("name"),
        F.when(key % 10 == 3, "por definir").when(key % 100 == 14, "99999999.00").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amount"),
        F.when(key % 7 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.when(key % 9 == 4, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.explode(F.sequence(F.lit(1), F.when(key % 20 == 1, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
    typed = {"amount": parse_number(F.col("amount"), "decimal"), "day": parse_date(F.col("day"))}
    changed = (F.col("status") != F.upper("status")).cast("int")
    abilities = {"fecha": ("day",), "monto": ("amount",), "costo": (), "producto": (), "canal": ("status",), "cliente": ("name", "customer")}
    return Q.quality_dimensions(rows, rows.columns, typed, ("amount",), changed, ("name", "customer"), {k: v for k, v in abilities.items() if v})


def formula_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return Q.formula_mismatch(rows, "amount_is_quantity_by_price", F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"), relative=0.5)


def line_sale_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("price", F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice") / F.col("l_quantity")))
    return Q.line_sale_evidence(rows, F.col("l_extendedprice"), F.col("l_quantity"), F.col("price"))


def audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a cleaned copy: priorities trimmed of their number, statuses P emptied, every fiftieth row gone."""
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    after = before.where("o_orderkey % 50 <> 0").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.when(F.col("o_orderpriority") == "1-URGENT", "URGENT").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return Q.audit_changes(before, after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def unpivot_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All years by priority with a column per month of the table's own range, and back to rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month"), exact(F.col("o_totalprice"), 2).alias("amount"))
    first, last = orders.agg(F.min("month"), F.max("month")).first()
    months = [f"{m // 12}-{m % 12 + 1:02d}" for m in range(_month(first), _month(last) + 1)]
    wide = R.pivot_months(orders, ["o_orderpriority"], "month", "amount", months)
    return R.unpivot_months(wide, ["o_orderpriority"], months).withColumn("amount", F.col("amount").cast("double"))


def _month(name: str) -> int:
    return int(name[:4]) * 12 + int(name[5:]) - 1


def fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under the last user that signed up before them."""
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "signup", F.col("user_id")).alias("block"))
    return R.fill_down(events, "block", "event_id", block=1000)


def join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with and without zero padding, and months of two styles, as relation keys."""
    padded = F.concat(F.lit("Vén-"), F.lpad(F.col("p_size").cast("string"), 4, "0"))
    month = F.concat_ws("/", F.lit("2025"), (F.col("p_partkey") % 12 + 1).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.relation_key(padded).alias("code"), T.relation_key(month).alias("month"))


def tax_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax ids of a number and a check digit, written with dots: each seventh has a wrong digit, each eleventh is no id."""
    number = F.col("c_custkey") + 10_000_000
    digit = T.rut_digit(number.cast("string"))
    wrong = F.when(digit == "K", "0").when(digit == "9", "K").otherwise((digit.try_cast("int") + 1).cast("string"))
    said = F.concat(F.translate(F.format_number(number, 0), ",", "."), F.lit("-"), F.lower(F.when(F.col("c_custkey") % 7 == 0, wrong).otherwise(digit)))
    written = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("RUT "), said)).otherwise(said)
    return table(spark, sf_dir, "customer").select("c_custkey", T.rut(written).alias("canonical"), T.rut_valid(written).alias("valid"))


QUERIES = {f.__name__: f for f in (
    parse_numbers, parse_dates, column_conventions, plain_thousands, canonical_labels, standardized_labels, fuzzy_suggestions, exact_duplicates, duplicate_groups, duplicate_classification,
    row_id_conflicts, identity_inconsistencies, structural_nulls, quality_dimensions, formula_control, line_sale_evidence, audit_diff, unpivot_months, fill_down, join_keys, tax_ids,
)}

_KEY = "regexp_replace(lower(trim(x)), '[^a-z0-9]', '', 'g')"
ORACLES = {
    "parse_numbers": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 4 = 2 THEN -l_extendedprice ELSE l_extendedprice END AS amount FROM lineitem",
    "parse_dates": "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE AS day FROM lineitem",
    "column_conventions": """
WITH d AS (SELECT o_orderkey % 9 AS k, o_orderkey % 5 AS f, day(o_orderdate) AS d, month(o_orderdate) AS m FROM orders),
c AS (SELECT count(*) FILTER (k = 1) AS ambiguous_numbers, count(*) FILTER (f > 1 AND d > 12) AS dmy, count(*) FILTER (f = 0 AND d > 12) AS mdy, count(*) FILTER (f <> 1 AND d <= 12) AS ambiguous_dates FROM d)
SELECT 'miles' AS dot3, 'decimal' AS comma3, ambiguous_numbers, dmy, mdy, ambiguous_dates, dmy >= mdy AS dayfirst, dmy > 0 AND mdy > 0 AS mixed FROM c""",
    "plain_thousands": "SELECT p_partkey, (p_size * 1000)::DOUBLE AS amount FROM part",
    "canonical_labels": """
SELECT lower(p_type) AS key, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS canonical, count(DISTINCT p_partkey % 3) AS variants, count(*) AS rows FROM part GROUP BY p_type""",
    "standardized_labels": "SELECT p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS kind FROM part",
    "fuzzy_suggestions": f"""
WITH n AS (SELECT CASE WHEN p_partkey % 100 = 7 THEN left(p_name, length(p_name) - 1) ELSE p_name END AS x FROM part), k AS (SELECT {_KEY} AS key, count(*) AS rows FROM n GROUP BY 1 HAVING length(key) >= 4),
m AS (SELECT a.key AS rare, b.key AS frequent, a.rows AS rare_rows, b.rows AS frequent_rows, levenshtein(a.key, b.key)::INT AS distance FROM k a JOIN k b
  ON a.key <> b.key AND left(a.key, 1) = left(b.key, 1) AND b.rows >= 3 AND a.rows <= greatest(2, b.rows // 2) AND abs(length(a.key) - length(b.key)) <= 2
  WHERE levenshtein(a.key, b.key) <= CASE WHEN length(a.key) <= 6 THEN 1 ELSE 2 END)
SELECT rare, frequent, rare_rows, frequent_rows, distance FROM m QUALIFY row_number() OVER (PARTITION BY rare ORDER BY frequent_rows DESC, frequent) = 1""",
    "exact_duplicates": """
WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity, l_discount, l_tax)
SELECT sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_groups, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS extra_rows, max(n) FILTER (n > 1) AS largest FROM g""",
    "duplicate_groups": """
SELECT l_suppkey, l_quantity, l_discount, count(*) AS size, min(l_orderkey) AS first_row, max(l_orderkey) - min(l_orderkey) + 1 = count(*) AS contiguous FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "duplicate_classification": """
SELECT l_orderkey, l_linenumber, count(*) AS size, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'conflict' WHEN count(DISTINCT l_returnflag || l_linestatus) > 1 THEN 'observation_only' ELSE 'identical' END AS kind
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "row_id_conflicts": "SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linestatus || l_returnflag) AS variants FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus || l_returnflag) > 1",
    "identity_inconsistencies": f"""
WITH p AS (SELECT DISTINCT {_KEY} AS name, p_brand AS id FROM (SELECT p_name AS x, p_brand FROM part)),
a AS (SELECT 'name_with_ids' AS kind, name AS value, id AS other FROM p UNION ALL SELECT 'id_with_names', id, name FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY other) AS r FROM a)
SELECT kind, value, count(*) AS others, string_agg(other, ', ' ORDER BY other) FILTER (r <= 5) AS examples FROM r GROUP BY 1, 2 HAVING count(*) > 1""",
    "structural_nulls": """
WITH e AS (SELECT event_type AS t, CASE WHEN event_type = 'purchase' THEN event_id % 61 <> 0 WHEN event_type = 'error' THEN event_id % 31 <> 0 ELSE event_id % 40 = 0 END AS v, event_id % 40 = 0 AS k FROM events),
u AS (SELECT t, 'value' AS c, v AS gap FROM e UNION ALL SELECT t, 'k', k FROM e), g AS (SELECT t, c, count(*) AS n, count(*) FILTER (gap) AS x FROM u GROUP BY 1, 2),
s AS (SELECT t, c, n, x::DOUBLE / n AS own, 1 - (sum(x) OVER (PARTITION BY c) - x)::DOUBLE / (sum(n) OVER (PARTITION BY c) - n) AS elsewhere FROM g)
SELECT t AS category, c AS "column", n AS rows, own * 100 AS empty_pct, elsewhere * 100 AS filled_elsewhere_pct FROM s WHERE n >= 20 AND own >= 0.98 AND elsewhere >= 0.95""",
    "quality_dimensions": """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 100 = 14 THEN 99999999.0::DOUBLE ELSE CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE END AS a,
  o_orderkey % 7 = 0 AS gap, o_orderdate::DATE AS d, o_orderstatus AS s, o_orderkey % 9 = 4 AS small FROM orders),
r AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE k % 20 = 1),
q AS (SELECT quantile_cont(a, 0.25) AS l, quantile_cont(a, 0.75) AS h FROM r),
p AS (SELECT count(*) AS n, count(DISTINCT (c, coalesce(a, -1), CASE WHEN gap THEN NULL ELSE d END, gap, s, small)) AS u, count(*) FILTER (gap) AS e, count(*) FILTER (a IS NULL) AS w,
  count(*) FILTER (a < l - 3 * (h - l) OR a > h + 3 * (h - l)) AS x, count(*) FILTER (small) AS t FROM r, q),
i AS (SELECT count(*) AS v FROM (SELECT c // 2 FROM o GROUP BY 1 HAVING count(DISTINCT c) > 1))
SELECT n::BIGINT AS rows, round((1 - e / (n * 5)) * 100, 1) AS completitud, round((1 - (w + x) / (n * 5)) * 100, 1) AS validez, round((1 - t / (n * 5)) * 100, 1) AS consistencia,
  round((1 - (n - u) * 5 / (n * 5)) * 100, 1) AS unicidad, round((1 - v / n) * 100, 1) AS integridad, round(((n - e) / n + (n - w) / n + 1 + 1) / 4 * 100, 1) AS cobertura_analitica FROM p, i""",
    "formula_control": """
WITH r AS (SELECT abs(l_extendedprice - l_quantity * p_retailprice) > greatest(1.0, abs(l_quantity * p_retailprice) * 0.5) AS wrong FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT 'amount_is_quantity_by_price' AS control, count(*) AS compared, count(*) FILTER (wrong) AS mismatches, (count(*) - count(*) FILTER (wrong))::DOUBLE / count(*) * 100 AS agreement_pct FROM r""",
    "line_sale_evidence": """
SELECT count(*) AS rows, count(*) FILTER (l_linestatus = 'F') AS compared, count(*) FILTER (l_linestatus = 'F') AS agreeing, count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*) AS coverage, 1::DOUBLE AS agreement,
  count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*) >= 0.6 AS line_sales FROM lineitem""",
    "audit_diff": """
SELECT o_orderkey, NULL::VARCHAR AS "column", NULL::VARCHAR AS before, NULL::VARCHAR AS after, 'row_removed' AS change FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'P', NULL, 'emptied' FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'o_orderpriority', '1-URGENT', 'URGENT', 'changed' FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderpriority = '1-URGENT'""",
    "unpivot_months": "SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS amount FROM orders GROUP BY 1, 2",
    "fill_down": "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN user_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS block FROM events",
    "join_keys": "SELECT p_partkey, 'ven-' || p_size AS code, '2025-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') AS month FROM part",
    "tax_ids": """
WITH d AS (SELECT c_custkey, c_custkey + 10000000 AS b FROM customer),
w AS (SELECT c_custkey, b, 11 - list_sum([substr(b::VARCHAR, (9 - i)::INT, 1)::INT * ((i - 1) % 6 + 2) for i in range(1, 9)]) % 11 AS r FROM d),
k AS (SELECT c_custkey, b, CASE r WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE r::INT::VARCHAR END AS g FROM w),
x AS (SELECT c_custkey, b, CASE WHEN c_custkey % 7 <> 0 THEN g WHEN g = 'K' THEN '0' WHEN g = '9' THEN 'K' ELSE (g::INT + 1)::VARCHAR END AS shown FROM k)
SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN b || '-' || shown END AS canonical, c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AS valid FROM x""",
}
