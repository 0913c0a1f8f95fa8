"""The relation catalogue and its dashboards over the star schema's tables as business sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators import catalogue as K
from tabularium.operators import dashboards as D
from tabularium.plans.star import CENTS, cents, exact, sales, table

CUTS = ("2001-06-30", "2001-12-31")


def _lines(spark: SparkSession, sf_dir: str, document: str) -> DataFrame:
    rows = sales(spark, sf_dir)
    return rows.select(F.col("l_orderkey").alias(document), F.col("l_shipdate").cast("date").alias("Fecha"), F.col("l_partkey").cast("string").alias("ID Producto"), F.col("l_quantity").cast("long").alias("Cantidad"), cents(F.col("net")).alias("Monto Neto"))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ID Producto"), F.col("p_name").alias("Nombre Producto"), F.col("p_brand").alias("Categoria"))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference prices as unit costs, zero for parts beyond size 45."""
    price = F.when(F.col("p_size") <= 45, exact(F.col("p_retailprice"), 2)).otherwise(0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ID Producto"), price.cast("decimal(18,2)").alias("Costo Unitario"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ID Venta"), F.col("o_orderdate").cast("date").alias("Fecha"), F.col("o_custkey").cast("string").alias("ID Cliente"), exact(F.col("o_totalprice"), 2).alias("Monto Neto"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ID Cliente"), F.col("c_name").alias("Nombre Cliente"))


def _table(made: D.Dashboard) -> DataFrame:
    """(section, label, value): figures, the ranking and findings under one another."""
    figures = made.figures.select(F.lit("figure").alias("section"), F.concat_ws(": ", "id", "text").alias("label"), "value")
    ranking = made.ranking.select(F.lit("ranking").alias("section"), "label", F.round("value", 2).alias("value"))
    findings = made.findings.select(F.lit("finding").alias("section"), F.concat_ws(": ", "severity", "id").alias("label"), F.round("value", 2).alias("value"))
    return figures.union(ranking).union(findings)


def _built(sheets: dict[str, DataFrame]) -> DataFrame:
    """The dashboard of the one relation that the catalogue finds."""
    (relation,) = K.catalogue(sheets).relations
    return _table(D.build(sheets, relation))


def relation_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations of a book of lines, products, costs and documents with their customers."""
    sheets = {"Compras": _lines(spark, sf_dir, "ID Compra"), "Productos": _products(spark, sf_dir), "Ventas": _documents(spark, sf_dir), "Clientes": _customers(spark, sf_dir), "Notas": table(spark, sf_dir, "region")}
    found = K.catalogue(sheets).relations
    rows = [(r.id, r.template, r.stats.cardinality, r.stats.left_rows, r.stats.left_matched_rows, r.stats.coverage) for r in found]
    return spark.createDataFrame(rows, "id string, template string, cardinality string, rows long, matched long, coverage double")


def relation_products_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built({"Ventas": _lines(spark, sf_dir, "ID Venta"), "Productos": _products(spark, sf_dir)})


def relation_sales_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built({"Ventas": _lines(spark, sf_dir, "ID Venta"), "Costos Productos": _costs(spark, sf_dir)})


def relation_sales_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales against two cuts of stock, of which the last counts; a quarter of the parts is not in it."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ID Producto"), "p_partkey", "p_size", F.explode(F.array(*[F.lit(c) for c in CUTS])).alias("c"))
    stock = part.where((F.col("c") == CUTS[0]) | (F.col("p_partkey") % 4 != 0))
    held = F.when(F.col("c") == CUTS[0], F.col("p_size") * 100).otherwise(F.col("p_size") * (F.col("p_partkey") % 7)).cast("long")
    stock = stock.select("ID Producto", F.to_date("c").alias("Fecha Corte"), held.alias("Stock"))
    return _table(D.inventory_dashboard(_lines(spark, sf_dir, "ID Venta"), "ID Producto", stock, "ID Producto"))


def relation_dimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built({"Ventas": _documents(spark, sf_dir), "Clientes": _customers(spark, sf_dir)})


def relation_purchases_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built({"Compras": _lines(spark, sf_dir, "ID Compra"), "Productos": _products(spark, sf_dir)})


def relation_expenses_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as expenses of branches, some without a branch."""
    branch = F.when(F.col("o_custkey") % 30 < 25, (F.col("o_custkey") % 30).cast("string"))
    spent = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ID Gasto"), F.col("o_orderdate").cast("date").alias("Fecha Gasto"), branch.alias("ID Sucursal"), exact(F.col("o_totalprice"), 2).alias("Monto Gasto"))
    branches = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("ID Sucursal"), F.col("n_name").alias("Nombre Sucursal"))
    return _built({"Gastos": spent, "Sucursales": branches})


QUERIES = {f.__name__: f for f in (
    relation_catalogue, relation_products_sales, relation_sales_costs, relation_sales_inventory, relation_dimensional, relation_purchases_costs, relation_expenses_branches,
)}

_V = f"v AS (SELECT l_partkey AS k, l_quantity::BIGINT AS q, {CENTS} AS n, l_shipdate::DATE AS d FROM lineitem)"
_BY_PRODUCT = f"{_V}, p AS (SELECT k, p_name AS label, sum(n) AS a, sum(q) AS u FROM v JOIN part ON k = p_partkey GROUP BY 1, 2), l AS (SELECT label, sum(a)::DOUBLE AS a FROM p GROUP BY 1)"
_TOP = "SELECT 'ranking' AS section, label, value FROM (SELECT label, round(a, 2) AS value FROM l ORDER BY a DESC, label LIMIT 10)"
_SHARE = "SELECT sum(a) AS t FROM (SELECT a FROM l ORDER BY a DESC, label LIMIT 10)"
ORACLES = {
    "relation_catalogue": """
SELECT 'compras~productos~id-producto~id-producto' AS id, 'purchases_costs' AS template, 'many_to_one' AS cardinality, count(*) AS rows, count(p_partkey) AS matched, count(p_partkey)::DOUBLE / count(*) AS coverage
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'ventas~clientes~id-cliente~id-cliente', 'sales_customers', 'many_to_one', count(*), count(c_custkey), count(c_custkey)::DOUBLE / count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "relation_products_sales": f"""
WITH {_BY_PRODUCT}, s AS (SELECT sum(a)::DOUBLE AS a, sum(u)::DOUBLE AS u, count(*)::DOUBLE AS n, ({_SHARE}) AS t FROM p)
SELECT 'figure' AS section, 'ingresos' AS label, round(a, 2) AS value FROM s UNION ALL SELECT 'figure', 'unidades', u FROM s UNION ALL SELECT 'figure', 'productos', n FROM s UNION ALL SELECT 'figure', 'top10', round(t / a * 100, 2) FROM s
UNION ALL {_TOP} UNION ALL SELECT 'finding', 'warning: concentracion_top10', round(t / a * 100, 2) FROM s WHERE t / a * 100 >= 60""",
    "relation_sales_costs": f"""
WITH {_V}, c AS (SELECT v.*, CASE WHEN p_size <= 45 AND p_retailprice > 0 THEN CAST(p_retailprice AS DECIMAL(18,2)) * q END AS c FROM v JOIN part ON k = p_partkey),
p AS (SELECT k, sum(n) AS a, sum(n) FILTER (c IS NOT NULL) AS pa, sum(c) AS c, count(*) AS n, count(c) AS pn FROM c GROUP BY 1), m AS (SELECT *, (pa - c)::DOUBLE AS g, CASE WHEN pa <> 0 THEN (pa - c)::DOUBLE / pa::DOUBLE ELSE 0 END AS m FROM p),
l AS (SELECT k::VARCHAR AS label, g AS a FROM m WHERE g IS NOT NULL),
s AS (SELECT sum(a)::DOUBLE AS a, sum(c)::DOUBLE AS c, sum(pa)::DOUBLE AS pa, sum(pn)::DOUBLE / sum(n) * 100 AS v, count(*) FILTER (pn > 0 AND m > 0) AS good, count(*) FILTER (pn > 0 AND m <= 0) AS bad,
  count(*) FILTER (pn > 0 AND m < 0) AS losing, sum(pa - c) FILTER (m < 0)::DOUBLE AS loss FROM m)
SELECT 'figure' AS section, 'ventas' AS label, round(a, 2) AS value FROM s UNION ALL SELECT 'figure', 'costo', round(c, 2) FROM s UNION ALL SELECT 'figure', 'utilidad', round(pa - c, 2) FROM s
UNION ALL SELECT 'figure', 'margen', round((pa - c) / pa * 100, 2) FROM s UNION ALL SELECT 'figure', 'cobertura', round(v, 2) FROM s UNION ALL SELECT 'figure', 'rentables', good FROM s UNION ALL SELECT 'figure', 'riesgo', bad FROM s
UNION ALL {_TOP} UNION ALL SELECT 'finding', 'risk: margen_negativo', round(loss, 2) FROM s WHERE losing > 0 UNION ALL SELECT 'finding', 'warning: costos_faltantes', round(v, 2) FROM s WHERE v < 100
UNION ALL SELECT 'finding', 'warning: margen_bajo', round((pa - c) / pa * 100, 2) FROM s WHERE (pa - c) / pa < 0.15""",
    "relation_sales_inventory": f"""
WITH {_V}, t AS (SELECT sum(n)::DOUBLE AS a, sum(q)::DOUBLE AS u, (max(d) - min(d) + 1)::DOUBLE AS days FROM v), b AS (SELECT k, sum(q)::DOUBLE AS q FROM v GROUP BY 1),
r AS (SELECT p_partkey, p_size * (p_partkey % 7) AS stock, coalesce(q, 0) AS q FROM part LEFT JOIN b ON p_partkey = k WHERE p_partkey % 4 <> 0),
c AS (SELECT *, CASE WHEN q > 0 THEN round(stock / (q / days), 1) END AS cover FROM r, t),
e AS (SELECT *, CASE WHEN cover IS NULL THEN 'sin_datos' WHEN cover < 7 THEN 'critico' WHEN cover < 15 THEN 'alto' WHEN cover < 30 THEN 'medio' ELSE 'sano' END AS state FROM c),
s AS (SELECT sum(stock)::DOUBLE AS stock, avg(cover) AS cover, count(*) FILTER (state IN ('critico', 'alto')) AS risky, count(*) FILTER (cover > 90) AS over, greatest(1, count(*) // 5) AS enough,
  count(*) FILTER (state = 'critico') AS x, count(*) FILTER (state = 'alto') AS y, count(*) FILTER (state = 'medio') AS z FROM e)
SELECT 'figure' AS section, 'ventas' AS label, round(a, 2) AS value FROM t UNION ALL SELECT 'figure', 'unidades', u FROM t UNION ALL SELECT 'figure', 'stock', stock FROM s UNION ALL SELECT 'figure', 'cobertura', round(cover, 2) FROM s
UNION ALL SELECT 'figure', 'riesgo', risky FROM s UNION ALL SELECT 'figure', 'nivel: ' || CASE WHEN x >= enough THEN 'critico' WHEN y >= enough THEN 'alto' WHEN z >= enough THEN 'medio' ELSE 'sano' END, NULL FROM s
UNION ALL SELECT 'ranking', label, cover FROM (SELECT p_partkey::VARCHAR AS label, cover FROM e WHERE cover IS NOT NULL ORDER BY cover, label LIMIT 10)
UNION ALL SELECT 'finding', 'risk: riesgo_quiebre', x FROM s WHERE x > 0 UNION ALL SELECT 'finding', 'warning: sobreinventario', over FROM s WHERE over > 0""",
    "relation_dimensional": f"""
WITH v AS (SELECT c_custkey AS k, c_name AS label, CAST(o_totalprice AS DECIMAL(18,2)) AS n FROM orders JOIN customer ON o_custkey = c_custkey), l AS (SELECT label, sum(n)::DOUBLE AS a FROM v GROUP BY 1),
s AS (SELECT sum(n)::DOUBLE AS a, count(*) AS r, count(DISTINCT k) AS n, ({_SHARE}) AS t FROM v)
SELECT 'figure' AS section, 'ingresos' AS label, round(a, 2) AS value FROM s UNION ALL SELECT 'figure', 'ticket', round(a / r, 2) FROM s UNION ALL SELECT 'figure', 'n', n FROM s UNION ALL SELECT 'figure', 'concentracion', round(t / a * 100, 2) FROM s
UNION ALL {_TOP} UNION ALL SELECT 'finding', 'warning: concentracion', round(t / a * 100, 2) FROM s WHERE t / a * 100 >= 60""",
    "relation_purchases_costs": f"""
WITH {_BY_PRODUCT}, s AS (SELECT sum(a)::DOUBLE AS a, sum(u)::DOUBLE AS u, count(*)::DOUBLE AS n FROM p)
SELECT 'figure' AS section, 'compras' AS label, round(a, 2) AS value FROM s UNION ALL SELECT 'figure', 'unidades', u FROM s UNION ALL SELECT 'figure', 'productos', n FROM s UNION ALL {_TOP}""",
    "relation_expenses_branches": f"""
WITH v AS (SELECT n_name AS label, CAST(o_totalprice AS DECIMAL(18,2)) AS n FROM orders LEFT JOIN nation ON o_custkey % 30 = n_nationkey), l AS (SELECT label, sum(n)::DOUBLE AS a FROM v WHERE label IS NOT NULL GROUP BY 1),
s AS (SELECT sum(n)::DOUBLE AS a, count(DISTINCT label) AS n, sum(n) FILTER (label IS NOT NULL)::DOUBLE AS i FROM v)
SELECT 'figure' AS section, 'gastos' AS label, round(a, 2) AS value FROM s UNION ALL SELECT 'figure', 'sucursales', n FROM s UNION ALL SELECT 'figure', 'promedio', round(a / n, 2) FROM s UNION ALL {_TOP}
UNION ALL SELECT 'finding', 'warning: sin_sucursal', round(a - i, 2) FROM s WHERE a > i""",
}
