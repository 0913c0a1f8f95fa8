"""Filters of sales and the options that each leaves the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators.facets import Dimension, Reference, named, options
from tabularium.plans.star import SALES_SQL, sales, table

FILTERS = {"canal": "r", "categoria": " BRAND#13 "}


def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What products, brands, return states, nations and sellers remain to choose under a filter of state and one of brand."""
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    found = named(
        sales(spark, sf_dir),
        {
            "producto": Dimension("l_partkey", Reference(part, "p_partkey", "p_name")), "categoria": Dimension("l_partkey", Reference(part, "p_partkey", "p_brand"), or_key=False),
            "canal": Dimension("l_returnflag"), "sucursal": Dimension("l_suppkey", Reference(supplier, "s_suppkey", "n_name")), "vendedor": Dimension("l_suppkey", Reference(supplier, "s_suppkey", "s_name")),
        },
    )
    return options(found, FILTERS, F.col("net"))


QUERIES = {"filter_options": filter_options}
ORACLES = {
    "filter_options": f"""
WITH s AS (
  SELECT net, coalesce(p_name, l_partkey::VARCHAR) AS producto, p_brand AS categoria, l_returnflag AS canal, coalesce(n_name, l_suppkey::VARCHAR) AS sucursal,
         coalesce(s_name, l_suppkey::VARCHAR) AS vendedor, l_returnflag = 'R' AS c, coalesce(p_brand = 'Brand#13', false) AS b
  FROM ({SALES_SQL}) LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey),
o AS (
  SELECT 'producto' AS dimension, producto AS value, false AS selected, net FROM s WHERE c AND b
  UNION ALL SELECT 'sucursal', sucursal, false, net FROM s WHERE c AND b
  UNION ALL SELECT 'vendedor', vendedor, false, net FROM s WHERE c AND b
  UNION ALL SELECT 'canal', canal, c, net FROM s WHERE b
  UNION ALL SELECT 'categoria', categoria, b, net FROM s WHERE c AND categoria IS NOT NULL)
SELECT dimension, value, selected, count(*) AS rows, sum(net)::DOUBLE AS net FROM o GROUP BY ALL""",
}
