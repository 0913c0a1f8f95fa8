"""The star schema's tables with the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(value: Column, scale: int = 4) -> Column:
    """A decimal, so that sums do not depend on their order."""
    return value.cast(f"decimal(18,{scale})")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its net amount."""
    return table(spark, sf_dir, "lineitem").withColumn("net", exact(F.col("l_extendedprice") * (1 - F.col("l_discount"))))


def costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales with the part's brand and, for parts up to size 45, the cost at its reference price."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    rows = sales(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.withColumn("cost", F.when(F.col("p_size") <= 45, exact(F.col("l_quantity") * F.col("p_retailprice"))))


def cents(value: Column) -> Column:
    """Amounts of a business sheet: two places, so that rounded sums have no ties."""
    return value.cast("decimal(18,2)")


NET = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"
CENTS = f"CAST({NET} AS DECIMAL(18,2))"
SALES_SQL = f"SELECT *, {NET} AS net FROM lineitem"
COSTED_SQL = f"""SELECT l.*, p_brand, p_type, p_size, p_retailprice, {NET} AS net,
  CASE WHEN p_size <= 45 THEN CAST(l_quantity * p_retailprice AS DECIMAL(18,4)) END AS cost
  FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey"""
