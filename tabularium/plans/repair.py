"""Sheets that came in damaged: values under each other's headers, text in the wrong encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.encoding import repair
from tabularium.operators.realign import realign
from tabularium.plans.star import table


def shifted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a sheet whose discount, minimum stock and state stand one column off, under their own headers again."""
    state = F.when(F.col("p_partkey") % 3 == 0, "No").otherwise("Sí")
    rate = F.format_string("0,%02d", (F.col("p_partkey") % 89 + 10).cast("int"))
    sheet = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") + 1).cast("string").alias("Activo"), state.alias("% Descuento"), rate.alias("Stock mínimo")
    )
    back, moved = realign(sheet)
    said = ", ".join(sorted(f"{m.column} <- {m.taken_from}" for m in moved))
    return back.select("p_partkey", F.col("Activo").alias("activo"), F.col("% Descuento").alias("descuento"), F.col("Stock mínimo").alias("minimo"), F.lit(said).alias("movido"))


#: How customers' names come in, by the last digit of their key: before it, after it, and as it should be.
_DAMAGED = [("Lâ€™", "", "L’", ""), ("", " Ã±andÃº", "", " ñandú"), ("日 ", " CategorÃ­a", "日 ", " Categoría"), ("", " plain ñ", "", " plain ñ"), ("Ã ", " x", "Ã ", " x")]


def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names with damaged words around them: the repaired text, how it was read, and how sure that is."""
    kind = F.pmod(F.col("c_custkey"), F.lit(len(_DAMAGED)))
    text = F.lit(None).cast("string")
    for n, (before, after, _, _) in enumerate(_DAMAGED):
        text = F.when(kind == n, F.concat(F.lit(before), "c_name", F.lit(after))).otherwise(text)
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")).withColumn("fixed", repair(F.col("text")))
    return rows.select("c_custkey", F.coalesce("fixed.text", "text").alias("text"), "fixed.method", "fixed.confidence", F.coalesce("fixed.applied", F.lit(False)).alias("applied"))


QUERIES = {"shifted_columns": shifted_columns, "repaired_texts": repaired_texts}
ORACLES = {
    "shifted_columns": """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'No' ELSE 'Sí' END AS activo, '0,' || (p_partkey % 89 + 10) AS descuento, (p_size + 1)::VARCHAR AS minimo,
  '% Descuento <- Stock mínimo, Activo <- % Descuento, Stock mínimo <- Activo' AS movido
FROM part""",
    "repaired_texts": """
SELECT c_custkey,
  CASE c_custkey % 5 WHEN 0 THEN 'L’' || c_name WHEN 1 THEN c_name || ' ñandú' WHEN 2 THEN '日 ' || c_name || ' Categoría' WHEN 3 THEN c_name || ' plain ñ' ELSE 'Ã ' || c_name || ' x' END AS text,
  CASE c_custkey % 5 WHEN 0 THEN 'cp1252' WHEN 1 THEN 'latin-1+cp1252' WHEN 2 THEN 'latin-1+cp1252' END AS method,
  CASE c_custkey % 5 WHEN 0 THEN 0.98::DOUBLE WHEN 1 THEN 0.98 WHEN 2 THEN 0.98 WHEN 4 THEN 0.0 END AS confidence,
  c_custkey % 5 < 3 AS applied
FROM customer""",
}
