"""What the corpus operators share: reading tables, durable intermediate results, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.durable import forget, forget_at_exit, shared_folder, written

__all__ = ["broadcast_if_small", "carried", "durable", "fold_of", "forget", "forget_at_exit", "restored", "shared_folder", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage; it goes as spark.cleaner.referenceTracking.cleanCheckpoints says."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Hint a broadcast only if df, made of a few fixed-width columns, has at most max_rows rows.

    Beyond that the frame is returned as it is and Spark shuffles the join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def carried(docs: DataFrame, *replaced: str) -> Column:
    """All columns of docs as one struct ``row``, but for those whose names the operator's own results take.

    What an operator adds on the way cannot clash with names inside the struct.
    """
    taken = {name.lower() for name in replaced}
    names = [F.col(f"`{name}`") for name in docs.columns if name.lower() not in taken]
    return (F.struct(*names) if names else F.struct(F.lit(None).cast("string").alias("_none"))).alias("row")


def restored(rows: DataFrame, *added: str) -> DataFrame:
    """The columns that carried() packed, and those added."""
    names = [name for name in rows.schema["row"].dataType.names if name != "_none"]
    return rows.select(*[F.col("row")[name].alias(name) for name in names], *added)


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
