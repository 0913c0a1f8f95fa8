"""Writers: typed and raw columns side by side, formulas neutralised, content hashes, audited exports."""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.names import col
from tabularium.functions.text import safe_cell
from tabularium.operators.cleaning import Cleaned, Rules
from tabularium.sources.books import CHANGED, REVIEW, SHEET_ROWS, Sheet, write_book

__all__ = ["SHEET_ROWS", "content_hash", "export_frame", "write_audited", "write_audited_book", "write_csv", "write_workbook"]


def export_frame(df: DataFrame, numbers: dict[str, Column] | None = None, dates: dict[str, Column] | None = None) -> DataFrame:
    """df for export: parsed values beside the text of each typed column, and no text that would run as a formula."""
    typed = {**(numbers or {}), **(dates or {})}
    cells = [safe_cell(col(c)).alias(c) if t == "string" else col(c) for c, t in df.dtypes]
    return df.select(*cells, *[value.alias(f"{c}__typed") for c, value in typed.items()])


def write_csv(df: DataFrame, path: str, separator: str = ";") -> None:
    df.write.mode("overwrite").options(header=True, sep=separator, encoding="UTF-8", quote='"', escape='"').csv(path)


def content_hash(df: DataFrame) -> str:
    """A hash of the table's rows that depends neither on files nor on order; repeated rows count."""
    row = F.sha2(F.to_json(F.struct(*[col(c).cast("string").alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("h")).first()["h"]


def write_workbook(frames: dict[str, DataFrame], path: str) -> None:
    """A workbook of reports, written in tasks. A sheet with more rows than spreadsheets open is refused before writing."""
    write_book(frames, path)


MANIFEST = "key string, value string"


def write_audited(done: Cleaned, rules: Rules, folder: str, source: str) -> DataFrame:
    """A cleaned sheet with everything that was done to it, as CSV folders written in tasks, and its manifest (key, value).

    datos has the sheet, auditoria every changed or kept cell, observaciones what needs a look, problemas, columnas and
    calidad the figures. The manifest names the source, digests of data and audit, the rules and the counts.
    """
    spark = done.frame.sparkSession
    review = done.audit.where("action <> 'transformado' AND rule <> 'alcance_exportacion'")
    parts = {"datos": done.frame, "auditoria": done.audit, "observaciones": review, "problemas": done.problems, "columnas": done.by_column, "calidad": done.quality}
    for name, frame in parts.items():
        write_csv(frame, f"{folder}/{name}")
    said = {
        "fuente": source, "reglas": json.dumps(asdict(rules), sort_keys=True), "filas": str(done.frame.count()), "cambios": str(done.audit.where("action = 'transformado'").count()),
        "observaciones": str(review.count()), "sha_datos": str(content_hash(done.frame)), "sha_auditoria": str(content_hash(done.audit)), **{f"aviso_{i}": w for i, w in enumerate(done.warnings, 1)},
    }
    manifest = spark.createDataFrame(list(said.items()), MANIFEST)
    write_csv(manifest, f"{folder}/manifiesto")
    return manifest


SCOPE = "alcance_exportacion"


def write_audited_book(done: dict[str, Cleaned], rules: Rules, path: str, source: str, row: str = "_src_row", split: bool = False) -> DataFrame:
    """Cleaned sheets in one workbook with everything that was done to them, written in tasks; its manifest (sheet, key, value).

    Each sheet keeps its name and its order; changed cells are coloured, and in another colour those kept for a look.
    Columns of numbers and days hold typed cells, texts that do not read as such stay text. Three sheets follow:
    Observaciones (what needs a look), Auditoria (every changed, kept or removed thing) and Manifiesto (source, rules,
    counts and digests of each sheet's data and audit). Rows never reach the driver.
    """
    spark = next(iter(done.values())).frame.sparkSession
    sheets, audits, said = {}, [], [("", "fuente", source), ("", "reglas", json.dumps(asdict(rules), sort_keys=True))]
    for name, x in done.items():
        cells = x.audit.where((F.col("column") != "*") & (F.col("rule") != SCOPE))
        mark = F.when(F.col("action") == "transformado", CHANGED).otherwise(REVIEW)
        kinds = {r["column"]: r["kind"] for r in x.by_column.select("column", "kind").collect()}
        sheets[name] = Sheet(x.frame, row, cells.select("row", "column", mark), kinds)
        audits.append(x.audit.select(F.lit(name).alias("sheet"), "*"))
        counts = x.audit.agg(F.count(F.when(F.col("action") == "transformado", 1)).alias("c"), F.count(F.when((F.col("action") != "transformado") & (F.col("rule") != SCOPE), 1)).alias("o")).first()
        said += [(name, "filas", str(x.frame.count())), (name, "cambios", str(counts["c"])), (name, "observaciones", str(counts["o"]))]
        said += [(name, "sha_datos", content_hash(x.frame)), (name, "sha_auditoria", content_hash(x.audit)), *((name, f"aviso_{i}", w) for i, w in enumerate(x.warnings, 1))]
    audit = reduce(DataFrame.union, audits)
    manifest = spark.createDataFrame(said, "sheet string, key string, value string")
    review = audit.where((F.col("action") != "transformado") & (F.col("rule") != SCOPE))
    extra = {"Observaciones": review, "Auditoria": audit, "Manifiesto": manifest.coalesce(1)}
    write_book(sheets | {name if name not in sheets else f"{name}_": frame for name, frame in extra.items()}, path, split)
    return manifest
