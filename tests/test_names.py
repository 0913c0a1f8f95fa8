"""Headers as users write them, and names that the library uses on the way, through every entry point of a sheet."""

import pytest
from pyspark.sql import functions as F

from tabularium.functions.names import col, fresh, quoted
from tabularium.operators import aggregates, catalogue, cleaning, joins, labels, metrics, quality, reshape, standardize, workbook
from tabularium.sources import sinks, tables

HEADERS = ["Fecha emis.", "Cod. Cliente", "Cliente 'A'", "Monto total.", "Cant. Devuelta", "Forma de pago descrip.", "Año`s", 'Dijo "sí"', "_key", "_k", "_block"]
ROWS = [
    [f"{1 + i % 28:02d}/0{1 + i % 6}/2025", f"C-00{i % 5}", ["Ana Pérez", "ANA PEREZ", "Luis"][i % 3], f"{1000 + 37 * i},50", str(i % 4), ["Débito", "debito", "Crédito"][i % 3], str(2020 + i % 3), "x", "k", f"{i}", "b"]
    for i in range(40)
] + [["31/02/2025", None, "", "por definir", "-", None, "", "x", "k", "7", "b"]]


@pytest.fixture(scope="module")
def sheet(spark):
    schema = ", ".join(f"{quoted(h)} string" for h in HEADERS)
    rows = [(i + 2, *r) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, f"_src_row int, {schema}")


def test_names_are_literal(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `c``d` int, `_k` int")
    assert tuple(df.select(col("a.b"), col("c`d")).first()) == (1, 2)
    assert fresh(["_k", "_K_"], "_k", "x") == ["_k__", "x"]


def test_standardize(sheet):
    done = standardize.standardize(sheet)
    assert done.types["Fecha emis."].kind == "fecha" and done.types["Monto total."].kind == "numero"
    rows = {r["_src_row"]: r for r in done.frame.collect()}
    assert len(rows) == 41 and str(rows[2]["Fecha emis.__date"]) == "2025-01-01" and rows[3]["Monto total.__num"] == 1037.5
    assert {r["Forma de pago descrip."] for r in rows.values()} == {"Débito", "Crédito", None}
    assert {r["column"] for r in standardize.observations(done).collect()} == {"Fecha emis.", "Monto total."}


def test_clean_and_audited_export(spark, sheet, tmp_path):
    rules = cleaning.Rules(drop_duplicates=True)
    done = cleaning.clean(sheet, rules)
    assert done.frame.columns == ["_src_row", *HEADERS] and done.frame.count() == 41
    changed = {(r["row"], r["column"]) for r in done.audit.where("action = 'transformado'").collect()}
    assert ("2", "Fecha emis.") in changed and ("3", "Monto total.") in changed
    said = {r["key"]: r["value"] for r in sinks.write_audited(done, rules, str(tmp_path / "out"), "libro").collect()}
    assert said["filas"] == "41"
    assert sinks.export_frame(sheet).columns == sheet.columns and sinks.content_hash(sheet) == sinks.content_hash(sheet.repartition(3))


def test_compute_and_catalogue(spark, sheet):
    found = metrics.compute(standardize.standardize(sheet.withColumnsRenamed({"Fecha emis.": "Fecha venta.", "Monto total.": "Monto venta."})))
    assert found.monthly.count() == 6
    clients = spark.createDataFrame([(f"C-00{i}", f"Nombre {i}", "x") for i in range(5)], "`Cod. Cliente` string, `Nombre cli.` string, `_k` string")
    sheets = {"Ventas": sheet.drop("_src_row"), "Clientes": clients}
    assert catalogue.catalogue(sheets) is not None


def test_read_book(spark, sheet):
    assert workbook.read_book({"Ventas": sheet}) is not None


def test_csv_and_workbook_round_trip(spark, sheet, tmp_path):
    path = tmp_path / "hoja.csv"
    sinks.write_csv(sheet.drop("_src_row").coalesce(1), str(path))
    part = next(p for p in path.iterdir() if p.name.startswith("part-"))
    assert tables.read_csv(spark, str(part)).columns[: len(HEADERS)] == HEADERS


def test_operators_with_inner_names(spark, sheet):
    assert labels.merge_labels(sheet, "Cliente 'A'").columns == sheet.columns
    assert reshape.fill_down(sheet, "Cod. Cliente", "_src_row").where(F.col("`Cod. Cliente`").isNull()).count() == 0
    assert quality.duplicate_groups(sheet, HEADERS[:3]).count() == 0 and quality.null_profile(sheet, HEADERS).count() == len(HEADERS)
    prices = spark.createDataFrame([("C-001", 5.0), ("C-002", 6.0)], "`Cod. Cliente` string, `Precio.` double")
    out = joins.lookup(sheet, "Cod. Cliente", prices, "Cod. Cliente", "Precio.", "_price")
    assert out.columns == [*sheet.columns, "_price"] and out.where("_price = 5.0").count() == 8
    assert joins.safe_left_join(sheet.where(F.col("`Cod. Cliente`").isin("C-001", "C-002")), prices, ["Cod. Cliente"], ["Cod. Cliente"]).count() == 16
    assert aggregates.top_and_rest(sheet, col("Cod. Cliente"), F.lit(1), 2).columns == [*sheet.columns, "group"]
    tall = spark.createDataFrame([("a", "ene.", 1), ("a", "feb.", 2), ("b", "ene.", 3)], "`Cod. X` string, `Mes.` string, `Monto.` int")
    wide = reshape.pivot_months(tall, ["Cod. X"], "Mes.", "Monto.", ["ene.", "feb."])
    assert sorted(tuple(r) for r in reshape.unpivot_months(wide, ["Cod. X"], ["ene.", "feb."]).collect()) == sorted(tuple(r) for r in tall.collect())
    n, q = aggregates.exact_quantiles(spark.createDataFrame([(float("inf"),), (1.0,), (2.0,)], "v double"), F.col("v"), [0.0, 0.5, 1.0], most=2)
    assert (n, q) == (3, [1.0, 2.0, float("inf")])
