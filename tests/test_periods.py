import datetime as dt
import zipfile

import pytest

from tabularium.operators import periods, workbook
from tabularium.sources import books, tables

D = dt.date


@pytest.mark.parametrize(
    "title, want",
    [
        ("Ventas enero a marzo 2025", (D(2025, 1, 1), D(2025, 3, 31))), ("VENTAS FEBRERO 2024", (D(2024, 2, 1), D(2024, 2, 29))), ("noviembre a enero 2025", (D(2024, 11, 1), D(2025, 1, 31))),
        ("Noviembre 2023 - Enero 2025", (D(2023, 11, 1), D(2025, 1, 31))), ("Informe 2025", (D(2025, 1, 1), D(2025, 12, 31))), ("2024 y 2025", (None, None)), ("enero a marzo", (None, None)), ("", (None, None)), ("Ventas", (None, None)),
    ],
)
def test_titles(title, want):
    assert periods.titled_period(title) == want


@pytest.mark.parametrize(
    "name, rows, want",
    [
        ("Parámetros", [("Moneda", "CLP"), ("Período ventas", "31/03/2025 al 01/01/2025")], (D(2025, 1, 1), D(2025, 3, 31))),
        ("parametros", [("periodo de venta", "2025-01-01 / 2025-02-28"), ("periodo ventas", "01/01/2020-02/02/2020")], (D(2025, 1, 1), D(2025, 2, 28))),
        ("Parametros", [("Periodo ventas", "31/02/2025 y x"), ("Periodo ventas", "desde 01/01/2025")], (None, None)), ("Parametros", [], (None, None)), ("Ventas", [("Periodo ventas", "01/01/2025 02/01/2025")], (None, None)),
    ],
)
def test_parameter_sheets(spark, name, rows, want):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 2)], "_src_row int, `Parámetro` string, `Valor.` string")
    assert periods.declared_period({"Otra": df.select("_src_row"), name: df}) == want


def test_a_declared_period_bounds_the_analysis(spark):
    rows = [("D1", "C1", "P1", "2024-12-31", "100"), ("D2", "C1", "P1", "2025-01-15", "200"), ("D3", "C2", "P1", "2025-03-31", "300"), ("D4", "C2", "P1", "2025-04-01", "400")]
    sales = spark.createDataFrame(rows, "`ID Venta` string, `ID Cliente` string, SKU string, `Fecha Venta` string, `Monto Venta` string")
    parameters = spark.createDataFrame([("Periodo ventas", "01/01/2025 - 31/03/2025")], "Parametro string, Valor string")
    sheets = {"Ventas": sales, "Parametros": parameters}
    book = workbook.read_book(sheets)
    found = workbook.analyse(book, declared=periods.declared_period(sheets))["months"]
    assert sorted(r["month"] for r in found.collect()) == ["2025-01", "2025-03"]
    assert workbook.analyse(book, since="2025-04", declared=(None, D(2025, 12, 31)))["months"].count() == 1


def test_titles_and_formulas_of_a_sheet(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    text = lambda r, t: f'<c r="{r}" t="inlineStr"><is><t>{t}</t></is></c>'
    parts = books._parts([{"name": "Ventas", "columns": [], "rows": 0}])
    parts["xl/worksheets/sheet1.xml"] = (
        f'<worksheet {main}><sheetData><row r="1">{text("A1", "Ventas enero a marzo 2025")}</row><row r="3">{text("A3", "ID Venta")}{text("B3", "Monto")}{text("C3", "Fecha")}</row>'
        f'<row r="4"><c r="A4"><f>RAND()*10</f><v>3</v></c><c r="B4"><f>C4*2</f><v>1</v></c>{text("C4", "2025-01-02")}</row>'
        f'<row r="5"><c r="A5"><v>8</v></c><c r="B5"><v>5</v></c>{text("C5", "2025-01-03")}</row></sheetData></worksheet>'
    )
    path = str(tmp_path / "ventas.xlsx")
    with zipfile.ZipFile(path, "w") as book:
        for name, body in parts.items():
            book.writestr(name, body)
    shape = tables.sheet_shape(path, "Ventas")
    assert (shape.titles, shape.row) == (["Ventas enero a marzo 2025"], 3) and periods.titled_period(shape.titles[0]) == (D(2025, 1, 1), D(2025, 3, 31))
    notes, said = tables.formula_notes(spark, path, "Ventas")
    assert [tuple(r)[:5] for r in notes.collect()] == [("ID Venta", 1, 1, 1, True), ("Monto", 1, 0, 1, False)]
    assert len(said) == 3 and "volatile" in said[1] and notes.first()["examples"] == ["=RAND()*10"]
