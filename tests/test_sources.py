import datetime as dt
import zipfile
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabularium.sources import books, sinks, tables


def test_separator_and_headers():
    assert tables.sniff_separator(["a;b;c", '1;"x;y";2']) == ";" and tables.sniff_separator(["a,b", "1,2"]) == "," and tables.sniff_separator(["a\tb"]) == "\t"
    assert tables.unique_headers(["Año", "ano", None, " Total  neto "]) == ["Año", "ano_2", "columna_3", "Total neto"]
    assert tables.header_row([["Informe", "", ""], ["Fecha", "Cliente", "Monto"], ["2026-01-01", "Ana", "100"]]) == 1


def test_csv(spark, tmp_path):
    path = tmp_path / "ventas.csv"
    path.write_text('﻿Fecha;Cliente;Notas\n2026-01-01;"Pérez; hijos";None\n;;\n2026-01-02;;"dos\nlíneas"\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(path)).orderBy(tables.ROW).collect()
    assert [(r["Fecha"], r["Cliente"], r["Notas"]) for r in rows] == [("2026-01-01", "Pérez; hijos", "None"), ("2026-01-02", None, "dos\nlíneas")]


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "libro.xlsx")
    sales = spark.createDataFrame([("2026-01-01", "Ana & Co", 10.5), ("2026-01-02", "=1+1", None)], "Fecha string, Cliente string, Monto double")
    sinks.write_workbook({"Ventas": sinks.export_frame(sales), "Notas": sales.limit(0)}, path)
    found = tables.read_workbook(spark, path)
    rows = found["Ventas"].orderBy(tables.ROW).collect()
    assert [(r["Fecha"], r["Cliente"], r["Monto"]) for r in rows] == [("2026-01-01", "Ana & Co", "10.5"), ("2026-01-02", "'=1+1", None)]
    assert [r[tables.ROW] for r in rows] == [2, 3] and found["Notas"].count() == 0
    assert tables.formulas(spark, path).count() == 0
    with pytest.raises(Exception):
        spark.read.format("workbook").option("path", path).option("sheet", "no").load().count()


def test_content_hash(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, t string")
    assert sinks.content_hash(a) == sinks.content_hash(a.orderBy(F.desc("i")).repartition(3)) != sinks.content_hash(a.distinct())


def test_latin_files_lines_and_totals(spark, tmp_path):
    path = tmp_path / "ventas.csv"
    path.write_bytes("Fecha;Año;Monto\n2026-01-01;ñandú;10\n\n2026-01-02;x;20\nTOTAL;;30\n".encode("latin-1"))
    loaded = tables.load_table(spark, str(path))
    rows = loaded.frame.orderBy(tables.ROW).collect()
    assert [(r["Fecha"], r["Año"], r[tables.ROW]) for r in rows] == [("2026-01-01", "ñandú", 2), ("2026-01-02", "x", 4)]
    assert loaded.report["encoding"] == "ISO-8859-1" and loaded.report["total_rows"] == 1 and loaded.report["warnings"]
    assert tables.load_table(spark, str(path), columns=["Monto"]).frame.columns == ["Monto", tables.ROW]


def test_lines_are_numbered_across_partitions(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a,b\n" + "".join(f"{i},{'x' * 50}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = tables.read_csv(spark, str(path))
        assert df.rdd.getNumPartitions() > 3 and df.where(F.col("a").cast("long") + 2 != F.col(tables.ROW)).count() == 0 and df.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_that_span_lines_keep_their_first_line(spark, tmp_path):
    path = tmp_path / "spans.csv"
    path.write_text('a,b\n1,"two\nlines"\n2,x\n3,"a\nb\nc"\n4,y\n')
    assert [(r["a"], r[tables.ROW]) for r in tables.read_csv(spark, str(path)).orderBy(tables.ROW).collect()] == [("1", 2), ("2", 4), ("3", 5), ("4", 8)]


def test_sparse_titles_are_no_headers():
    assert tables.header_row([["Informe de ventas", "2026", "", "", ""], ["Fecha", "Cliente", "Monto", "Estado", "ID"], ["2026-01-01", "Ana", "100", "x", "7"]]) == 1
    assert tables.header_row([["OT", "OT", "Costos", "Costos"], ["Numero", "Fecha", "Monto", "Moneda"], ["1", "2026-01-01", "5", "CLP"]]) == 1
    assert tables.header_row([["x", ""], ["", ""]]) == 0


def test_audited_export(spark, tmp_path):
    from tabularium.operators import cleaning

    rows = [(2, "01/02/2025", "1.500"), (3, "31/02/2025", "por definir"), (4, "03/02/2025", "2.500"), (5, "03/02/2025", "2.500")]
    rules = cleaning.Rules(drop_duplicates=True)
    done = cleaning.clean(spark.createDataFrame(rows, "_src_row int, Fecha string, Monto string"), rules)
    said = {r["key"]: r["value"] for r in sinks.write_audited(done, rules, str(tmp_path / "salida"), "ventas.csv").collect()}
    assert said["filas"] == "3" and said["fuente"] == "ventas.csv" and '"drop_duplicates": true' in said["reglas"] and int(said["cambios"]) >= 4
    data = spark.read.options(header=True, sep=";").csv(str(tmp_path / "salida" / "datos")).orderBy("_src_row").collect()
    assert [(r["Fecha"], r["Monto"]) for r in data] == [("2025-02-01", "1500"), ("31/02/2025", "por definir"), ("2025-02-03", "2500")]
    seen = spark.read.options(header=True, sep=";").csv(str(tmp_path / "salida" / "observaciones"))
    assert {(r["row"], r["rule"]) for r in seen.collect()} == {("3", "validacion_tipo"), ("5", "duplicado_exacto_original")}


def test_a_sheet_too_long_is_refused_before_writing(spark, tmp_path):
    path = tmp_path / "long.xlsx"
    with pytest.raises(ValueError):
        sinks.write_workbook({"Datos": spark.range(sinks.SHEET_ROWS + 1)}, str(path))
    assert not path.exists()


ODD_CELLS = [(3, "a & <b> \x01 _x0041_ é\r\n\ttail ", 1.5, dt.date(2025, 1, 2), True, 12345678901234567), (2, "=1+1", None, None, None, None), (4, None, float("nan"), dt.date(1800, 1, 1), False, 7), (5, "", -0.25, dt.date(9999, 12, 31), True, -1)]


@pytest.fixture
def odd_book(spark, tmp_path):
    df = spark.createDataFrame(ODD_CELLS, "_src_row int, `Nota.` string, v double, d date, ok boolean, n long")
    marks = spark.createDataFrame([("3", "Nota.", books.CHANGED), ("4", "v", books.REVIEW), ("4", "v", books.CHANGED), ("4", "*", 1)], "r string, c string, m int")
    path = str(tmp_path / "libro.xlsx")
    books.write_book({"Datos": books.Sheet(df.repartition(3), "_src_row", marks), "Vacía": df.limit(0), "Muchos & más": spark.range(0, 30_000, 1, 5)}, path)
    return path


def test_book_written_in_tasks_comes_back(spark, odd_book, tmp_path):
    with zipfile.ZipFile(odd_book) as book:
        assert book.testzip() is None and len(book.namelist()) == 8
        sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert 's="6" t="inlineStr"><is><t xml:space="preserve">a &amp; &lt;b&gt; _x0001_ _x005F_x0041_ é_x000D_' in sheet and 's="12" t="inlineStr"' in sheet
    assert [p.name for p in tmp_path.iterdir()] == ["libro.xlsx"]
    found = tables.read_workbook(spark, odd_book)
    assert list(found) == ["Datos", "Vacía", "Muchos & más"] and found["Vacía"].count() == 0
    rows = [tuple(r) for r in found["Datos"].orderBy(tables.ROW).collect()]
    assert rows == [
        ("2", "=1+1", None, None, None, None, 2, "Datos"), ("3", "a & <b> \x01 _x0041_ é\r\n\ttail ", "1.5", "2025-01-02", "TRUE", "12345678901234567", 3, "Datos"),
        ("4", None, "NaN", "1800-01-01", "FALSE", "7", 4, "Datos"), ("5", None, "-0.25", "9999-12-31", "TRUE", "-1", 5, "Datos"),
    ]
    many = found["Muchos & más"]
    assert many.count() == 30_000 and many.where(F.col("id").cast("long") + 2 != F.col(tables.ROW)).count() == 0


@pytest.mark.parametrize("size", [50_000, 333_333])
def test_a_sheet_is_read_by_several_tasks(spark, odd_book, size):
    many = tables.read_workbook(spark, odd_book, ["Muchos & más"], range_bytes=size)["Muchos & más"]
    assert many.rdd.getNumPartitions() > 3 and many.count() == 30_000 == many.select(tables.ROW).distinct().count()
    one = tables.read_workbook(spark, odd_book, ["Muchos & más"], equal={"id": "777"}, range_bytes=size)["Muchos & más"]
    assert [tuple(r) for r in one.collect()] == [("777", 779, "Muchos & más")] and many.count() == 30_000
    few = tables.read_workbook(spark, odd_book, ["Datos"], columns=["v", "d"], equal={"Nota.": "=1+1"})["Datos"]
    assert [tuple(r) for r in few.collect()] == [(None, None, 2, "Datos")]
    assert tables.read_workbook(spark, odd_book, ["Datos"], equal={"nobody": "x"})["Datos"].count() == 0


def test_headers_and_shape_without_reading_the_rows(odd_book):
    assert tables.workbook_headers(odd_book)["Muchos & más"] == ["id"]
    shape = tables.sheet_shape(odd_book, "Datos")
    assert (shape.headers, shape.row, shape.dimension) == (["_src_row", "Nota.", "v", "d", "ok", "n"], 1, "A1:F5")


def test_shared_strings_dates_and_merged_cells(spark, tmp_path):
    """A book of another writer: shared and rich strings, a date format, rows and cells without numbers, a merged title."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = books._parts([{"name": "Hoja", "columns": [], "rows": 0}])
    parts["xl/sharedStrings.xml"] = f"<sst {main}><si><t>Ventas enero</t></si><si><r><t>Fe</t></r><r><t>cha</t></r></si><si><t>Monto</t></si></sst>"
    parts["xl/styles.xml"] = f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="22"/></cellXfs></styleSheet>'
    parts["xl/worksheets/sheet1.xml"] = (
        f'<worksheet {main}><sheetData><row><c t="s"><v>0</v></c></row><row><c t="s"><v>1</v></c><c t="s"><v>2</v></c></row><row><c s="1"><v>45658</v></c><c><v>10</v></c></row>'
        '<row><c s="2"><v>45659.5</v></c><c><f>SUM(A1)</f><v>11</v></c></row></sheetData><mergeCells count="1"><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    )
    path = str(tmp_path / "otro.xlsx")
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    rows = [tuple(r) for r in tables.read_workbook(spark, path)["Hoja"].orderBy(tables.ROW).collect()]
    assert rows == [("2025-01-01", "10", 3, "Hoja"), ("2025-01-02 12:00:00", "11", 4, "Hoja")]
    assert tables.sheet_shape(path, "Hoja").merged == ["A1:B1"] and tables.formulas(spark, path).first()["formulas"] == 1


def test_long_sheets_go_on_and_long_cells_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(books, "SHEET_ROWS", 101)
    path = str(tmp_path / "largo.xlsx")
    with pytest.raises(ValueError):
        books.write_book({"Datos": spark.range(250)}, path)
    books.write_book({"Datos": spark.range(0, 250, 1, 3), "datos (2)": spark.range(1)}, path, split=True)
    found = tables.read_workbook(spark, path)
    assert list(found) == ["Datos", "Datos (2)", "Datos (3)", "datos (2)_"]
    assert sorted(int(r["id"]) for n in list(found)[:3] for r in found[n].collect()) == list(range(250))
    with pytest.raises(Exception, match="more than"):
        books.write_book({"Datos": spark.createDataFrame([("x" * 40_000,)], "t string")}, str(tmp_path / "no.xlsx"))
    assert not (tmp_path / "no.xlsx").exists()


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_checksums_join(a, b):
    assert books.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_audited_book(spark, tmp_path):
    from tabularium.operators import cleaning

    rules, path = cleaning.Rules(drop_duplicates=True), str(tmp_path / "auditado.xlsx")
    sales = [(2, "01/02/2025", "1.500", "Ana"), (3, "31/02/2025", "por definir", "ANA"), (4, "03/02/2025", "2.500,50", "Ana"), (5, "03/02/2025", "2.500,50", "Ana")]
    stock = [(2, "A-1", "7"), (3, "A-2", "-")]
    sheets = {
        "Ventas": spark.createDataFrame(sales, "_src_row int, `Fecha emis.` string, Monto string, Cliente string"),
        "Stock": spark.createDataFrame(stock, "_src_row int, `Cod. Producto` string, Cantidad string"),
    }
    done = {name: cleaning.clean(df, rules) for name, df in sheets.items()}
    said = {(r["sheet"], r["key"]): r["value"] for r in sinks.write_audited_book(done, rules, path, "libro.xlsx").collect()}
    found = tables.read_workbook(spark, path)
    assert list(found) == ["Ventas", "Stock", "Observaciones", "Auditoria", "Manifiesto"]
    for name, x in done.items():
        own = [c for c in x.frame.columns if c != "_src_row"]
        read = sorted(tuple(r) for r in found[name].select("_src_row_2", *[f"`{c}`" for c in own]).collect())
        assert read == sorted((str(r[0]), *(v if v is None or str(v).strip() else None for v in r[1:])) for r in x.frame.select("_src_row", *[f"`{c}`" for c in own]).collect())
        assert said[name, "filas"] == str(len(read)) and said[name, "sha_datos"] == sinks.content_hash(x.frame)
        assert found["Auditoria"].where(F.col("sheet") == name).count() == x.audit.count()
    assert found["Observaciones"].count() == sum(int(said[n, "observaciones"]) for n in done) and found["Manifiesto"].count() == len(said)
    with zipfile.ZipFile(path) as book:
        sheet = book.read("xl/worksheets/sheet1.xml").decode()
    changed, look = len(books.FORMATS) * books.CHANGED, len(books.FORMATS) * books.REVIEW
    assert f'<c r="B2" s="{changed + 3}"><v>45689</v></c>' in sheet and f'<c r="C3" s="{look}" t="inlineStr">' in sheet and f's="{changed + 2}"><v>2500.5' in sheet
