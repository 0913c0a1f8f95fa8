"""A messy sheet from text to figures, and relations between sheets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabularium.operators import metrics as M
from tabularium.operators import standardize as S

HEAD = "Fecha string, Cliente string, `Monto Neto` string, Cantidad string, `Costo Unitario` string, Canal string, Estado string, _src_row long"


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [
        ("01/01/2026", "Pérez", "$ 1.200.000", "2", "400.000", "Web", "Pagada", 2),
        ("15-01-2026", "PEREZ", "350.000", "1", "", "web", "Pagada", 3),
        ("2026-02-03", "Ñuñez", "(50.000)", "1", "10.000", "Tienda", "Pagada", 4),
        ("28 de febrero de 2026", "Soto", "500.000", "5", "50.000", "Tienda", "Anulada", 5),
        ("05/03/2026", "Soto", "100.000", "1", "30.000", "Tienda", "Pagada", 6),
        (None, None, None, None, None, None, None, 7),
        ("Total", "", "2.100.000", "", "", "", "", 8),
    ]
    return spark.createDataFrame(rows, HEAD)


def test_standardize(sheet):
    done = S.standardize(sheet)
    assert {c: t.kind for c, t in done.types.items()} == {"Fecha": "fecha", "Cliente": "texto", "Monto Neto": "numero", "Cantidad": "numero", "Costo Unitario": "numero", "Canal": "texto", "Estado": "texto"}
    rows = done.frame.orderBy("_src_row").collect()
    assert [r["Monto Neto__num"] for r in rows] == [1200000, 350000, -50000, 500000, 100000, None, 2100000]
    assert rows[3]["Fecha__date"] == dt.date(2026, 2, 28) and rows[0]["Monto Neto"] == "$ 1.200.000"
    assert [r["Canal"] for r in rows][:2] == ["Web", "Web"] and [r["Cliente"] for r in rows][:2] == ["Pérez", "Pérez"]
    assert [(r["row"], r["column"]) for r in S.observations(done).collect()] == [(8, "Fecha")]
    assert {r["role"] for r in S.analytic_coverage(done).collect()} >= {"fecha", "monto", "costo"}


def test_compute(sheet):
    done = S.standardize(sheet)
    found = M.compute(done)
    total = found.totals.first()
    assert total["net"] == 1_600_000 and total["rows"] == 4 and total["cost"] == 840_000 and total["returns"] == 50_000
    months = {r["month"]: (r["net"], r["partial"]) for r in found.monthly.collect()}
    assert months == {"2026-01": (1_550_000, False), "2026-02": (-50_000, False), "2026-03": (100_000, True)}
    assert {r["group"]: r["net"] for r in found.groups["canal"].collect()} == {"Web": 1_550_000, "Tienda": 50_000}
    assert M.compute(done, since="2026-03").totals.first()["net"] == 100_000
    assert M.compute(done, filters={"canal": "WEB"}).totals.first()["net"] == 1_550_000
    assert M.compute(done, filters={"nada": "x"}).totals.first()["rows"] == 0


def test_mixed_currencies_block(spark):
    df = spark.createDataFrame([("US$ 10", "01/01/2026"), ("CLP 5.000", "02/01/2026")], "Monto string, Fecha string")
    found = M.compute(S.standardize(df))
    assert found.mixed_currency and found.totals is None


def test_empty(spark):
    done = S.standardize(spark.createDataFrame([], "Monto string, Fecha string"))
    assert M.compute(done).totals is None or M.compute(done).totals.first()["net"] == 0


def test_relations_and_dashboards(spark):
    sales = spark.createDataFrame([("V1", "SKU-1", 100.0), ("V2", "SKU-0001", 50.0), ("V3", "SKU-2", 30.0)], "`ID Venta` string, `SKU Producto` string, monto double")
    goods = spark.createDataFrame([("SKU-001", "Pan"), ("SKU-2", "Leche")], "`Codigo SKU` string, Nombre string")
    sheets = {"Ventas": sales, "Productos": goods}
    found = M.detect_relations(sheets)
    assert [(r.left, r.right, r.left_keys, r.right_keys, r.stats.safe) for r in found] == [("Ventas", "Productos", ["SKU Producto"], ["Codigo SKU"], True)]
    shown = M.dashboard(sheets, found[0], "monto", "Nombre")
    assert {r["group"]: r["net"] for r in shown["top"].collect()} == {"Pan": 150.0, "Leche": 30.0} and shown["quality"].first()["matched"] == 3


def test_scopes(spark):
    a = spark.createDataFrame([(1, "x")], "i int, k string")
    assert M.build({"a": a, "b": a}, M.Scope("append", ["a", "b"])).count() == 2
    joined = M.build({"a": a, "b": a, "c": a.select("k", F.lit("z").alias("name"))}, M.Scope("join", ["a"], M.Join(["k"], "c", ["k"])))
    assert joined.first()["name"] == "z"
    with pytest.raises(ValueError):
        M.Scope("join", ["a"])
    with pytest.raises(ValueError):
        M.Scope("other", ["a"])


def test_relations_try_every_pair_of_keys(spark):
    shared = [f"c{i}" for i in range(6)]
    sales = spark.createDataFrame([(*["x"] * 6, "k1"), (*["x"] * 6, "k2")], [*shared, "clave"])
    goods = spark.createDataFrame([(*["x"] * 6, "k1"), (*["x"] * 6, "k2")], [*shared, "clave"])
    found = M.detect_relations({"Ventas": sales, "Productos": goods})
    assert [(r.left_keys, r.right_keys, r.stats.safe) for r in found] == [(["clave"], ["clave"], True)]
