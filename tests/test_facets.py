from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from tabularium.operators import facets
from tabularium.operators.facets import Dimension, Reference

ROWS = [("p1", "Web", "1", 10), ("p1", "Tienda", "2", 5), ("p2", "web", "1", 7), ("p2", None, "9", 1), ("p3", "Wéb ", None, 2), (None, " ", "2", 4), ("p1", "Web", "1", 3)]


@pytest.fixture(scope="module")
def sales(spark):
    rows = spark.createDataFrame(ROWS, "`Cod. Producto` string, Canal string, suc string, net int")
    products = spark.createDataFrame([("p1", "Té"), ("p2", "Café"), ("p2", "Cafe"), ("p3", " ")], "sku string, `Nombre.` string")
    branches = spark.createDataFrame([("1", "Centro"), ("2", "Norte")], "id string, nombre string")
    return facets.named(rows, {"producto": Dimension("Cod. Producto", Reference(products, "sku", "Nombre.")), "canal": Dimension("Canal"), "sucursal": Dimension("suc", Reference(branches, "id", "nombre"), or_key=False)})


SHOWN = [("Té", "Web", "Centro", 10), ("Té", "Tienda", "Norte", 5), ("p2", "web", "Centro", 7), ("p2", None, None, 1), ("p3", "Wéb", None, 2), (None, None, "Norte", 4), ("Té", "Web", "Centro", 3)]


def test_named(sales):
    assert sorted(map(str, ((r["dim_producto"], r["dim_canal"], r["dim_sucursal"], r["net"]) for r in sales.collect()))) == sorted(map(str, SHOWN))


@pytest.mark.parametrize("producto, canal, sucursal", list(product(["", "TÉ", "nobody"], ["", "web"], ["", "centro"])))
def test_options_under_all_other_filters(sales, producto, canal, sucursal):
    filters, names = {"producto": producto, "canal": canal, "sucursal": sucursal}, ["producto", "canal", "sucursal"]
    bare = lambda x: (x or "").lower().replace("é", "e")
    rows, sums = Counter(), Counter()
    for r in SHOWN:
        ok = [not filters[n] or bare(r[i]) == bare(filters[n]) and r[i] is not None for i, n in enumerate(names)]
        for i, n in enumerate(names):
            if r[i] is not None and all(o for j, o in enumerate(ok) if j != i):
                rows[n, r[i], bool(filters[n]) and ok[i]] += 1
                sums[n, r[i], bool(filters[n]) and ok[i]] += r[3]
    found = {(r["dimension"], r["value"], r["selected"]): (r["rows"], r["net"]) for r in facets.options(sales, filters, F.col("net")).collect()}
    assert found == {k: (n, float(sums[k])) for k, n in rows.items()}
    met = sum(all(not filters[n] or bare(r[i]) == bare(filters[n]) for i, n in enumerate(names)) for r in SHOWN)
    assert facets.filtered(sales, filters).count() == met


def test_unknown_filters_name_the_valid_ones(sales):
    with pytest.raises(facets.UnknownFilter, match="producto, canal, sucursal"):
        facets.options(sales, {"color": "x"}, F.col("net"))
    for bad in (3, "x" * 201):
        with pytest.raises(facets.UnknownFilter):
            facets.checked({"canal": bad})
    assert facets.checked({"canal": "  ", "moneda": " CLP "}) == {"moneda": "CLP"} and facets.checked(None) == {}


def test_empty(sales):
    assert facets.options(sales.limit(0), {"canal": "web"}, F.col("net")).count() == 0
