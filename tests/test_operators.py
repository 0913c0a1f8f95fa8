"""Hand-made scenarios for operators beyond the star schema's queries."""

import pytest
from pyspark.sql import functions as F

from tabularium.operators import aggregates as A
from tabularium.operators import business as B
from tabularium.operators import consolidate as C
from tabularium.operators import joins as J
from tabularium.operators import labels as L
from tabularium.operators import quality as Q
from tabularium.operators import reshape as R
from tabularium.operators import services as S


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_hand_computed_metrics(spark):
    """Twelve rows: partial costs, an amount that is none, a blank category, a reversal and a zero."""
    data = [("A", 100.0, 60.0), ("A", 50.0, None), (" ", 20.0, 10.0), ("B", -30.0, None), ("B", 0.0, 0.0), (None, None, 5.0)]
    found = {r["group"]: r for r in A.group_profit(spark.createDataFrame(data, "g string, a double, c double"), F.col("g"), F.col("a"), F.col("c")).collect()}
    assert found["A"]["net"] == 150 and found["A"]["profit"] == 40 and found["A"]["margin_pct"] == 40 and found["A"]["coverage_pct"] == 50
    assert found["B"]["returns"] == 30 and found["B"]["gross"] == 0 and found["B"]["margin_pct"] is None
    assert found[A.UNCLASSIFIED]["rows"] == 1 and abs(sum(r["gross_share_pct"] for r in found.values()) - 100) < 1e-9


def test_safe_join_refuses_repeated_keys(spark):
    sales = spark.createDataFrame([("1", 10.0), ("2", 20.0), ("3", 5.0)], "sku string, amount double")
    goods = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "code string, name string")
    assert rows(J.safe_left_join(sales, goods, ["sku"], ["code"]).select("sku", "name"), "sku") == [("1", "x"), ("2", "y"), ("3", "z")]
    with pytest.raises(J.UnsafeJoin):
        J.safe_left_join(sales, goods.union(goods), ["sku"], ["code"])
    with pytest.raises(J.UnsafeJoin):
        J.safe_left_join(sales, goods.where("code = '1'").withColumn("code", F.lit("9")), ["sku"], ["code"])
    assert J.stats_of(sales.limit(0), ["sku"], goods, ["code"]).coverage is None


def test_asof_across_periods_conflicts_and_nulls(spark):
    history = spark.createDataFrame([("a", "2026-01-05", 1.0), ("a", "2026-03-10", 3.0), ("a", "2026-03-20", 9.0), ("a", "2026-03-20", 8.0), ("b", "2026-02-01", 7.0), ("b", "2026-02-01", 7.0)], "k string, d string, v double")
    facts = spark.createDataFrame([(1, "a", "2026-01-04"), (2, "a", "2026-01-05"), (3, "a", "2026-02-28"), (4, "a", "2026-03-31"), (5, "b", "2026-09-01"), (6, "c", "2026-01-01"), (7, "a", None), (8, None, "2026-02-02")], "i int, k string, d string")
    day = lambda df: df.withColumn("d", F.to_date("d"))
    found = dict(rows(J.asof_join(day(facts), day(history), "k", "d", "d", "v", "cost").select("i", "cost")))
    assert found == {1: None, 2: 1.0, 3: 1.0, 4: 3.0, 5: 7.0, 6: None, 7: None, 8: None}


def test_interval_join_refuses_overlaps(spark):
    worked = spark.createDataFrame([("t", "2026-01-31"), ("t", "2026-02-01"), ("t", "2027-01-01")], "k string, d string").withColumn("d", F.to_date("d"))
    rates = spark.createDataFrame([("t", "2026-01-15", "2026-01-31", 5), ("t", "2026-02-01", "2026-12-31", 6)], "ik2 string, a2 string, b2 string, rate int").withColumns({"a2": F.to_date("a2"), "b2": F.to_date("b2")})
    assert sorted(r["rate"] for r in J.interval_join(worked, rates, "k", "d", "ik2", "a2", "b2", ["rate"]).collect()) == [5, 6]
    with pytest.raises(J.UnsafeJoin):
        J.interval_join(worked, rates.union(rates), "k", "d", "ik2", "a2", "b2", ["rate"])


def test_append_checks_shapes(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, t string"), spark.createDataFrame([(2, 3.0)], "i int, t double")
    with pytest.raises(R.IncompatibleSheets):
        R.append({"a": a, "b": b})
    assert R.append({"a": a, "c": a}).count() == 2
    with pytest.raises(R.IncompatibleSheets):
        R.append_cohort(a, a, "t", "x")


def test_snapshots_totals_and_duplicates(spark):
    stock = spark.createDataFrame([("p", "2026-01-01", 5), ("p", "2026-02-01", 7), ("q", "2026-01-15", 1)], "k string, d string, n int")
    assert rows(R.latest_snapshot(stock, ["k"], "d"), "k") == [("p", "2026-02-01", 7), ("q", "2026-01-15", 1)]
    sheet = spark.createDataFrame([(1, "x", "10"), (2, "Total", "10")], "r int, a string, b string")
    assert [r["a"] for r in R.summary_rows(sheet, "r").collect()] == ["x"]
    twice = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "r int, t string")
    assert rows(Q.without_duplicates(twice, "r").select("r"), "r") == [(1,), (3,), (5,)]
    assert Q.duplicate_groups(twice, ["t"], "r").where("contiguous").count() == 2


def test_labels(spark):
    names = spark.createDataFrame([("Ñuñoa",), ("NUNOA",), ("nunoa",), ("nunoa",), ("Talca",), ("Talcca",), ("Talca",), ("Talca",)], "t string")
    found = {r["key"]: r["canonical"] for r in L.canonical_labels(names, F.col("t")).collect()}
    assert found == {"nunoa": "Ñuñoa", "talca": "Talca", "talcca": "Talcca"}
    assert {r["key"]: r["canonical"] for r in L.canonical_labels(names, F.col("t"), "count").collect()}["nunoa"] == "nunoa"
    assert rows(L.similar_labels(names, F.col("t")).select("rare", "frequent", "distance")) == [("talcca", "talca", 1)]


def test_indicators(spark):
    one = spark.range(1)
    made = B.indicators(one, [B.indicator("a", "x", F.lit(110.0), "CLP", F.lit(100.0)), B.indicator("b", "x", F.lit(5.0), "%", F.lit(3.0), points=True, coverage=F.lit(50.0)), B.indicator("c", "x", F.lit(1.0), "CLP", blocked=F.lit(True))])
    assert [(r["id"], r["value"], r["change"], r["status"]) for r in made.collect()] == [("a", 110.0, 10.0, "available"), ("b", 5.0, 2.0, "partial"), ("c", None, None, "blocked")]


def test_services(spark):
    lines = spark.createDataFrame([(1, "OT-1", "a"), (2, None, "b"), (3, "Subtotal", None), (4, "OT-22", "c"), (5, None, None)], "r int, ot string, id string")
    assert rows(S.clean_lines(lines, "ot", "id", "r").select("r", "ot"), "r") == [(1, "OT-00001"), (2, "OT-00001"), (4, "OT-00022")]
    units = spark.createDataFrame([("2025-01", 38000.5)], "p string, v double")
    fees = spark.createDataFrame([("2025-01", "UF", 2.0), ("2025-01", "CLP", 500.0), ("2025-02", "UF", 1.0)], "period string, m string, a double")
    assert sorted(map(str, (r["clp"] for r in S.in_pesos(fees, "a", "m", "period", units, "p", "v", "clp").collect()))) == ["500.0", "76001.0", "None"]
    with pytest.raises(J.UnsafeJoin):
        S.in_pesos(fees, "a", "m", "period", units.union(units), "p", "v", "clp")


def test_consolidation_keeps_rows_and_names(spark):
    primary = spark.createDataFrame([("1", "x"), ("2", "y"), ("", "z")], "id string, name string")
    extra = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c"), ("", "d")], "id string, name string")
    done = C.consolidate(primary, [C.Supplement("Archivo B", extra, {"id": "id"})], [])
    assert rows(done.frame, "id") == [("", "z", None), ("1", "x", "a"), ("2", "y", None)] and done.frame.columns == ["id", "name", "archivo-b_name"]
    assert done.status == "VALID_WITH_WARNINGS" and C.slug("Año Nuevo!") == "ano-nuevo"
    with pytest.raises(ValueError):
        C.cohort_ids(primary, "id", "2026")
    assert rows(C.keys_seen_once(extra, "id", primary, "id").select("name"), "name") == [("a",), ("d",)]


def test_currency(spark):
    texts = spark.createDataFrame([("US$ 10", "CLP 5"), ("$ 3", None)], "a string, b string")
    assert A.mixed_currency(texts, "a", "b") and not A.mixed_currency(texts.where("a = '$ 3'"), "a")


def test_misspellings_go_to_frequent_keys(spark):
    said = ["Concepcion"] * 9 + ["Concepcoin"] * 3 + ["Conceptions"] * 5 + ["Gasto"] * 3 + ["Pasto"] * 1 + ["Gato"] + ["Gsato"] + ["1234"] * 5 + ["1235"] + ["ab"] * 4 + ["ac"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "r int, t string")
    found = {(r["rare"], r["frequent"], r["distance"]) for r in L.similar_labels(df, F.col("t"), "r").collect()}
    assert found == {("concepcoin", "concepcion", 2), ("gato", "gasto", 1)}
    merged = L.merge_labels(df, "t", "r").groupBy("t").count().collect()
    assert {(r["t"], r["count"]) for r in merged} == {("Concepcion", 12), ("Conceptions", 5), ("Gasto", 4), ("Pasto", 1), ("Gsato", 1), ("1234", 5), ("1235", 1), ("ab", 4), ("ac", 1)}


def test_misspellings_equal_all_pairs(spark):
    import random

    rng = random.Random(5)
    words = []
    for base in ("providencia", "vitacura", "talca", "temuco", "antofagasta", "lota"):
        words += [base] * rng.randint(3, 9)
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
            words.append("".join(w))
    counts = {w: words.count(w) for w in words if len(w) >= 4}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    expected = {}
    for a, n in counts.items():
        near = [(-m, b) for b, m in counts.items() if b != a and b[0] == a[0] and m >= 3 and n <= max(2, m // 2) and edits(a, b) <= (1 if len(a) <= 6 else 2)]
        if near:
            expected[a] = min(near)[1]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert {r["rare"]: r["frequent"] for r in L.similar_labels(df, F.col("t")).collect()} == expected and expected


def test_projection_starts_after_the_partial_month(spark):
    full = [("2025-01", 100.0, False), ("2025-02", 110.0, False), ("2025-03", 121.0, False)]
    months = lambda rows: spark.createDataFrame(rows, "month string, net double, partial boolean")
    out = rows(A.projection(months([*full, ("2025-04", 5.0, True)])), "month")
    assert [(r[0], r[1]) for r in out] == [("2025-05", 146.41), ("2025-06", 161.05), ("2025-07", 177.16)]
    assert out[0][2] == 10.0 and abs(out[0][3] - (146.41 + 161.05 + 177.16 - 331) / 331 * 100) < 1e-9
    assert [r[0] for r in rows(A.projection(months(full)), "month")] == ["2025-04", "2025-05", "2025-06"]
    assert rows(A.projection(months(full[:1]))) == [] == rows(A.projection(months([("2025-01", 0.0, False), *full[1:]])))


def test_histogram_has_empty_bins_and_ends_at_the_maximum(spark):
    df = spark.createDataFrame([(float(x),) for x in [0] * 10 + [1] * 8 + [2, 100]], "x double")
    out = rows(A.histogram(df, F.col("x")), "bin")
    assert len(out) == 6 and [r[3] for r in out] == [19, 0, 0, 0, 0, 1] and out[0][1] == 0 and out[-1][2] == 100
    assert rows(A.histogram(df.where("x < 2"), F.col("x"))) == []


def test_rate_buckets_have_the_surveyed_ends(spark):
    df = spark.createDataFrame([(x, 1.0) for x in (None, 0.0, 0.05, 0.06, 0.3, 0.5, 0.51, 1.0, 1.01, -0.1)], "r double, a double")
    assert {r["bucket"]: r["rows"] for r in A.rate_buckets(df, F.col("r"), F.col("a")).collect()} == {
        "Sin dato": 1, "Sin descuento": 1, "1–5%": 1, "6–10%": 1, "21–50%": 2, "51–100%": 2, "Fuera de rango": 2,
    }


@pytest.mark.parametrize("most", [5, 1000])
def test_exact_quantiles_in_bounded_memory(spark, most):
    values = [float((i * 7919) % 1009) for i in range(900)] + [500.0] * 700
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    import numpy as np

    n, found = A.exact_quantiles(df, F.col("x"), [0.0, 0.25, 0.5, 0.75, 0.99, 1.0], most)
    assert n == len(values) and found == pytest.approx(np.quantile(values, [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]).tolist())
    assert A.exact_quantiles(df.where("x < 0"), F.col("x"), [0.5]) == (0, None)


def test_overtime_counts_half_as_much_again(spark):
    worked = spark.createDataFrame([("t", "2025-03-01", 2.0, "Normal", True), ("t", "2025-03-02", 2.0, "Hora EXTRA", True), ("t", "2025-03-03", 2.0, None, False), ("t", "2026-03-03", 2.0, None, True)], "t string, d string, h double, k string, b boolean")
    worked = worked.withColumn("d", F.to_date("d"))
    tariffs = spark.sql("SELECT 't' AS p, DATE '2025-01-01' AS a, DATE '2025-12-31' AS z, 10.0D AS cost, 25.0D AS price")
    out = rows(S.labour_cost(worked, "t", "d", "h", tariffs, "p", "a", "z", "cost", "price", "k", "b").select("d", "labour_cost", "labour_value"), "d")
    assert [r[1:] for r in out] == [(20.0, 50.0), (30.0, 75.0), (20.0, 0.0)]
    said = spark.createDataFrame([("8 hrs", "X"), ("1", "1"), ("2", "V"), ("3", "true"), ("4", "yes"), ("5", None)], "h string, b string")
    assert [r["b"] for r in S.clean_hours(said, "h", "b").collect()] == [True, True, True, True, False, False]


def test_sheets_with_other_headers_are_appended(spark):
    a = spark.createDataFrame([("1", "x", 5.0)], "`Cod Producto` string, FECHA string, `Monto Neto` double")
    b = spark.createDataFrame([("2", "y", 6.0)], "Id_Producto string, Fecha string, MONTO_NETO double")
    out = R.append({"a": a, "b": b})
    assert out.columns == ["Cod Producto", "FECHA", "Monto Neto", "origin"] and out.agg(F.sum("Monto Neto")).first()[0] == 11
    two = spark.createDataFrame([(1.0, 2.0)], "`Monto Neto` double, Monto_Neto double")
    assert R.aligned({"a": a, "b": two})["b"].columns == ["Monto Neto", "Monto_Neto"]


def test_contracts_of_cohorts(spark):
    assert C.target_columns([" id ", "cohorte"], ("id",)) == ["id", "cohorte"]
    for bad in (["id", "id"], ["id", ""], ["x"]):
        with pytest.raises(ValueError):
            C.target_columns(bad, ("id",))
    df = spark.createDataFrame([("a", "2026", "5,1"), ("a", "2026", "7"), ("b", "2025", None)], "id string, cohorte string, n string")
    out = C.shaped(df, ["id", "cohorte", "n", "other"], {"cohorte", "n"})
    assert [tuple(r) for r in out.collect()] == [("a", 2026.0, None, None), ("a", 2026.0, 7.0, None), ("b", 2025.0, None, None)]
    assert {tuple(r) for r in C.contract_issues(out, 4, ["id"], "id", "cohorte", 2026).collect()} == {("row_count_changed", 1), ("target_schema_mismatch", 1), ("duplicate_key", 1), ("invalid_cohort", 1)}
    assert C.contract_issues(out.where("n = 7"), 1, out.columns, "id", "cohorte", 2026).count() == 0
    a, b = {"role": "a", "dataset_id": 1}, {"role": "b", "dataset_id": 2}
    assert C.idempotency_key("p", "c", [a, b]) == C.idempotency_key("p", "c", [b, a]) != C.idempotency_key("p", "d", [a, b])


def test_code_books_and_sources(spark):
    book = spark.createDataFrame([(2, "VIA", "1. Regular"), (3, None, "2) Especial"), (4, None, "2 - Otra"), (5, "SEXO", "1. Mujer"), (6, "", "nota")], "r int, v string, d string")
    assert {tuple(r) for r in C.inline_codebook(book, "via", "v", "d", "r").collect()} == {("1", "Regular", False), ("2", None, True)}
    roles = {"base": ({"ID_aux", "Via"}, {"ptje"}), "notas": ({"ID_aux"}, {"promedio"})}
    assert C.detect_source(["id aux", "VIA", "Ptje"], roles) == "base" and C.detect_source(["ID_AUX"], roles) == "notas" and C.detect_source(["x"], roles) is None
    assert C.missing_columns(["RUN"], {"ID_aux", "via"}, {"run": "id_aux"}) == ["via"]
    codes = spark.createDataFrame([(str(i), f"n{i % 3}") for i in range(10)], "codigo string, nombre string")
    assert C.looks_like_codes(codes) and not C.looks_like_codes(codes.toDF("a", "b"))
    assert C.common_keys(["Fecha", "Cod Sede", "RUT"], ["rut", "fecha", "COD_SEDE"]) == [("Cod Sede", "COD_SEDE"), ("RUT", "rut"), ("Fecha", "fecha")]


def test_insights_by_hand(spark):
    total = spark.createDataFrame([(900.0, 100.0, 5.0)], "net double, returns double, margin_pct double")
    groups = lambda rows: spark.createDataFrame(rows, "`group` string, margin_pct double, gross_share_pct double")
    months = spark.createDataFrame([("2025-01", 100.0, False), ("2025-02", 100.0, False), ("2025-03", 80.0, False), ("2025-04", 5.0, True)], "month string, net double, partial boolean")
    categories = groups([("a", -3.0, 50.0), ("b", 4.0, 30.0), ("c", 40.0, 10.0), ("d", 6.0, 10.0), ("e", None, 5.0)])
    out = {r["id"]: (r["tone"], r["subject"], r["value"]) for r in B.insights(total, categories, groups([("p", 1.0, 25.0), ("q", 1.0, 24.0)]), groups([("k", 1.0, 90.0)]), months, A.projection(months)).collect()}
    assert out == {
        "margen-ajustado": ("atencion", None, 5.0), "devoluciones-altas": ("riesgo", None, 10.0), "categoria-perdida": ("riesgo", "a", -3.0), "volumen-sin-margen": ("oportunidad", "b", 30.0),
        "concentracion-producto": ("atencion", "p", 25.0), "cambio-mes": ("riesgo", "2025-03", -20.0), "tendencia-baja": ("riesgo", None, -10.0),
    }


def test_split_columns_and_moments(spark):
    df = spark.createDataFrame([("Ana SA | Talca", "9:05"), ("Beto", "24:00"), (None, None), ("a|b|c", " 23:59 ")], "t string, h string").withColumn("d", F.to_date(F.lit("2025-03-01")))
    out = R.split_column(df, "t", "|", "who", "where").withColumn("m", R.moment(F.col("d"), F.col("h"))).collect()
    assert [(r["who"], r["where"]) for r in out] == [("Ana SA", "Talca"), ("Beto", ""), (None, None), ("a", "b|c")]
    assert [r["m"] and r["m"].strftime("%H:%M") for r in out] == ["09:05", None, None, "23:59"]
