"""Hand tables for text, numbers and dates."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabularium.functions import dates as D
from tabularium.functions import numbers as N
from tabularium.functions import text as T


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


NUMBERS = [
    ("$ 1.200.000", 1200000.0), ("CLP 850.000", 850000.0), ("US$1.500", 1500.0), ("1.200 USD", 1200.0), ("€200", 200.0), ("12%", 12.0), ("(1.500)", -1500.0),
    ("1.234.567,89", 1234567.89), ("1,234.56", 1234.56), ("1,234,567", 1234567.0), ("12,5", 12.5), ("1,234", 1.234), ("-3.5", -3.5), ("1e3", 1000.0), ("139 un", 139.0),
    ("caja 12", None), ("", None), ("N/A", None), (None, None), ("-", None), ("0", 0.0),
]


def test_numbers(spark):
    assert column(spark, [a for a, _ in NUMBERS], N.parse_number) == [b for _, b in NUMBERS]


def test_conventions_change_the_ambiguous(spark):
    assert column(spark, ["850.000", "1,234"], lambda c: N.parse_number(c, "decimal", "miles")) == [850.0, 1234.0]
    frame = spark.createDataFrame([("1,234",), ("5000",), ("7000",)], "v string")
    assert N.conventions(frame, "v").first()["comma3"] == "miles"
    assert N.conventions(spark.createDataFrame([("1.5",), ("2.25",)], "v string"), "v").first()["dot3"] == "decimal"
    assert N.conventions(spark.createDataFrame([], "v string"), "v").first().asDict() == {"dot3": "miles", "comma3": "decimal", "ambiguous": 0}


DATES = [
    ("2026-05-01", dt.date(2026, 5, 1)), ("01/05/2026", dt.date(2026, 5, 1)), ("05/22/2026", dt.date(2026, 5, 22)), ("1 de mayo de 2026", dt.date(2026, 5, 1)),
    ("3-ene-26", dt.date(2026, 1, 3)), ("12-Jan-2025", dt.date(2025, 1, 12)), ("2025-10", dt.date(2025, 10, 1)), ("08/2025", dt.date(2025, 8, 1)), ("31/02/2025", None),
    ("01.02.69", dt.date(2069, 2, 1)), ("01.02.70", dt.date(1970, 2, 1)), ("2026-05-01T10:00:00Z", dt.date(2026, 5, 1)), ("2026-05-01 00:00:00", dt.date(2026, 5, 1)),
    ("-", None), ("hola", None), (None, None), ("13/13/2020", None),
]


def test_dates(spark):
    assert column(spark, [a for a, _ in DATES], D.parse_date) == [b for _, b in DATES]
    assert column(spark, ["03/04/2025"], lambda c: D.parse_date(c, False)) == [dt.date(2025, 3, 4)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dates(dt.date(1970, 1, 1), dt.date(2069, 12, 31)), min_size=30, max_size=60))
def test_dates_round_trip(spark, days):
    for form in ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%y"):
        assert column(spark, [d.strftime(form) for d in days], D.parse_date) == days


def test_date_profile(spark):
    frame = spark.createDataFrame([("25/12/2024",), ("12/25/2024",), ("13/01/2024",), ("01/02/2024",), (None,)], "v string")
    assert D.date_profile(frame, "v").first().asDict() == {"dmy": 2, "mdy": 1, "ambiguous": 1, "dayfirst": True, "mixed": True}


def test_keys(spark):
    assert column(spark, ["VEN-0001", "ven-1", "0001", "2025/3", "n/a", None, " Ñuñoa "], T.relation_key) == ["ven-1", "ven-1", "0001", "2025-03", None, None, "nunoa"]
    assert column(spark, ["Santiago Limitada", "SANTIAGO LTDA"], T.company_key) == ["santiagoltda"] * 2
    assert column(spark, ["12.0", " 7 ", "A.0"], T.code) == ["12", "7", "A.0"]
    assert column(spark, ["=1+1", "-2", "hola", "@x"], T.safe_cell) == ["'=1+1", "'-2", "hola", "'@x"]


def test_placeholders(spark):
    assert column(spark, ["Sin Nombre", "xx", "", "none"], lambda c: T.is_placeholder(c, "cliente")) == [True, True, False, False]
    assert column(spark, ["none"], lambda c: T.is_placeholder(c, kind="numero")) == [True]


def test_mojibake(spark):
    assert column(spark, ["CategorÃ­a", "Categoría", "plain", None], T.mojibake_repaired) == ["Categoría", "Categoría", "plain", None]


@pytest.mark.parametrize("text,good", [("12.345.678-5", True), ("12345678-4", False), ("abc", False), ("", False)])
def test_rut(spark, text, good):
    assert column(spark, [text], T.rut_valid) == [good]


def test_projections_parse_like_expressions(spark):
    texts = [None, "", "-", "$ 1.234,50", "(1.234)", "US$1,234.5", "12 un", "-7", "1e3", "abc", "1,5", "1.234", "1,234", "5%", "1.2.3,4", "01/02/2025", "13/02/2025", "02/13/2025", "2025-03-04T10:00:00", "5 de mayo de 1998", "Ene-25", "2025/7", "7-2025", "3 xxx 99", "1/1/69", "1/1/70", "31/31/2025", "40/12/2025"]
    df = spark.createDataFrame([(t,) for t in texts], "`a.b` string")
    for dot3, comma3, dayfirst in (("miles", "decimal", True), ("decimal", "miles", False)):
        text = F.col("`a.b`")
        out = N.with_number(D.with_date(df, text, "d", dayfirst), text, "n", dot3, comma3)
        both = out.withColumns({"n2": N.parse_number(text, dot3, comma3), "d2": D.parse_date(text, dayfirst)})
        assert both.columns == ["a.b", "d", "n", "n2", "d2"] and both.where("NOT (n <=> n2) OR NOT (d <=> d2)").count() == 0
        assert both.where("n IS NOT NULL").count() >= 9 and both.where("d IS NOT NULL").count() >= 8
