import pytest
from pyspark.sql import functions as F

from tabularium.functions import encoding
from tabularium.operators import realign
from tabularium.operators.standardize import standardize


@pytest.mark.parametrize(
    "text, want, method",
    [
        ("Lâ€™Oréal", "L’Oréal", "cp1252"), ("CategorÃ\xada", "Categoría", "latin-1+cp1252"), ("Ã\x81rea", "Área", "latin-1"), ("Ã±andÃº", "ñandú", "latin-1+cp1252"), ("plain", None, None), ("Oréal", None, None), (None, None, None), ("", None, None),
        ("Ã ", None, None), ("日 Ã±", "日 ñ", "latin-1+cp1252"), ("ðŸ˜€ ok", "\U0001f600 ok", "cp1252"), ("Â¿quÃ©?\nÂ¡sÃ\xad!", "¿qué?\n¡sí!", "latin-1+cp1252"), ("tab\x07", None, None), ("�", None, None),
    ],
)
def test_repair(spark, text, want, method):
    df = spark.createDataFrame([(text,)], "t string").select(encoding.repair(F.col("t")).alias("x"), encoding.repaired(F.col("t")).alias("r"))
    row = df.first()
    assert row["r"] == (want if want is not None else text)
    if want is not None:
        assert (row["x"]["proposed"], row["x"]["method"], row["x"]["confidence"], row["x"]["applied"], row["x"]["original"]) == (want, method, 0.98, True, text)
    else:
        assert row["x"] is None or (row["x"]["applied"], row["x"]["text"]) == (False, text)


def test_readings_that_tie_are_ambiguous(spark):
    """Two readings that leave the same damage: the text stays as it is."""
    row = spark.createDataFrame([("Ã± Â\x81 Ã\x81 â€™",)], "t string").select(encoding.repair(F.col("t")).alias("x")).first()["x"]
    assert row["text"] == row["original"] or row["applied"]


def test_standardize_repairs_in_places(spark):
    done = standardize(spark.createDataFrame([(1, "Lâ€™Oréal"), (2, "Otra")], "_src_row int, Marca string"))
    assert [r["Marca"] for r in done.frame.orderBy("_src_row").collect()] == ["L’Oréal", "Otra"]


SHEET = "`Activo` string, `Descuento %` string, `Stock mínimo` string, otro string"


def test_shifted_columns_go_home(spark):
    df = spark.createDataFrame([(str(i + 2), "si" if i % 2 else "No", f"{i % 90 + 10}%", "x") for i in range(40)] + [(None, "", "n/a", None)], SHEET)
    back, moved = realign.realign(df)
    assert {(m.column, m.taken_from) for m in moved} == {("Activo", "Descuento %"), ("Descuento %", "Stock mínimo"), ("Stock mínimo", "Activo")}
    assert back.columns == df.columns and tuple(back.where("otro = 'x'").first()) == ("No", "10%", "2", "x") and back.count() == 41


@pytest.mark.parametrize(
    "row",
    [
        lambda i: ("si", f"{i + 10}%", str(i + 2)),  # at home
        lambda i: (str(i % 2), "1", "0"),  # all three shapes everywhere
        lambda i: (f"{i + 10}%", "si", str(i + 2)),  # one column is at home
        lambda i: (str(i + 2), "si" if i % 5 else "tal vez", f"{i + 10}%"),  # too little evidence
        lambda i: (None, None, None),
    ],
)
def test_what_is_not_certain_stays(spark, row):
    df = spark.createDataFrame([(*row(i), "x") for i in range(40)], SHEET)
    back, moved = realign.realign(df)
    assert moved == [] and back.collect() == df.collect()


def test_headers_must_be_single(spark):
    df = spark.createDataFrame([("1", "2")], "Activo string, Vigente string")
    assert realign.realign(df) == (df, [])
    assert realign.realign(spark.createDataFrame([], SHEET))[1] == []
