"""Localised numbers as native expressions, with conventions voted by the whole column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.names import col
from tabularium.functions.text import let

# The marks that decorate amounts.
CURRENCY_MARKS = r"(?i)(us\$|s/\.?|clp|usd|eur|ars|pen|cop|mxn|uf|[$€£])"
UNIT_MARKS = r"(?i)\s*(?:un|ud|uds|unidad|unidades)\.?\s*$"
SCIENTIFIC = r"(?:\d+(?:\.\d*)?|\.\d+)[eE][+-]?\d+"
BARE = rf"^-?(?:[\d.,]+|{SCIENTIFIC})$"
CURRENCIES = {
    "USD": r"(?i)(us\$|usd)", "EUR": r"(?i)(€|eur)", "CLP": r"(?i)\bclp\b", "UF": r"(?i)\buf\b", "ARS": r"(?i)\bars\b",
    "PEN": r"(?i)(\bpen\b|s/\.?\s?\d)", "COP": r"(?i)\bcop\b", "MXN": r"(?i)\bmxn\b", "GBP": r"(?i)(£|gbp)",
}


def _trimmed(text: Column) -> Column:
    return F.trim(F.translate(text.cast("string"), " ", " "))


def _in_parentheses(value: Column) -> Column:
    return value.startswith("(") & value.endswith(")") & (F.length(value) > 2) & ~value.contains("\n")


def _bare(value: Column) -> Column:
    """A trimmed value without marks; bare numbers meet one pattern only."""
    inner = F.when(value.startswith("("), F.trim(F.regexp_replace(value, r"^\((.+)\)$", "$1"))).otherwise(value)
    without = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, CURRENCY_MARKS, ""), UNIT_MARKS, ""), r"[%\s]", "")
    return F.when(value.rlike(BARE), value).otherwise(without)


def undecorated(text: Column) -> tuple[Column, Column]:
    """(digits, signs and separators alone; whether parentheses make it negative)."""
    value = _trimmed(text)
    return let(value, _bare), _in_parentheses(value)


def looks_like_number(text: Column) -> Column:
    return F.coalesce(undecorated(text)[0].rlike(BARE), F.lit(False))


def _times(value: Column, mark: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(mark), F.lit("")))


def _written(body: Column, commas: Column, dots: Column, dot3: Column, comma3: Column) -> Column:
    """A number's digits with a decimal point alone, by its separators and the column's conventions."""
    no = lambda mark: F.replace(body, F.lit(mark), F.lit(""))
    three = lambda mark: (F.length(F.substring_index(body, mark, -1)) == 3) & (F.length(F.substring_index(body, mark, 1)) >= 1)
    last_is_comma = F.length(F.substring_index(body, ",", -1)) < F.length(F.substring_index(body, ".", -1))
    return (
        F.when(F.lower(body).contains("e"), body)
        .when((commas > 0) & (dots > 0), F.when(last_is_comma, F.translate(no("."), ",", ".")).otherwise(no(",")))
        .when(commas > 1, no(","))
        .when(commas == 1, F.when(three(",") & (comma3 == "miles"), no(",")).otherwise(F.translate(body, ",", ".")))
        .when(dots > 1, no("."))
        .when((dots == 1) & three(".") & (dot3 == "miles"), no("."))
        .otherwise(body)
    )


def _column(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def parse_number(text: Column, dot3: str | Column = "miles", comma3: str | Column = "decimal") -> Column:
    """A double, null where the text is no number.

    With both separators the last one is decimal; one repeated separator is of thousands; a single one before three
    digits follows the column's convention (miles or decimal). with_number does the same in projections of their own.
    """
    clean, in_parentheses = undecorated(text)

    def read(c: Column) -> Column:
        parts = F.struct(F.ltrim(c, F.lit("-")).alias("body"), _times(c, ",").alias("commas"), _times(c, ".").alias("dots"))
        digits = let(parts, lambda x: _written(x["body"], x["commas"], x["dots"], _column(dot3), _column(comma3)))
        return F.when(c.rlike(BARE), digits.try_cast("double") * F.when(in_parentheses | c.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0)))

    return let(clean, read)


def with_number(df: DataFrame, text: Column, to: str, dot3: str | Column = "miles", comma3: str | Column = "decimal") -> DataFrame:
    """df with parse_number(text) as ``to``: a projection for each step, all within generated code, each value computed once."""
    names = {x: f"_{to}_{x}" for x in ("value", "clean", "ok", "body", "commas", "dots")}
    value, clean, ok, body, commas, dots = (col(n) for n in names.values())
    out = df.withColumn(names["value"], _trimmed(text)).withColumn(names["clean"], _bare(value))
    out = out.withColumns({names["ok"]: clean.rlike(BARE), names["body"]: F.ltrim(clean, F.lit("-")), names["commas"]: _times(clean, ","), names["dots"]: _times(clean, ".")})
    sign = F.when(_in_parentheses(value) | clean.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    number = F.when(ok, _written(body, commas, dots, _column(dot3), _column(comma3)).try_cast("double") * sign)
    return out.withColumn(to, number).drop(*names.values())


def ballot(text: Column) -> Column:
    """What one value says about its column's conventions, as a struct of booleans."""

    def votes(body: Column) -> Column:
        commas, dots = _times(body, ","), _times(body, ".")
        decimals = lambda mark: F.length(F.substring_index(body, mark, -1)).isin(1, 2)
        last_is_comma = F.length(F.substring_index(body, ",", -1)) < F.length(F.substring_index(body, ".", -1))
        whole = F.when((commas == 0) & (dots == 0), body.try_cast("double"))
        said = {
            "dot_thousands": (commas > 0) | (dots > 1), "dot_decimal": (commas == 0) & (dots == 1) & decimals("."),
            "comma_decimal": (commas > 0) & (dots > 0) & last_is_comma | (commas == 1) & (dots == 0) & decimals(","),
            "comma_thousands": (commas > 0) & (dots > 0) & ~last_is_comma | (commas > 1) & (dots == 0), "large": whole >= 1000, "small": (whole > 0) & (whole < 1000),
            "ambiguous": (commas == 1) & (dots == 0) & (F.length(F.substring_index(body, ",", -1)) == 3) & F.length(F.substring_index(body, ",", 1)).between(1, 3),
        }
        return F.when(body.rlike(r"^[\d.,]+$"), F.struct(*[v.alias(k) for k, v in said.items()]))

    return let(F.ltrim(undecorated(text)[0], F.lit("-")), votes)


def counted(votes: Column) -> Column:
    """How many ballots say each thing: an aggregate over one column of ballots."""
    names = ("dot_thousands", "dot_decimal", "comma_decimal", "comma_thousands", "large", "small", "ambiguous")
    return F.struct(*[F.count(F.when(votes[n], 1)).alias(n) for n in names])


def decided(count: Column) -> Column:
    """dot3, comma3 and how many values are ambiguous, from counted ballots."""
    dot3 = F.when((count["dot_decimal"] > 0) & (count["dot_thousands"] == 0), "decimal").otherwise("miles")
    by_size = (count["ambiguous"] > 0) & (count["comma_decimal"] == 0) & (count["comma_thousands"] == 0) & (count["large"] > count["small"])
    comma3 = F.when((count["comma_thousands"] > 0) & (count["comma_decimal"] == 0) | by_size, "miles").otherwise("decimal")
    return F.struct(dot3.alias("dot3"), comma3.alias("comma3"), count["ambiguous"].alias("ambiguous"))


def conventions(df: DataFrame, column: str) -> DataFrame:
    """One row: dot3, comma3, and how many values are ambiguous; the whole column votes in one aggregate."""
    votes = df.select(ballot(col(column)).alias("b")).agg(counted(F.col("b")).alias("v"))
    return votes.select(decided(F.col("v")).alias("d")).select("d.*")


def parse_column(df: DataFrame, column: str, to: str) -> DataFrame:
    """df with ``to``, the column's numbers under its own conventions."""
    found = conventions(df, column).first()
    return with_number(df, col(column), to, found["dot3"], found["comma3"])


def format_number(number: Column) -> Column:
    """Whole numbers without decimals, others as shortest text."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))


def percent_change(now: Column, before: Column) -> Column:
    """(now - before) / |before| in percent; null without a base."""
    return F.when(before != 0, (now - before) / F.abs(before) * 100)


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def percentage(text: Column, value: Column) -> Column:
    """A rate as a fraction: texts with %, and values beyond 2, are divided by 100."""
    return F.when(text.contains("%") | (F.abs(value) > 2), F.round(value / 100, 12)).otherwise(value)


def hours(text: Column) -> Column:
    return parse_number(F.regexp_replace(text, r"(?i)\s*(hrs?|horas?|h)\.?\s*$", ""))


def currency_marks(text: Column) -> Column:
    """The currencies a text names; a bare $ is CLP where nothing else is named."""
    found = F.filter(F.array(*[F.when(text.rlike(p), F.lit(c)) for c, p in CURRENCIES.items()]), lambda c: c.isNotNull())
    return F.when((F.size(found) == 0) & text.contains("$"), F.array(F.lit("CLP"))).otherwise(found)
