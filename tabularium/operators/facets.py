"""Filters of a business's sales: named dimensions, checked filters, and each dimension's options under all other filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.names import col, fresh
from tabularium.functions.text import plain
from tabularium.operators.joins import unique_reference

# The dimensions that sales are filtered by, and how long a filter's value may be.
DIMENSIONS = ("producto", "categoria", "canal", "sucursal", "vendedor", "moneda")
LONGEST = 200


class UnknownFilter(ValueError):
    """A filter that no dimension has, or a value that is no text."""


@dataclass(frozen=True)
class Reference:
    """A table that names keys: the key's column in it, and the column of what is shown."""

    frame: DataFrame
    key: str
    shown: str


@dataclass(frozen=True)
class Dimension:
    """A column of sales; with a reference its keys are shown by name, or as they are where ``or_key`` and it has none."""

    column: str
    reference: Reference | None = None
    or_key: bool = True


def named(sales: DataFrame, dimensions: dict[str, Dimension]) -> DataFrame:
    """sales with a text column ``dim_<name>`` for each dimension.

    A key with several names in its reference has none: it is shown as it is, or not at all without or_key. References
    are one row a key before they meet sales, so no sale is repeated; blanks are null.
    """
    out, made = sales, {}
    for name, d in dimensions.items():
        own = F.trim(col(d.column).cast("string"))
        if d.reference is not None:
            key, shown = fresh([*out.columns, *(f"dim_{n}" for n in dimensions)], f"_{name}_key", f"_{name}_shown")
            known = unique_reference(d.reference.frame, d.reference.key, [d.reference.shown])
            known = known.select(col(d.reference.key).cast("string").alias(key), F.trim(col(d.reference.shown).cast("string")).alias(shown))
            out = out.join(known, col(d.column).cast("string") == col(key), "left")
            own = F.coalesce(F.nullif(col(shown), F.lit("")), own) if d.or_key else col(shown)
        made[f"dim_{name}"] = F.nullif(own, F.lit(""))
    return out.select(*[col(c) for c in sales.columns], *[c.alias(n) for n, c in made.items()])


def checked(filters: dict[str, object] | None, known: tuple[str, ...] = DIMENSIONS) -> dict[str, str]:
    """The filters that say something; UnknownFilter names the valid ones if a key or a value is none."""
    out = {}
    for name, value in (filters or {}).items():
        if name not in known:
            raise UnknownFilter(f"unknown filter {name!r}; valid ones are {', '.join(known)}")
        if not isinstance(value, str) or len(value.strip()) > LONGEST:
            raise UnknownFilter(f"the value of {name!r} must be a text of at most {LONGEST} characters")
        if value.strip():
            out[name] = value.strip()
    return out


def options(sales: DataFrame, filters: dict[str, object] | None, amount: Column, dimensions: tuple[str, ...] | None = None) -> DataFrame:
    """(dimension, value, rows, net, selected): what each dimension offers under all filters but its own, with its sum.

    sales comes from named(). A row's failed filters are one bit each; it counts for a dimension if no bit but that
    dimension's is set, so all dimensions come from one pass and one aggregate, combined before it is shuffled. Filters
    compare without accents and case. Null values are no options.
    """
    names = dimensions or tuple(c.removeprefix("dim_") for c in sales.columns if c.startswith("dim_"))
    asked = checked(filters, names)
    bit = {name: 1 << i for i, name in enumerate(names)}
    meets = lambda name: F.coalesce(plain(col(f"dim_{name}")) == plain(F.lit(asked[name])), F.lit(False))
    failed = reduce(lambda a, b: a.bitwiseOR(b), [F.when(meets(n), 0).otherwise(bit[n]) for n in asked], F.lit(0))
    offers = [
        F.when(
            F.col("failed").bitwiseAND(~bit[n] & (1 << len(names)) - 1) == 0,
            F.struct(F.lit(n).alias("dimension"), col(f"dim_{n}").alias("value"), (F.lit(n in asked) & (F.col("failed").bitwiseAND(bit[n]) == 0)).alias("selected")),
        )
        for n in names
    ]
    rows = sales.select(*[col(f"dim_{n}") for n in names], amount.alias("net"), failed.alias("failed"))
    rows = rows.where(F.bit_count("failed") <= 1)
    each = rows.select("net", F.explode(F.filter(F.array(*offers), lambda o: o.isNotNull() & o["value"].isNotNull())).alias("o"))
    return each.groupBy("o.dimension", "o.value", "o.selected").agg(F.count("*").alias("rows"), F.sum("net").cast("double").alias("net"))


def filtered(sales: DataFrame, filters: dict[str, object] | None, dimensions: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of named() sales that meet all filters."""
    names = dimensions or tuple(c.removeprefix("dim_") for c in sales.columns if c.startswith("dim_"))
    for name, value in checked(filters, names).items():
        sales = sales.where(plain(col(f"dim_{name}")) == plain(F.lit(value)))
    return sales
