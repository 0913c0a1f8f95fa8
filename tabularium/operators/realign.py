"""Columns whose values stand under each other's headers: found by evidence, moved only if one matching explains them."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.names import col
from tabularium.functions.numbers import parse_number
from tabularium.functions.roles import is_percentage, spaced
from tabularium.functions.text import is_missing, plain

#: Share of a column's values that must have a profile's shape.
EVIDENCE = 0.90
# Words of yes and no, and of headers that ask for them.
TRUTHS = ("si", "s", "true", "1", "verdadero", "activo", "activa", "no", "n", "false", "0", "falso", "inactivo", "inactiva")
TRUTH_HEADERS = ("activo", "activa", "vigente", "habilitado", "habilitada")


@dataclass(frozen=True)
class Moved:
    column: str
    taken_from: str
    profile: str


def _percentage(text: Column, number: Column) -> Column:
    return number.isNotNull() & (text.contains("%") | text.rlike(r"^-?0[.,]\d+$") | (F.abs(number) <= 1))


def _count(text: Column, number: Column) -> Column:
    return (number >= 0) & (number == F.floor(number)) & ~text.contains("%")


def _truth(text: Column, number: Column) -> Column:
    return plain(text).isin(*TRUTHS)


#: Profile -> (whether a header asks for it, whether a value has it).
PROFILES = {
    "booleano": (lambda name: bool(set(spaced(name).split()) & set(TRUTH_HEADERS)), _truth),
    "porcentaje": (is_percentage, _percentage),
    "minimo": (lambda name: "minimo" in spaced(name), _count),
}


def evidence(df: DataFrame, columns: list[str], profiles: list[str] | None = None) -> dict[tuple[str, str], float]:
    """(column, profile) -> share of the column's values that have the profile's shape: one aggregate over all rows."""
    profiles = profiles or list(PROFILES)
    parts = []
    for i, name in enumerate(columns):
        text = F.trim(col(name).cast("string"))
        said, number = ~is_missing(text), parse_number(text)
        parts.append(F.count(F.when(said, 1)).alias(f"n{i}"))
        parts += [F.count(F.when(said & PROFILES[p][1](text, number), 1)).alias(f"s{i}_{p}") for p in profiles]
    row = df.agg(*parts).first()
    return {(name, p): row[f"s{i}_{p}"] / row[f"n{i}"] if row[f"n{i}"] else 0.0 for i, name in enumerate(columns) for p in profiles}


def matching(shares: dict[tuple[str, str], float], targets: dict[str, str]) -> dict[str, str] | None:
    """profile -> column that holds its values, if exactly one perfect matching has the evidence and no column is at home.

    Each profile needs one column that has it better than all others do, at EVIDENCE or more; a profile that several
    columns have alike decides nothing.
    """
    columns = list(targets.values())
    fits = [dict(zip(targets, order)) for order in permutations(columns) if all(shares[c, p] >= EVIDENCE for p, c in zip(targets, order))]
    fits = [m for m in fits if all(shares[m[p], p] > shares[c, p] for p in targets for c in columns if c != m[p])]
    if len(fits) != 1 or any(shares[own, p] >= EVIDENCE for p, own in targets.items()):
        return None
    return fits[0]


def realign(df: DataFrame) -> tuple[DataFrame, list[Moved]]:
    """df with the values of its yes/no, percentage and minimum columns under their own headers, and what was moved.

    Only if each of the three kinds has one header, and one matching explains all three; else df stays as it is. Nulls
    and marks of missing values say nothing; all other columns, and all rows, stay as they are. Empty tables stay.
    """
    asked = {p: [c for c in df.columns if header(c)] for p, (header, _) in PROFILES.items()}
    if any(len(found) != 1 for found in asked.values()):
        return df, []
    targets = {p: found[0] for p, found in asked.items()}
    if len(set(targets.values())) != len(targets):
        return df, []
    found = matching(evidence(df, list(targets.values())), targets)
    if found is None:
        return df, []
    source = {targets[p]: c for p, c in found.items()}
    moved = df.select(*[col(source.get(c, c)).alias(c) for c in df.columns])
    return moved, [Moved(targets[p], c, p) for p, c in found.items()]
