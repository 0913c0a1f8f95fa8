"""Columns by the names that users write: dots, accents, quotes and spaces are part of a name, never a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """The name as Spark reads it literally wherever it takes a name."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def cols(*names: str) -> list[Column]:
    return [col(name) for name in names]


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for helper columns that none of ``taken`` has, whatever its case."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
