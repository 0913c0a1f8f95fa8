"""The period that a book says its sales cover: in a sheet of parameters, or in a sheet's title."""

from __future__ import annotations

import datetime as dt
import re
from calendar import monthrange

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.functions.dates import MONTHS, parse_date
from tabularium.functions.names import col
from tabularium.functions.roles import find_column, spaced
from tabularium.functions.text import plain

Period = tuple[dt.date | None, dt.date | None]


def _columns(frame: DataFrame) -> tuple[str | None, str | None]:
    own = [c for c in frame.columns if not c.startswith("_")]
    label = find_column(own, ("parametro",)) or (own[0] if own else None)
    return label, find_column(own, ("valor",)) or (own[1] if len(own) > 1 else None)


def declared_period(sheets: dict[str, DataFrame]) -> Period:
    """(first day, last day) of the sales period that a sheet of parameters states; (None, None) without one.

    The sheet's name says parameters; the row's label says sales period, and its value has two dates, in either order.
    Of several such rows the first readable one counts, by source position where the sheet has one, else by label.
    """
    for name, frame in sheets.items():
        label, value = _columns(frame)
        if "parametr" not in spaced(name) or value is None:
            continue
        dates = F.regexp_extract_all(col(value).cast("string"), F.lit(r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"), F.lit(0))
        place = col("_src_row") if "_src_row" in frame.columns else col(label)
        rows = frame.where(plain(col(label)).rlike(r"periodo\s+(?:de\s+)?ventas?")).select(place.alias("place"), dates.alias("dates"))
        rows = rows.select("place", parse_date(F.get("dates", F.lit(0))).alias("a"), parse_date(F.get("dates", F.lit(1))).alias("b"))
        found = rows.where("a IS NOT NULL AND b IS NOT NULL").orderBy("place").limit(1).collect()
        if found:
            return tuple(sorted((found[0]["a"], found[0]["b"])))
    return None, None


def titled_period(title: str) -> Period:
    """(first day, last day) of the months that a title names, as in "Ventas enero a marzo 2025"; (None, None) if it names none.

    A range goes from its first month to its last; each takes the year written after it, or else the next one's. A
    range that would end before it starts begins in the year before. A year alone is a whole one if it is the only one.
    """
    words = re.findall(r"[a-z]+|\d{4}", spaced(title))
    months, years = [], []
    for word in words:
        number = MONTHS.get(word)
        if number:
            months.append([number, None])
        elif re.fullmatch(r"(?:19|20)\d\d", word):
            years.append(int(word))
            for m in months:
                m[1] = m[1] or int(word)
    if not months and len(years) == 1:
        return dt.date(years[0], 1, 1), dt.date(years[0], 12, 31)
    if not months or any(y is None for _, y in months):
        return None, None
    (first, start), (last, end) = months[0], months[-1]
    if (start, first) > (end, last):
        start -= 1
    return dt.date(start, first, 1), dt.date(end, last, monthrange(end, last)[1])
