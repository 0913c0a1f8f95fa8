"""Report tables: profiles of catalogues, stock and unknown sheets, groupings worth showing, chart series and scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.names import col
from tabularium.functions.numbers import ratio
from tabularium.functions.text import is_blank, plain
from tabularium.operators.aggregates import exact_quantiles, outlier_fences

# The natural order of labels in charts.
WEEKDAYS = ("lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo")
MONTH_NAMES = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, values, mean, median, least, most) of number columns: one aggregate, and the medians in bounded memory."""
    number = lambda c: col(c).cast("double")
    known = lambda c: F.when(~F.isnan(number(c)), number(c))
    of = lambda c: F.struct(F.count(known(c)).alias("values"), F.avg(known(c)).alias("mean"), F.min(known(c)).alias("least"), F.max(known(c)).alias("most"))
    wide = df.agg(*[of(c).alias(f"c{i}") for i, c in enumerate(columns)])
    middle = {c: (exact_quantiles(df, col(c), [0.5])[1] or [None])[0] for c in columns}
    rows = []
    for i, c in enumerate(columns):
        x = F.col(f"c{i}")
        median = F.lit(middle[c]).cast("double").alias("median")
        rows.append(F.struct(F.lit(c).alias("column"), x["values"].alias("values"), x["mean"].alias("mean"), median, x["least"].alias("least"), x["most"].alias("most")))
    return wide.select(F.inline(F.array(*rows)))


def distribution(df: DataFrame, label: Column, limit: int = 12) -> DataFrame:
    """(label, rows, share_pct) of the most frequent labels, a report of the top."""
    counted = df.where(~is_blank(label)).groupBy(F.trim(label.cast("string")).alias("label")).agg(F.count("*").alias("rows"))
    total = counted.agg(F.sum("rows").alias("all"))
    return counted.join(F.broadcast(total)).select("label", "rows", (F.col("rows") / F.col("all") * 100).alias("share_pct")).orderBy(F.desc("rows"), "label").limit(limit)  # one row


def groupings_worth_showing(df: DataFrame, columns: list[str], most: int = 4, least_filled: float = 0.6) -> list[str]:
    """Up to ``most`` columns with 2 to 30 different labels that are mostly filled, the fuller ones first."""
    wide = df.agg(F.count("*").alias("n"), *[F.struct(F.count(F.when(~is_blank(col(c)), 1)).alias("filled"), F.approx_count_distinct(col(c), 0.02).alias("different")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    share = {c: wide[f"c{i}"]["filled"] / max(wide["n"], 1) for i, c in enumerate(columns) if 2 <= wide[f"c{i}"]["different"] <= 30}
    return sorted((c for c, x in share.items() if x >= least_filled), key=lambda c: (-share[c], columns.index(c)))[:most]


def catalogue_profile(df: DataFrame, price: Column, cost: Column) -> DataFrame:
    """One row: products, mean and median price, mean cost, potential margin, products without or below cost, costs beyond the fence."""
    potential = F.when((price > 0) & cost.isNotNull(), (price - cost) / price * 100)
    fences = outlier_fences(df, cost, 1.5, 4).select("outliers")
    middle = (exact_quantiles(df, price, [0.5])[1] or [None])[0]
    s = df.agg(
        F.count("*").alias("products"), F.avg(price).alias("mean_price"), F.lit(middle).cast("double").alias("median_price"), F.avg(cost).alias("mean_cost"), F.avg(potential).alias("potential_margin_pct"),
        F.count(F.when(cost.isNull() | (cost <= 0), 1)).alias("without_cost"), F.count(F.when(cost > price, 1)).alias("below_cost"),
    )
    return s.join(F.broadcast(fences))  # one row each


def stock_cut(df: DataFrame, date: Column, key: Column, stock: Column, minimum: Column, unit_cost: Column) -> DataFrame:
    """One row from the last day's rows: day, products, stock, value, rows below their minimum, negative ones."""
    last = df.agg(F.max(date).alias("d")).first()["d"]
    rows = df.where(date == F.lit(last))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    return rows.agg(
        F.max(date).alias("day"), F.count_distinct(key).alias("products"), zero(stock).alias("stock"), zero(F.when(unit_cost > 0, stock * unit_cost)).alias("value"),
        F.count(F.when(stock < minimum, 1)).alias("below_minimum"), F.count(F.when(stock < 0, 1)).alias("negative"),
    )


def chart_series(groups: DataFrame, label: str, value: str, most: int = 12, rest: str = "Otros") -> DataFrame:
    """(label, value, rank, cumulative_pct): the largest labels, and all others as one at the end.

    groups has a row per label; the first ranks are a top-n, and only those few rows are windowed.
    """
    known = groups.where(col(value).isNotNull()).select(col(label).cast("string").alias("label"), col(value).cast("double").alias("value"))
    top = known.orderBy(F.desc("value"), "label").limit(most)
    others = known.join(F.broadcast(top.select("label")), "label", "left_anti").agg(F.sum("value").alias("value")).where("value IS NOT NULL").select(F.lit(rest).alias("label"), "value", F.lit(1).alias("last"))
    rows = top.withColumn("last", F.lit(0)).unionByName(others)
    order = Window.orderBy("last", F.desc("value"), "label")  # at most most + 1 rows
    total = F.sum("value").over(Window.partitionBy())
    return rows.select("label", "value", F.row_number().over(order).alias("rank"), (F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total * 100).alias("cumulative_pct"))


def natural_rank(label: Column) -> Column:
    """Where a weekday, a month or a range stands by nature; null for other labels."""
    flat = plain(label)
    day = F.array_position(F.array(*[F.lit(x) for x in WEEKDAYS]), flat)
    month = F.array_position(F.array(*[F.lit(x) for x in MONTH_NAMES]), flat)
    low = F.regexp_extract(flat, r"^[\[(<>]?\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.coalesce(F.nullif(day, F.lit(0)).cast("double"), F.nullif(month, F.lit(0)).cast("double"), low)


def heat_scale(cells: DataFrame, value: str, top: float = 0.95) -> DataFrame:
    """cells with ``intensity`` from -1 to 1: the value over the 95th percentile of sizes, so that few large ones don't pale the rest."""
    number = col(value).cast("double")
    scale = F.lit((exact_quantiles(cells, F.abs(number), [top])[1] or [None])[0]).cast("double")
    return cells.withColumn("intensity", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(number, scale))))


def full_months(months: DataFrame) -> DataFrame:
    """monthly() without its partial month."""
    return months.where("NOT partial")


def unique_views(views: DataFrame, fingerprint: str, score: str, limit: int = 8) -> DataFrame:
    """The best view of each fingerprint, and of those the best few."""
    best = views.withColumn("_r", F.row_number().over(Window.partitionBy(fingerprint).orderBy(F.desc(score)))).where("_r = 1").drop("_r")
    return best.orderBy(F.desc(score), fingerprint).limit(limit)
