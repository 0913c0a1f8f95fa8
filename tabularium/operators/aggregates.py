"""Grouped profitability, evolution, comparison of periods, distributions and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.durable import written
from tabularium.functions.names import col, fresh
from tabularium.functions.numbers import CURRENCIES, currency_marks, percent_change, ratio

UNCLASSIFIED = "Sin clasificar"


def measures(amount: Column, cost: Column | None = None) -> dict[str, Column]:
    """Sums over rows with an amount; profit and margin come only from rows that have a cost as well."""
    cost = F.lit(None).cast("double") if cost is None else cost
    paired = amount.isNotNull() & cost.isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return {
        "net": zero(F.sum(amount)),
        "gross": zero(F.sum(F.when(amount > 0, amount))),
        "returns": zero(-F.sum(F.when(amount < 0, amount))),
        "rows": F.count(amount),
        "paired_rows": F.count(F.when(paired, 1)),
        "paired_net": zero(F.sum(F.when(paired, amount))),
        "cost": zero(F.sum(F.when(paired, cost))),
    }


def with_rates(df: DataFrame) -> DataFrame:
    """profit, margin_pct and coverage_pct from the paired sums."""
    profit = F.col("paired_net") - F.col("cost")
    return df.withColumns(
        {
            "profit": F.when(F.col("paired_rows") > 0, profit),
            "margin_pct": F.when((F.col("paired_rows") > 0) & (F.col("paired_net") != 0), profit / F.col("paired_net") * 100),
            "coverage_pct": ratio(F.col("paired_rows"), F.col("rows")) * 100,
        }
    )


def group_profit(df: DataFrame, group: Column, amount: Column, cost: Column | None = None) -> DataFrame:
    """One row per group with sums, rates and shares of gross and of net; blank groups are one."""
    named = F.coalesce(F.nullif(F.trim(group.cast("string")), F.lit("")), F.lit(UNCLASSIFIED))
    rows = df.where(amount.isNotNull()).groupBy(named.alias("group")).agg(*[c.alias(n) for n, c in measures(amount, cost).items()])
    whole = rows.agg(F.sum("gross").alias("all_gross"), F.sum("net").alias("all_net"))
    rows = with_rates(rows).join(F.broadcast(whole))  # one row
    base = F.when(F.col("all_gross") > 0, F.col("all_gross")).otherwise(F.when(F.col("all_net") != 0, F.abs("all_net")).otherwise(1))
    shares = {"net_share_pct": F.col("net") / base * 100, "gross_share_pct": F.when(F.col("all_gross") > 0, F.col("gross") / F.col("all_gross") * 100)}
    return rows.withColumns(shares).drop("all_gross", "all_net")


def monthly(df: DataFrame, date: Column, amount: Column, cost: Column | None = None) -> DataFrame:
    """One row per month: sums, rates, the last day with data, whether the month is partial, change to the month before.

    Only the last month can be partial: its last day with data comes before its last day.
    """
    month = F.date_format(date, "yyyy-MM")
    rows = df.where(date.isNotNull() & amount.isNotNull()).groupBy(month.alias("month")).agg(
        *[c.alias(n) for n, c in measures(amount, cost).items()], F.max(F.dayofmonth(date)).alias("covered_to_day"), F.max(F.dayofmonth(F.last_day(date))).alias("days_in_month")
    )
    over = Window.orderBy("month")  # months are few
    last = F.lead("month").over(over).isNull()
    rows = with_rates(rows).withColumns({"partial": last & (F.col("covered_to_day") < F.col("days_in_month")), "prior_net": F.lag("net").over(over)})
    return rows.withColumn("change_pct", percent_change(F.col("net"), F.col("prior_net")))


def period_over_period(df: DataFrame, date: Column, amount: Column) -> DataFrame:
    """One row: the last month with data against the month before, up to the same day while the last one is partial."""
    last = df.where(amount.isNotNull()).agg(F.max(date).cast("date").alias("last")).first()["last"]
    end = F.lit(last).cast("date")
    start, before = F.trunc(end, "month"), F.trunc(F.add_months(end, -1), "month")
    partial = end < F.last_day(end)
    until = F.when(partial, F.least(F.date_add(before, F.dayofmonth(end) - 1), F.last_day(before))).otherwise(F.last_day(before))
    day = date.cast("date")
    rows = df.where((day >= before) & (day <= end))
    total = lambda when: F.coalesce(F.sum(F.when(when, amount)), F.lit(0)).cast("double")
    out = rows.agg(total(day >= start).alias("current"), total(day <= until).alias("previous"), F.count(F.when((day >= start) & amount.isNotNull(), 1)).alias("current_rows"))
    return out.select("current", "previous", "current_rows", percent_change(F.col("current"), F.col("previous")).alias("change_pct"), partial.alias("partial"), end.alias("until"))


def projection(months: DataFrame, horizon: int = 3) -> DataFrame:
    """(month, net, growth_pct, quarter_change_pct) of the months after the last one with data.

    months is the result of monthly(). Growth is the mean change of full months, each clipped to half. It starts from
    the last full month and is carried silently through a partial one, so no projected month has data. The quarter is
    the projected months' sum against that of the last three full ones. Without two full months, or with one before
    the last at or below zero, nothing is projected. Amounts are not negative.
    """
    over = Window.orderBy("month")  # months are few
    full = months.where("NOT partial").select("month", F.col("net").cast("double").alias("net"))
    growth = (F.col("net") - F.col("before")) / F.col("before")
    clipped = F.when(F.col("before") > 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), growth)))
    rows = full.withColumns({"before": F.lag("net").over(over), "place": F.row_number().over(Window.orderBy(F.desc("month")))})
    base = rows.agg(
        F.max("month").alias("last"), F.max_by("net", "month").alias("net"), F.avg(clipped).alias("growth"), F.sum(F.when(F.col("place") <= 3, F.col("net"))).alias("quarter"),
        F.count("*").alias("n"), F.count(F.when(F.col("before") <= 0, 1)).alias("bad"),
    ).where("n >= 2 AND bad = 0")
    first = F.to_date(F.concat("last", F.lit("-01")))
    gap = F.months_between(F.to_date(F.concat("seen", F.lit("-01"))), first).cast("int")
    base = base.join(F.broadcast(months.agg(F.max("month").alias("seen")))).withColumn("gap", gap)  # one row each
    step = base.select("*", F.explode(F.sequence(F.col("gap") + 1, F.col("gap") + horizon)).alias("i"))
    step = step.withColumn("value", F.round(F.greatest(F.lit(0.0), F.col("net") * F.pow(1 + F.col("growth"), F.col("i"))), 2))
    whole = F.sum("value").over(Window.partitionBy("last"))
    return step.select(
        F.date_format(F.add_months(first, F.col("i")), "yyyy-MM").alias("month"), F.col("value").alias("net"), F.round(F.col("growth") * 100, 1).alias("growth_pct"),
        percent_change(whole, F.col("quarter")).alias("quarter_change_pct"),
    )


def by_weekday(df: DataFrame, date: Column, amount: Column) -> DataFrame:
    """Sum and count by weekday, Monday 0."""
    return df.where(date.isNotNull() & amount.isNotNull()).groupBy(F.weekday(date).alias("weekday")).agg(F.sum(amount).cast("double").alias("net"), F.count("*").alias("rows"))


def top_and_rest(df: DataFrame, group: Column, amount: Column, n: int, rest: str = "Otros") -> DataFrame:
    """df with ``group``: the n groups of largest sums keep their names, all others are the rest. The n names are bounded."""
    top = df.groupBy(group.alias("g")).agg(F.sum(amount).alias("s")).orderBy(F.desc("s"), "g").limit(n)
    own, name = fresh([*df.columns, "group"], "_g", "_top")
    met = df.withColumn(own, group).join(F.broadcast(top.select(F.col("g").alias(name))), col(own).eqNullSafe(col(name)), "left")
    return met.withColumn("group", F.coalesce(col(name), F.lit(rest))).drop(own, name)


def month_matrix(df: DataFrame, date: Column, group: Column, amount: Column, n: int = 8) -> DataFrame:
    """(month, group, net) with the n largest groups and the rest."""
    rows = top_and_rest(df.where(date.isNotNull() & amount.isNotNull()), group, amount, n)
    return rows.groupBy(F.date_format(date, "yyyy-MM").alias("month"), "group").agg(F.sum(amount).cast("double").alias("net"))


def histogram(df: DataFrame, amount: Column) -> DataFrame:
    """(bin, lower, upper, rows) of equal widths: 6 to 12 bins by the root of the count, the last one closed at the maximum.

    Bins without rows are there with 0. Fewer than 20 values, or fewer than 4 different ones, give no bins.
    """
    x = amount.cast("double")
    values = df.where(x.isNotNull()).select(x.alias("x"))
    four = values.select("x").distinct().limit(4).agg(F.count("*").alias("different"))
    seen = values.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).join(F.broadcast(four))  # one row each
    bins = F.least(F.lit(12), F.greatest(F.lit(6), F.round(F.sqrt("n")).cast("int")))
    limits = seen.where("n >= 20 AND different >= 4").select("lo", "hi", bins.alias("bins"), ((F.col("hi") - F.col("lo")) / bins).alias("width"))
    spine = limits.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    rows = values.join(F.broadcast(limits))  # one row
    rows = rows.select(F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")).cast("int"), F.col("bins") - 1).alias("_bin"))
    counted = rows.groupBy("_bin").agg(F.count("*").alias("rows"))
    out = spine.join(F.broadcast(counted), F.col("bin") == F.col("_bin"), "left")  # at most 12 rows
    upper = F.when(F.col("bin") == F.col("bins") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("width"))
    return out.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"), upper.alias("upper"), F.coalesce("rows", F.lit(0)).alias("rows"))


# Upper ends of the rate buckets with their names, and the names of the others.
RATE_BUCKETS = ((0.05, "1–5%"), (0.10, "6–10%"), (0.20, "11–20%"), (0.50, "21–50%"), (1.00, "51–100%"))
NO_RATE, ZERO_RATE, BAD_RATE = "Sin dato", "Sin descuento", "Fuera de rango"


def rate_buckets(df: DataFrame, rate: Column, amount: Column) -> DataFrame:
    """(bucket, net, rows): no rate, rate zero, ranges closed above, and rates out of range."""
    bucket = F.when(rate.isNull(), NO_RATE).when(rate == 0, ZERO_RATE).when((rate < 0) | (rate > 1), BAD_RATE)
    for high, name in RATE_BUCKETS:
        bucket = bucket.when(rate <= high, name)
    return df.groupBy(bucket.alias("bucket")).agg(F.sum(amount).cast("double").alias("net"), F.count("*").alias("rows"))


#: Values that one aggregation buffer, or the driver, may hold for a quantile.
QUANTILE_VALUES = 1_000_000


def exact_quantiles(df: DataFrame, value: Column, shares: list[float], most: int = QUANTILE_VALUES) -> tuple[int, list[float] | None]:
    """(count, exact quantiles by linear interpolation) of the values, in bounded memory.

    A sketch brackets each quantile's rank; the values inside the bracket are then counted exactly, and the bracket is
    narrowed until they are few. Null and NaN values take no part.
    """
    v = df.where(value.isNotNull() & ~F.isnan(value.cast("double"))).select(value.cast("double").alias("v"))
    n = v.count()
    if not n:
        return 0, None
    if n <= most:
        return n, list(v.agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in shares]))).first()[0])
    ranks = {r for p in shares for r in (int((n - 1) * p), min(int((n - 1) * p) + 1, n - 1))}
    at = {r: _at_rank(v, r, most) for r in sorted(ranks)}
    between = lambda x: at[int(x)] if x == int(x) else at[int(x)] + (x - int(x)) * (at[int(x) + 1] - at[int(x)])
    return n, [between((n - 1) * p) for p in shares]


def _at_rank(v: DataFrame, rank: int, most: int, accuracy: int = 10_000) -> float:
    low, high = float("-inf"), float("inf")
    while True:
        s = v.agg(F.count(F.when(F.col("v") < low, 1)).alias("below"), F.count(F.when(F.col("v").between(low, high), 1)).alias("m")).first()
        inside, place = v.where(F.col("v").between(low, high)), rank - s["below"]
        different = inside.groupBy("v").agg(F.count("*").alias("n"))
        if s["m"] <= most or different.limit(most + 1).count() <= most:
            for row in sorted(different.collect()):  # at most ``most`` rows
                place -= row["n"]
                if place < 0:
                    return row["v"]
        near = [max(0.0, place / s["m"] - 2 / accuracy), min(1.0, place / s["m"] + 2 / accuracy)]
        low, high = inside.agg(F.percentile_approx("v", F.array(*[F.lit(x) for x in near]), accuracy)).first()[0]


def outlier_fences(df: DataFrame, value: Column, times: float, least: int, two_sided: bool = False) -> DataFrame:
    """One row: count, quartiles, fences and how many values lie beyond; fences are null with fewer than ``least`` values."""
    v = value.cast("double")
    n, q = exact_quantiles(df, value, [0.25, 0.75])
    q1, q3 = q or (None, None)
    known = q is not None and n >= least
    low = q1 - (q3 - q1) * times if known and two_sided else None
    high = q3 + (q3 - q1) * times if known else None
    number = lambda x: F.lit(x).cast("double")
    beyond = F.coalesce(v > number(high), F.lit(False)) | F.coalesce(v < number(low), F.lit(False))
    found = df.agg(F.count(v).alias("n"), F.count(F.when(beyond, 1)).alias("outliers")).where("n > 0")
    return found.select("n", number(q1).alias("q1"), number(q3).alias("q3"), number(low).alias("lower_fence"), number(high).alias("upper_fence"), "outliers")


def running_share(groups: DataFrame, name: str, value: str, parts: int = 64) -> DataFrame:
    """groups with rank, running sum and cumulative share in percent, largest first.

    Values are cut into ranges at approximate quantiles; each range has its own window, and starts where the larger
    ones end. So no task orders all groups. Only positive values take part. The groups are computed once, into a table
    of the shared folder.
    """
    rows = written(groups.where(col(value) > 0))
    cuts = rows.agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000)).alias("c")).first()["c"] or []
    part = F.lit(0)
    for cut in sorted(set(cuts)):
        part = part + (col(value) < F.lit(cut)).cast("int")
    rows = rows.withColumn("_part", part)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    sums = {"_before_n": F.sum("_n").over(earlier), "_before_s": F.sum("_s").over(earlier), "_total": F.sum("_s").over(Window.partitionBy())}
    offsets = sizes.withColumns(sums).drop("_n", "_s").withColumnRenamed("_part", "_of")
    order = Window.partitionBy("_part").orderBy(F.desc(value), name)
    running = F.coalesce("_before_s", F.lit(0)) + F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))  # parts rows at most
    out = out.withColumns({"rank": F.coalesce("_before_n", F.lit(0)) + F.row_number().over(order), "running": running})
    share = F.col("running").cast("double") / F.col("_total").cast("double") * 100
    return out.withColumn("cumulative_pct", share).drop("_part", "_of", "_before_n", "_before_s", "_total")


# The portfolio's quadrants, by high share and high margin.
QUADRANTS = {(True, True): "estrella", (True, False): "vaca_lechera", (False, True): "oportunidad", (False, False): "problema"}


def portfolio(groups: DataFrame) -> DataFrame:
    """group_profit() rows with a quadrant by median margin and median share of net; needs four groups with a margin."""
    known = groups.where("margin_pct IS NOT NULL AND net_share_pct IS NOT NULL")
    n, margin = exact_quantiles(known, F.col("margin_pct"), [0.5])
    _, share = exact_quantiles(known, F.col("net_share_pct"), [0.5])
    mid_margin, mid_share = (F.lit(x[0] if n >= 4 else None).cast("double") for x in (margin or [None], share or [None]))
    high_margin, high_share = F.col("margin_pct") >= mid_margin, F.col("net_share_pct") >= mid_share
    quadrant = F.lit(None).cast("string")
    for (shared, margined), named in QUADRANTS.items():
        quadrant = F.when((high_share == F.lit(shared)) & (high_margin == F.lit(margined)), named).otherwise(quadrant)
    return known.withColumns({"mid_margin": mid_margin, "mid_share": mid_share, "quadrant": quadrant}).where("mid_margin IS NOT NULL")


def break_even(total: DataFrame, expenses: Column) -> DataFrame:
    """From one row of paired sums: gross margin, sales needed to cover the expenses, profit if costs rise or fall."""
    margin = ratio(F.col("paired_net") - F.col("cost"), F.col("paired_net"))
    sensitivity = [(F.col("paired_net") - F.col("cost") * F.lit(1 + x / 100)).alias(f"profit_cost_{'plus' if x > 0 else 'minus'}_{abs(x)}") for x in (-10, -5, 5, 10)]
    return total.select(margin.alias("gross_margin"), F.when(margin > 0, expenses / margin).alias("break_even_sales"), *sensitivity)


def currency_counts(df: DataFrame, text: Column) -> DataFrame:
    """(currency, values): how many texts name each currency."""
    found = df.select(F.explode(currency_marks(text)).alias("currency"))
    return found.groupBy("currency").agg(F.count("*").alias("values"))


def mixed_currency(df: DataFrame, *columns: str) -> bool:
    """Whether several currencies are named; mixed amounts must not be summed."""
    marks = [F.coalesce(currency_marks(col(c)), F.array().cast("array<string>")) for c in columns]
    found = df.select(F.explode(F.array_distinct(F.concat(*marks))).alias("c")).distinct()
    return found.limit(len(CURRENCIES)).count() > 1
