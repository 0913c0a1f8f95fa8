"""Joins that prove their safety first, effective-dated and interval joins, and reference checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.names import col, cols, fresh

#: Shares of matched rows and keys that a safe relation needs.
LEAST_COVERAGE = LEAST_OVERLAP = 0.60


class UnsafeJoin(ValueError):
    """The relation would repeat rows or leave too many unmatched."""


@dataclass(frozen=True)
class RelationStats:
    left_rows: int
    right_rows: int
    left_keys: int
    right_keys: int
    common_keys: int
    left_matched_rows: int
    right_matched_rows: int
    right_repeated_keys: int
    left_repeated_keys: int
    projected_rows: int
    coverage: float | None
    reverse_coverage: float | None
    overlap: float | None
    cardinality: str
    safe: bool


def struct_key(*columns: str) -> Column:
    """One column of key parts, null if any of them is."""
    complete = col(columns[0]).isNotNull()
    for c in columns[1:]:
        complete = complete & col(c).isNotNull()
    return F.when(complete, F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(columns)]))


def relation_stats(left: DataFrame, left_key: Column, right: DataFrame, right_key: Column) -> DataFrame:
    """One row: rows, keys, coverage both ways, overlap of key sets, cardinality, projected rows, whether safe.

    Both sides are counted by key before they meet, so a hot key costs one row.
    Null keys match nothing. Safe: unique keys on the right, enough coverage and overlap, as many rows as the left has.
    """
    l = left.groupBy(left_key.alias("k")).agg(F.count("*").alias("n"))
    r = right.groupBy(right_key.alias("k")).agg(F.count("*").alias("m"))
    both = l.withColumnRenamed("k", "a").join(r.withColumnRenamed("k", "b"), F.col("a") == F.col("b"), "full_outer")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    hasl, hasr = F.col("a").isNotNull(), F.col("b").isNotNull()
    total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("long")
    s = both.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("left_rows"),
        F.coalesce(F.sum(m), F.lit(0)).cast("long").alias("right_rows"),
        F.count(F.when(hasl, 1)).alias("left_keys"),
        F.count(F.when(hasr, 1)).alias("right_keys"),
        F.count(F.when(hasl & hasr, 1)).alias("common_keys"),
        total(hasl & hasr, n).alias("left_matched_rows"),
        total(hasl & hasr, m).alias("right_matched_rows"),
        F.count(F.when(hasr & (m > 1), 1)).alias("right_repeated_keys"),
        F.count(F.when(hasl & (n > 1), 1)).alias("left_repeated_keys"),
        F.coalesce(F.sum(F.when(hasl & hasr, n * m).otherwise(n)), F.lit(0)).cast("long").alias("projected_rows"),
    )
    share = lambda a, b: F.when(col(b) > 0, col(a) / col(b))
    fewer = F.least("left_keys", "right_keys")
    s = s.withColumns(
        {
            "coverage": share("left_matched_rows", "left_rows"),
            "reverse_coverage": share("right_matched_rows", "right_rows"),
            "overlap": F.when(fewer > 0, F.col("common_keys") / fewer),
            "cardinality": F.concat_ws(
                "_to_", F.when(F.col("left_repeated_keys") > 0, "many").otherwise("one"), F.when(F.col("right_repeated_keys") > 0, "many").otherwise("one")
            ),
        }
    )
    safe = (
        (F.col("right_repeated_keys") == 0) & (F.col("coverage") >= LEAST_COVERAGE) & (F.col("reverse_coverage") >= LEAST_COVERAGE)
        & (F.col("overlap") >= LEAST_OVERLAP) & (F.col("projected_rows") == F.col("left_rows"))
    )
    return s.withColumn("safe", F.coalesce(safe, F.lit(False)))


def stats_of(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str]) -> RelationStats:
    row = relation_stats(left, struct_key(*left_keys), right, struct_key(*right_keys)).first()
    return RelationStats(**row.asDict())


def safe_left_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], suffix: str = "right", leave_out: tuple[str, ...] = ()) -> DataFrame:
    """left with the columns of right, many to one, after the relation proved safe; clashing names get the suffix.

    leave_out names columns of right that must not come along, such as measures that would be counted once per match.
    """
    stats = stats_of(left, left_keys, right, right_keys)
    if not stats.safe:
        raise UnsafeJoin(f"the relation is not safe: {asdict(stats)}")
    taken = {c.lower() for c in left.columns}
    brought = [c for c in right.columns if c not in right_keys and c not in leave_out]
    renamed = {c: f"{c}_{suffix}" if c.lower() in taken else c for c in brought}
    own, other = fresh([*left.columns, *renamed.values()], "_left_key", "_right_key")
    side = right.select(struct_key(*right_keys).alias(other), *[col(c).alias(n) for c, n in renamed.items()])
    return left.withColumn(own, struct_key(*left_keys)).join(side, col(own) == col(other), "left").drop(own, other)


def unique_reference(reference: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row per key with its values; keys whose rows disagree are left out, null keys too."""
    (variants,) = fresh([key, *values], "_variants")
    known = reference.where(col(key).isNotNull()).groupBy(col(key)).agg(F.count_distinct(_content(values)).alias(variants), *[F.first(col(v)).alias(v) for v in values])
    return known.where(col(variants) == 1).drop(variants)


def _content(values: list[str]) -> Column:
    """One comparable value of several columns, nulls included."""
    return F.struct(*[F.coalesce(col(v).cast("string"), F.lit("\0")).alias(v) for v in values])


def reference_quality(reference: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row: keys, keys with repeated rows, keys whose repeated rows conflict, rows without a key."""
    by_key = reference.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(_content(values)).alias("variants"))
    known = col(key).isNotNull()
    return by_key.agg(
        F.count(F.when(known, 1)).alias("keys"),
        F.count(F.when(known & (F.col("n") > 1), 1)).alias("repeated_keys"),
        F.count(F.when(known & (F.col("variants") > 1), 1)).alias("conflicting_keys"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("rows_without_key"),
    )


def lookup(source: DataFrame, source_key: str, reference: DataFrame, reference_key: str, value: str, to: str) -> DataFrame:
    """source with the value of its key as ``to``; keys with conflicting values give null."""
    (key,) = fresh([*source.columns, to], "_key")
    known = unique_reference(reference, reference_key, [value]).select(col(reference_key).alias(key), col(value).alias(to))
    return source.join(known, col(source_key) == col(key), "left").drop(key)


def referential_integrity(source: DataFrame, key: str, reference: DataFrame, reference_key: str, relation: str, examples: int = 5) -> DataFrame:
    """One row: relation, rows, valid, orphans, without_key, coverage_pct, example keys of orphans (the smallest)."""
    counted = source.groupBy(col(key).alias("k")).agg(F.count("*").alias("n"))
    known = reference.where(col(reference_key).isNotNull()).select(col(reference_key).alias("r")).distinct()
    rows = counted.join(known, F.col("k") == F.col("r"), "left")
    orphan = F.col("k").isNotNull() & F.col("r").isNull()
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    found = rows.agg(total(F.lit(True)).alias("rows"), total(F.col("r").isNotNull()).alias("valid"), total(orphan).alias("orphans"), total(F.col("k").isNull()).alias("without_key"))
    few = [str(x["k"]) for x in rows.where(orphan).orderBy("k").limit(examples).select("k").collect()]
    return found.select(
        F.lit(relation).alias("relation"), "rows", "valid", "orphans", "without_key",
        F.when(F.col("rows") > 0, F.col("valid") / F.col("rows") * 100).alias("coverage_pct"), F.lit(", ".join(few)).alias("examples"),
    )


def attribute_consistency(source: DataFrame, key: str, attribute: str, reference: DataFrame, reference_key: str, reference_attribute: str) -> DataFrame:
    """One row: rows whose key is found and both attributes present, and how many of them differ."""
    known = unique_reference(reference, reference_key, [reference_attribute]).select(col(reference_key).alias("r"), col(reference_attribute).alias("x"))
    pairs = source.groupBy(col(key).alias("k"), col(attribute).alias("a")).agg(F.count("*").alias("n")).join(known, F.col("k") == F.col("r"))
    both = F.col("a").isNotNull() & F.col("x").isNotNull()
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return pairs.agg(total(both).alias("compared"), total(both & (F.col("a") != F.col("x"))).alias("different"))


def asof_join(facts: DataFrame, history: DataFrame, key: str, date: str, history_date: str, value: str, to: str, grain: str = "month") -> DataFrame:
    """facts with the latest value of its key on or before its date as ``to``, and ``<to>_since``.

    Conflicting values of one key and date are dropped, equal ones count once; null values and dates never apply.
    Rows are windowed by key and period, and each period starts from the last value before it, so a key with very
    many rows is spread over its periods. Rows without key or date are set aside, and get no value.
    """
    known = history.where(col(value).isNotNull() & col(history_date).isNotNull() & col(key).isNotNull())
    known = known.groupBy(col(key).alias("k"), col(history_date).alias("d")).agg(F.min(value).alias("v"), F.max(value).alias("v2")).where("v = v2")
    known = known.select("k", "d", F.date_trunc(grain, "d").alias("p"), F.struct(F.col("v"), F.col("d").alias("since")).alias("h"))
    whole = facts.select(F.struct("*").alias("row"), col(key).alias("k"), col(date).alias("d")).withColumn("p", F.date_trunc(grain, "d"))
    rows = whole.where("k IS NOT NULL AND d IS NOT NULL")
    absent = F.lit(None).cast(known.schema["h"].dataType)
    side = known.select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "k", "d", "p", "h", F.lit(0).alias("side"))
    both = side.unionByName(rows.select("row", "k", "d", "p", absent.alias("h"), F.lit(1).alias("side")))
    in_period = Window.partitionBy("k", "p").orderBy("d", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("h", F.last("h", ignorenulls=True).over(in_period)).where("side = 1")

    periods = rows.select("k", "p").distinct().withColumn("e", F.lit(None).cast(known.schema["h"].dataType))
    ends = known.groupBy("k", "p").agg(F.max_by("h", "d").alias("e"))
    before = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(periods).groupBy("k", "p").agg(F.first("e", ignorenulls=True).alias("e"))
    carried = carried.withColumn("carried", F.last("e", ignorenulls=True).over(before)).select(F.col("k").alias("ck"), F.col("p").alias("cp"), "carried")
    out = both.join(carried, (F.col("k") == F.col("ck")) & (F.col("p") == F.col("cp")), "left")
    without = whole.where("k IS NULL OR d IS NULL").select("row", absent.alias("found"))
    out = out.select("row", F.coalesce("h", "carried").alias("found")).unionByName(without)
    return out.select("row.*", F.col("found")["v"].alias(to), F.col("found")["since"].alias(f"{to}_since"))


def interval_join(facts: DataFrame, intervals: DataFrame, key: str, date: str, interval_key: str, since: str, until: str, values: list[str], grain: str = "month") -> DataFrame:
    """facts with the values of the interval of its key that holds its date; rows outside any drop out, as bounds are closed.

    Intervals are cut into the periods they touch, so that key and period are an equality that Spark can hash, and
    only rows of the same key and period are compared. Overlapping intervals raise UnsafeJoin.
    """
    k, a, b, ip, p, after = fresh([*facts.columns, *values], "_ik", "_a", "_b", "_ip", "_p", "_next")
    ends = intervals.where(col(interval_key).isNotNull()).select(col(interval_key).alias(k), col(since).alias(a), col(until).alias(b), *cols(*values))
    following = Window.partitionBy(k).orderBy(a, b)
    if ends.withColumn(after, F.lead(a).over(following)).where(col(after) <= col(b)).limit(1).count():
        raise UnsafeJoin("intervals of one key overlap")
    periods = F.sequence(F.date_trunc(grain, a).cast("date"), F.date_trunc(grain, b).cast("date"), F.expr(f"interval 1 {grain}"))
    cut = ends.where(col(a) <= col(b)).withColumn(ip, F.explode(periods))
    rows = facts.withColumn(p, F.date_trunc(grain, col(date)).cast("date"))
    met = rows.join(cut, (col(key) == col(k)) & (col(p) == col(ip)) & col(date).between(col(a), col(b)))
    return met.drop(k, a, b, ip, p)


def net_returns(sales: DataFrame, key: str, amount: str, quantity: str, returns: DataFrame, return_key: str, return_amount: str, return_quantity: str) -> DataFrame:
    """sales with returned and net amounts and quantities; returns are summed by sale before they meet it."""
    (k,) = fresh([*sales.columns, "returned_amount", "returned_quantity"], "_k")
    back = returns.groupBy(col(return_key).alias(k)).agg(F.sum(col(return_amount)).alias("returned_amount"), F.sum(col(return_quantity)).alias("returned_quantity"))
    out = sales.join(back, col(key) == col(k), "left").drop(k)
    zero = lambda c: F.coalesce(col(c), F.lit(0))
    return out.withColumns(
        {"returned_amount": zero("returned_amount"), "returned_quantity": zero("returned_quantity"), "net_amount": col(amount) - zero("returned_amount"), "net_quantity": col(quantity) - zero("returned_quantity")}
    )


def goals_vs_actual(goals: DataFrame, actuals: DataFrame, on: list[str], goal: str, actual: str) -> DataFrame:
    """Each goal with its actual amount (0 without any), the share reached in percent and whether it was met."""
    summed = actuals.groupBy(*cols(*on)).agg(F.sum(col(actual)).alias("actual"))
    rows = goals.groupBy(*cols(*on)).agg(F.sum(col(goal)).alias("goal")).join(summed, on, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return rows.withColumn("reached_pct", F.when(F.col("goal") > 0, F.col("actual") / F.col("goal") * 100)).withColumn("met", F.col("actual") >= F.col("goal"))


def resolve_unique(candidates: DataFrame, key: str, signature: list[str], preferred: Column | None = None) -> DataFrame:
    """One row per key: status unique, preferred, ambiguous, and the signature's values where one candidate is left.

    A key with one distinct signature is unique; else, if one distinct signature is among the preferred rows, that one.
    """
    better = F.coalesce(preferred, F.lit(False)) if preferred is not None else F.lit(False)
    content = F.struct(*[col(c) for c in signature])
    keys = candidates.where(col(key).isNotNull()).groupBy(col(key)).agg(
        F.count_distinct(_content(signature)).alias("n"), F.count_distinct(F.when(better, _content(signature))).alias("np"),
        F.first(content).alias("any"), F.first(F.when(better, content), ignorenulls=True).alias("best"),
    )
    chosen = F.when(F.col("n") == 1, F.col("any")).when(F.col("np") == 1, F.col("best"))
    status = F.when(F.col("n") == 1, "unique").when(F.col("np") == 1, "preferred").otherwise("ambiguous")
    out = keys.select(col(key), status.alias("status"), chosen.alias("x"))
    return out.select(col(key), "status", *[F.col("x")[c].alias(c) for c in signature])
