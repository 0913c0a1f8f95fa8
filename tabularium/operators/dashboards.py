"""Dashboards of relations: figures, rankings and findings of a fact beside its reference.

Facts are summed by the key of the reference before they meet it where the figures allow it; what is shown is a table
of figures and one of the largest groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.names import col
from tabularium.functions.numbers import ratio
from tabularium.functions.roles import detect_roles, find_column
from tabularium.functions.text import relation_key
from tabularium.operators.catalogue import Related
from tabularium.operators.joins import UnsafeJoin, asof_join, safe_left_join
from tabularium.operators.reshape import append, cover_state, latest_cut

# Sizes of rankings and tables, and the thresholds of findings.
TOP, TABLE = 10, 50
CONCENTRATED_PCT, LOW_MARGIN, OVERSTOCK_DAYS = 60.0, 0.15, 90
NO_CATEGORY = "Sin categoría"
DIMENSIONS = {"sales_customers": "cliente", "sales_sellers": "vendedor", "sales_branches": "sucursal"}


@dataclass(frozen=True)
class Dashboard:
    figures: DataFrame  # (id, value, text)
    ranking: DataFrame  # (label, value), the largest groups
    table: DataFrame  # a row per product or group, the largest
    findings: DataFrame  # (id, severity, value)


@dataclass(frozen=True)
class _Roles:
    """Columns of the related rows by role."""

    amount: Column | None
    quantity: Column | None
    cost: Column | None
    key: Column
    label: Column
    category: Column | None
    date: Column | None


def _keyed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("*", *[relation_key(col(n).cast("string")).alias(f"_k{i}") for i, n in enumerate(names)])


def facts_of(sheets: dict[str, DataFrame], relation: Related) -> DataFrame:
    return append({n: sheets[n] for n in relation.left}, origin="_origin") if len(relation.left) > 1 else sheets[relation.left[0]]


def related(sheets: dict[str, DataFrame], relation: Related) -> DataFrame:
    """The facts with the reference's columns beside them, one row a fact; a history of costs applies by date."""
    if not relation.stats.safe:
        raise UnsafeJoin(f"{relation.left} and {relation.right} are not safely related")
    left, right = _keyed(facts_of(sheets, relation), relation.left_keys), _keyed(sheets[relation.right], relation.right_keys)
    if relation.by_date:
        date, since = detect_roles(left.columns)["fecha"], detect_roles(right.columns)["fecha"]
        cost = detect_roles(right.columns)["costo"]
        return _by_date(left, right, date, since, cost)
    keys = [f"_k{i}" for i in range(len(relation.left_keys))]
    own = right.drop(*relation.right_keys).withColumn("_matched", F.lit(True))  # the keys are the facts' own
    return safe_left_join(left, own, keys, keys, suffix="referencia")


def _by_date(left: DataFrame, right: DataFrame, date: str, since: str, cost: str) -> DataFrame:
    out = asof_join(left, right.select(F.col("_k0"), col(since).alias(date), col(cost).alias("_cost")), "_k0", date, date, "_cost", cost)
    return out.withColumn("_matched", col(cost).isNotNull())


def _roles(rows: DataFrame, left: list[str], relation: Related) -> _Roles:
    own, all_ = detect_roles([c for c in left if not c.startswith("_")]), detect_roles([c for c in rows.columns if not c.startswith("_")])
    known = lambda name: col(name) if name else None
    amount, quantity, cost = known(own.get("monto")), known(own.get("cantidad")), all_.get("costo")
    unit = cost and find_column([cost], ("unit",))
    price = F.when(col(cost) > 0, col(cost)) if cost else None
    names = find_column(rows.columns, ("nombre", "producto")) or find_column(rows.columns, ("nombre",)) or all_.get("producto")
    key = F.col("_k0")
    return _Roles(amount, quantity, price * quantity if unit and quantity is not None else price, key, F.coalesce(col(names), key) if names else key, known(all_.get("categoria")), known(own.get("fecha")))


def _figures(row: DataFrame, made: dict[str, Column], text: dict[str, Column] | None = None) -> DataFrame:
    """(id, value, text) from one row."""
    parts = [F.struct(F.lit(k).alias("id"), F.round(v.cast("double"), 2).alias("value"), F.lit(None).cast("string").alias("text")) for k, v in made.items()]
    parts += [F.struct(F.lit(k).alias("id"), F.lit(None).cast("double").alias("value"), v.alias("text")) for k, v in (text or {}).items()]
    return row.select(F.inline(F.array(*parts)))


def _findings(row: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """(id, severity, value) of the rules that hold: (id, severity, value, condition)."""
    made = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), v.cast("double").alias("value"))) for i, s, v, when in rules]
    return row.select(F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))


def _products(rows: DataFrame, r: _Roles) -> DataFrame:
    """One row per key, and one for rows without any: label, category, amount, units, paired amount and cost, rows and paired rows."""
    nothing = F.lit(None).cast("double")
    amount, quantity, cost = (x if x is not None else nothing for x in (r.amount, r.quantity, r.cost))
    paired = amount.isNotNull() & cost.isNotNull()
    grouped = rows.groupBy(r.key.alias("key")).agg(
        F.min(r.label).alias("label"), (F.min(r.category) if r.category is not None else F.lit(None).cast("string")).alias("category"), F.sum(amount).alias("amount"), F.sum(quantity).alias("units"),
        F.sum(F.when(paired, amount)).alias("paired"), F.sum(F.when(paired, cost)).alias("cost"), F.count("*").alias("rows"), F.count(F.when(paired, 1)).alias("paired_rows"), F.count(amount).alias("amounts"),
    )
    profit = F.col("paired") - F.col("cost")
    return grouped.withColumns({"profit": profit, "margin_pct": F.when(F.col("paired") != 0, profit / F.col("paired") * 100)})


def _top_sum(groups: DataFrame, value: str = "amount") -> DataFrame:
    best = groups.where(col(value).isNotNull() & F.col("label").isNotNull()).orderBy(F.desc(value), "label").limit(TOP)  # TOP rows
    return best.agg(F.sum(value).cast("double").alias("top"))


def _whole(products: DataFrame) -> DataFrame:
    """One row of sums over all rows; those without a key are no product."""
    number = lambda c: F.sum(c).cast("double")
    known = F.col("key").isNotNull() & (F.col("paired_rows") > 0)
    margin = F.coalesce("margin_pct", F.lit(0))
    s = products.agg(
        number("amount").alias("amount"), number("units").alias("units"), F.count("key").alias("products"), number("paired").alias("paired"), number("cost").alias("cost"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("paired_rows"), F.lit(0)).alias("paired_rows"),
        F.count(F.when(known & (margin > 0), 1)).alias("good"), F.count(F.when(known & (margin <= 0), 1)).alias("bad"),
        F.count(F.when(known & (margin < 0), 1)).alias("losing"), number(F.when(known & (margin < 0), F.col("profit"))).alias("loss"),
    )
    return s.withColumns({"profit": F.col("paired") - F.col("cost"), "margin": ratio(F.col("paired") - F.col("cost"), F.col("paired")), "coverage": ratio(F.col("paired_rows"), F.col("rows")) * 100})


def _ranking(groups: DataFrame, value: str = "amount", label: str = "label") -> DataFrame:
    summed = groups.groupBy(col(label).alias("label")).agg(F.sum(value).cast("double").alias("value")).where("label IS NOT NULL AND value IS NOT NULL")
    return summed.orderBy(F.desc("value"), "label").limit(TOP)


def products_dashboard(rows: DataFrame, r: _Roles, costs: bool) -> Dashboard:
    """Products by sales, or costs of sales: what sells, what earns, how concentrated and how well covered."""
    products = _products(rows, r)
    by_label = products.groupBy("label").agg(F.sum("amount").alias("amount"))
    row = _whole(products).join(F.broadcast(_top_sum(by_label)))  # one row each
    c, share = F.col, ratio(F.col("top"), F.col("amount")) * 100
    if costs:
        made = {"ventas": c("amount"), "costo": c("cost"), "utilidad": c("profit"), "margen": c("margin") * 100, "cobertura": c("coverage"), "rentables": c("good"), "riesgo": c("bad")}
        rules = [
            ("margen_negativo", "risk", c("loss"), c("losing") > 0), ("costos_faltantes", "warning", c("coverage"), c("coverage") < 100), ("margen_bajo", "warning", c("margin") * 100, c("margin") < LOW_MARGIN),
        ]
    else:
        made = {"ingresos": c("amount"), "unidades": c("units"), "productos": c("products"), "top10": share} | ({"margen": c("margin") * 100} if r.cost is not None else {})
        rules = [("concentracion_top10", "warning", share, share >= CONCENTRATED_PCT)] + ([("cobertura_costos", "warning", c("coverage"), c("coverage") < 100)] if r.cost is not None else [])
    table = products.where("key IS NOT NULL").orderBy(F.desc("amount"), "key").limit(TABLE)
    return Dashboard(_figures(row, made), _ranking(products, "profit" if costs else "amount"), table, _findings(row, rules))


def dimensional_dashboard(rows: DataFrame, r: _Roles) -> Dashboard:
    """Sales by customer, seller or branch."""
    groups = _products(rows, r)
    total = groups.agg(F.sum("amount").cast("double").alias("amount"), F.sum("rows").alias("rows"), F.sum(F.when(F.col("key").isNotNull(), F.col("amount"))).cast("double").alias("identified"), F.count("key").alias("n"))
    by_label = groups.groupBy("label").agg(F.sum("amount").alias("amount"))
    row = total.join(F.broadcast(_top_sum(by_label)))  # one row each
    c, share = F.col, ratio(F.col("top"), F.col("identified")) * 100
    made = {"ingresos": c("amount"), "ticket": ratio(c("amount"), c("rows")), "n": c("n"), "concentracion": share}
    return Dashboard(_figures(row, made), _ranking(groups), groups.where("key IS NOT NULL").orderBy(F.desc("amount"), "key").limit(TABLE), _findings(row, [("concentracion", "warning", share, share >= CONCENTRATED_PCT)]))


def purchases_dashboard(rows: DataFrame, r: _Roles) -> Dashboard:
    products = _products(rows, r)
    row = _whole(products)
    made = {"compras": F.col("amount"), "unidades": F.col("units"), "productos": F.col("products")}
    return Dashboard(_figures(row, made), _ranking(products), products.orderBy(F.desc("amount"), "key").limit(TABLE), _findings(row, [("sin_compras", "warning", F.lit(0), F.col("products") == 0)]))


def expenses_dashboard(rows: DataFrame, r: _Roles) -> Dashboard:
    groups = _products(rows, r)
    row = groups.agg(F.sum("amount").cast("double").alias("total"), F.sum(F.when(F.col("key").isNotNull(), F.col("amount"))).cast("double").alias("amount"), F.count("key").alias("n"))
    made = {"gastos": F.col("total"), "sucursales": F.col("n"), "promedio": ratio(F.col("total"), F.col("n"))}
    return Dashboard(_figures(row, made), _ranking(groups), groups.orderBy(F.desc("amount"), "key").limit(TABLE), _findings(row, [("sin_sucursal", "warning", F.col("total") - F.col("amount"), F.col("total") > F.col("amount"))]))


def inventory_dashboard(facts: DataFrame, left_key: str, stock: DataFrame, right_key: str, until: Column | None = None) -> Dashboard:
    """Stock of the last cut against the pace of sales; stock is summed by product before sales meet it."""
    roles, held = detect_roles([c for c in facts.columns if not c.startswith("_")]), detect_roles([c for c in stock.columns if not c.startswith("_")])
    on_hand = find_column(stock.columns, ("stock",)) or held["cantidad"]
    date = find_column(stock.columns, ("fecha",))
    cut = latest_cut(stock, date, until) if date else stock
    key = lambda name: relation_key(col(name).cast("string"))
    stocked = cut.where(key(right_key).isNotNull()).groupBy(key(right_key).alias("key")).agg(F.sum(col(on_hand)).alias("stock"))
    day, units, amount = col(roles['fecha']), col(roles['cantidad']), col(roles['monto'])
    total = facts.agg(F.sum(amount).cast("double").alias("amount"), F.sum(units).cast("double").alias("units"), (F.datediff(F.max(day), F.min(day)) + 1).alias("days"))
    sold = facts.where(key(left_key).isNotNull()).groupBy(key(left_key).alias("_k")).agg(F.sum(units).alias("sold"))
    rows = stocked.join(sold, F.col("key") == F.col("_k"), "left").drop("_k").withColumn("sold", F.coalesce("sold", F.lit(0)).cast("double")).join(F.broadcast(total.select("days")))  # one row
    cover = F.round(F.when((F.col("sold") > 0) & (F.col("days") > 0), F.col("stock") / (F.col("sold") / F.col("days"))), 1)
    rows = rows.withColumns({"cover_days": cover, "turnover": F.when(F.col("stock") != 0, F.round(F.col("sold") / F.col("stock"), 2))}).withColumn("state", cover_state(F.col("cover_days"))).drop("days")
    in_state = lambda *names: F.count(F.when(F.col("state").isin(*names), 1))
    s = rows.agg(F.sum("stock").alias("stock"), F.avg("cover_days").alias("cover"), in_state("critico", "alto").alias("risky"), F.count(F.when(F.col("cover_days") > OVERSTOCK_DAYS, 1)).alias("over"), F.count("*").alias("n"), *[in_state(x).alias(x) for x in ("critico", "alto", "medio")])
    row = s.join(F.broadcast(total))  # one row each
    enough = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    level = F.when(F.col("n") == 0, None)
    for name in ("critico", "alto", "medio"):
        level = level.when(col(name) >= enough, name)
    c = F.col
    made = {"ventas": c("amount"), "unidades": c("units"), "stock": c("stock"), "cobertura": c("cover"), "riesgo": c("risky")}
    ranking = rows.where("cover_days IS NOT NULL").select(F.col("key").alias("label"), F.col("cover_days").alias("value")).orderBy("value", "label").limit(TOP)
    table = rows.orderBy(F.col("cover_days").isNull(), "cover_days", "key").limit(TABLE)
    return Dashboard(_figures(row, made, {"nivel": level.otherwise("sano")}), ranking, table, _findings(row, [("riesgo_quiebre", "risk", c("critico"), c("critico") > 0), ("sobreinventario", "warning", c("over"), c("over") > 0)]))


def build(sheets: dict[str, DataFrame], relation: Related) -> Dashboard:
    """The dashboard of a relation's template, over typed sheets."""
    left = facts_of(sheets, relation)
    if relation.template == "sales_inventory":
        return inventory_dashboard(left, relation.left_keys[0], sheets[relation.right], relation.right_keys[0])
    rows = related(sheets, relation)
    r = _roles(rows, left.columns, relation)
    if relation.template in ("products_sales", "sales_costs"):
        return products_dashboard(rows, r, relation.template == "sales_costs")
    if relation.template in DIMENSIONS:
        return dimensional_dashboard(rows, r)
    if relation.template == "purchases_costs":
        return purchases_dashboard(rows, r)
    if relation.template == "expenses_branches":
        return expenses_dashboard(rows, r)
    matched = F.count(F.when(F.col("_matched"), 1))
    row = rows.agg(F.count("*").alias("n"), matched.alias("m"))
    made = {"filas": F.col("n"), "relacionados": F.col("m"), "sin_correspondencia": F.col("n") - F.col("m"), "cobertura": ratio(F.col("m"), F.col("n")) * 100}
    groups = rows.groupBy(r.label.alias("label")).agg(F.count("*").alias("amount"))
    return Dashboard(_figures(row, made, {"cardinalidad": F.lit(relation.stats.cardinality)}), _ranking(groups), groups.orderBy(F.desc("amount"), "label").limit(TABLE), _findings(row, [("sin_correspondencia", "warning", F.col("n") - F.col("m"), F.col("n") > F.col("m"))]))
