"""The catalogue of a book's relations: which sheets may be related, by which keys, and which dashboard that makes."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.names import col
from tabularium.functions.roles import candidate_keys, detect_roles, find_column, is_unit_cost, sheet_kind, spaced
from tabularium.functions.text import relation_key
from tabularium.operators.aggregates import currency_counts
from tabularium.operators.joins import RelationStats, relation_stats
from tabularium.operators.reshape import IncompatibleSheets, append

# Kinds of facts with the kinds of references that may stand beside them.
ORIENTATIONS = {
    ("ventas", "productos"), ("ventas", "costos"), ("ventas", "historial_costos"), ("ventas", "clientes"), ("ventas", "vendedores"), ("ventas", "sucursales"), ("ventas", "inventario"),
    ("ventas", "cobranzas"), ("ventas", "ordenes_trabajo"), ("ventas", "items"), ("productos", "proveedores"), ("compras", "productos"), ("compras", "proveedores"), ("inventario", "productos"),
    ("gastos", "sucursales"), ("clientes", "vendedores"), ("vendedores", "sucursales"), ("metas", "sucursales"), ("campanas", "sucursales"), ("detalle_ot", "ordenes_trabajo"),
    ("horas_tecnicos", "ordenes_trabajo"), ("ordenes_trabajo", "clientes"), ("ordenes_trabajo", "contratos"), ("cuotas_contrato", "contratos"), ("cuotas_contrato", "valor_uf"),
    ("detalle_ot", "items"), ("horas_tecnicos", "tecnicos"), ("tarifas_tecnicos", "tecnicos"),
}
SALES_TEMPLATES = {
    "inventario": "sales_inventory", "costos": "sales_costs", "historial_costos": "sales_costs", "clientes": "sales_customers", "vendedores": "sales_sellers", "sucursales": "sales_branches", "productos": "products_sales",
}
PURCHASE_REFERENCES = ("costos", "historial_costos", "productos", "proveedores")
MONEY_TEMPLATES = ("sales_costs", "purchases_costs")
CONSOLIDATED = ("costos", "productos", "clientes", "vendedores", "sucursales", "cobranzas", "historial_costos")
ALL_SALES = "todas-las-ventas"
#: Pairs of keys that are combined two by two where no single one is safe.
COMBINED = 6


@dataclass(frozen=True)
class Related:
    id: str
    left: tuple[str, ...]  # several sheets of sales are one, under one another
    right: str
    left_keys: list[str]
    right_keys: list[str]
    template: str
    stats: RelationStats
    by_date: bool = False  # the reference has a history, and applies by date


@dataclass(frozen=True)
class Catalogue:
    relations: list[Related]
    discarded: int


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", spaced(name)).strip("-") or "hoja"


def relation_id(left: str, right: str, left_keys: list[str], right_keys: list[str]) -> str:
    """The same for the same sheets and keys."""
    return "~".join([slug(left), slug(right), "+".join(map(slug, left_keys)), "+".join(map(slug, right_keys))])


def template(left_kind: str, right_kind: str, left_columns: list[str], right_columns: list[str]) -> str:
    """Which dashboard a fact and a reference make. Stock is asked first: it may have unit costs, but is no list of costs."""
    left, right = detect_roles(left_columns), detect_roles(right_columns)
    if left_kind == "ventas":
        if right_kind != "inventario" and "monto" in left and "cantidad" in left and is_unit_cost(right.get("costo", "")):
            return "sales_costs"
        return SALES_TEMPLATES.get(right_kind, "generic")
    if left_kind == "compras" and right_kind in PURCHASE_REFERENCES:
        return "purchases_costs"
    return "expenses_branches" if (left_kind, right_kind) == ("gastos", "sucursales") else "generic"


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def _key(names: list[str]) -> Column:
    parts = [relation_key(col(n).cast("string")) for n in names]
    known = parts[0].isNotNull()
    for part in parts[1:]:
        known = known & part.isNotNull()
    return F.when(known, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))


def best_keys(left: DataFrame, right: DataFrame) -> tuple[list[str], list[str], RelationStats] | None:
    """The safest keys of two sheets: one pair if any is safe, else the first safe two of the first six pairs, else the best unsafe."""

    def tried(pairs: list[tuple[str, str]]) -> tuple[list[str], list[str], RelationStats]:
        a, b = [p[0] for p in pairs], [p[1] for p in pairs]
        return a, b, RelationStats(**relation_stats(left, _key(a), right, _key(b)).first().asDict())

    pairs = candidate_keys(_columns(left), _columns(right))
    single = [tried([p]) for p in pairs]
    if not single:
        return None
    rank = lambda x: (x[2].safe, x[2].overlap or 0, x[2].coverage or 0)
    best = max(single, key=rank)
    if best[2].safe:
        return best
    for two in combinations(pairs[:COMBINED], 2):
        found = tried(list(two))
        if found[2].safe:
            return found
    return best


def currencies(df: DataFrame) -> set[str]:
    """The currencies that the amounts of a text sheet name."""
    roles = detect_roles(_columns(df))
    money = [roles[r] for r in ("monto", "costo") if r in roles and dict(df.dtypes)[roles[r]] == "string"]
    if not money:
        return set()
    texts = df.select(F.explode(F.array(*[col(c) for c in money])).alias("t")).where("t IS NOT NULL")
    return {r["currency"] for r in currency_counts(texts, F.col("t")).collect()}


def one_currency(left: DataFrame, right: DataFrame) -> bool:
    """Whether amounts of both sheets may be set against each other."""
    a, b = currencies(left), currencies(right)
    return len(a) <= 1 and len(b) <= 1 and (not a or not b or a == b)


def _product(df: DataFrame) -> str | None:
    return find_column(_columns(df), ("sku", "producto")) or find_column(_columns(df), ("id", "producto"))


def _by_date(left: DataFrame, right: DataFrame) -> tuple[list[str], list[str], RelationStats] | None:
    """Keys of a history of costs, which repeats its keys and applies by date."""
    a, b = _product(left), _product(right)
    if not a or not b:
        return None
    found = RelationStats(**relation_stats(left, _key([a]), right.select(col(b)).distinct(), _key([b])).first().asDict())
    return [a], [b], replace(found, cardinality="many_to_one_by_date", safe=True)


def catalogue(sheets: dict[str, DataFrame]) -> Catalogue:
    """All safe relations of a book, safest first, and how many pairs were discarded.

    Several sheets of sales are related as one, under one another, so that no dashboard sees a part of the year. Only
    references with unique keys are safe; costs in another currency, or in several, are not.
    """
    kinds = {name: sheet_kind(name, _columns(df)) for name, df in sheets.items()}
    sales, found, discarded = [n for n, k in kinds.items() if k == "ventas"], [], 0
    facts: dict[tuple[str, ...], DataFrame] = {(n,): df for n, df in sheets.items() if not (kinds[n] == "ventas" and len(sales) > 1)}
    if len(sales) > 1:
        try:
            facts[tuple(sales)] = append({n: sheets[n] for n in sales}, origin="_origin")
        except IncompatibleSheets:
            facts |= {(n,): sheets[n] for n in sales}
    for names, left in facts.items():
        for right_name, right in sheets.items():
            pair = (kinds[names[0]], kinds[right_name])
            if right_name in names or pair not in ORIENTATIONS or len(names) > 1 and pair[1] not in CONSOLIDATED:
                continue
            dated = pair[1] == "historial_costos"
            best = _by_date(left, right) if dated else best_keys(left, right)
            if best is None:
                continue
            kind = template(*pair, _columns(left), _columns(right))
            if not best[2].safe or kind in MONEY_TEMPLATES and not one_currency(left, right):
                discarded += 1
                continue
            shown = ALL_SALES if len(names) > 1 else names[0]
            found.append(Related(relation_id(shown, right_name, best[0], best[1]), names, right_name, best[0], best[1], kind, best[2], dated))
    return Catalogue(sorted(found, key=lambda r: (-(r.stats.coverage or 0), r.id)), discarded)
