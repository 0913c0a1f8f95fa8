"""Requests over sheets: which rows count, one sheet or several, and the tables of figures that follow."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.dates import within
from tabularium.functions.names import col
from tabularium.functions.profiles import is_catalogue, is_sales, other_kind
from tabularium.functions.roles import candidate_keys, sheet_kind, spaced
from tabularium.functions.text import norm_key, plain, relation_key
from tabularium.operators import aggregates as A
from tabularium.operators.joins import RelationStats, UnsafeJoin, relation_stats, safe_left_join
from tabularium.operators.reshape import append, structural_total
from tabularium.operators.standardize import Standardized

CANCELLED = r"^(anulad|cancelad|nul[ao]\b|void|rechazad)"
MODES = ("single", "append", "join", "append_join")


@dataclass(frozen=True)
class Join:
    left_keys: list[str]
    right: str
    right_keys: list[str]


@dataclass(frozen=True)
class Scope:
    """Which sheets are analysed, and how they come together."""

    mode: str
    sheets: list[str]
    join: Join | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if not self.sheets or "join" in self.mode and self.join is None:
            raise ValueError("a scope names sheets, and a join its keys")


def build(sheets: dict[str, DataFrame], scope: Scope) -> DataFrame:
    """The scope's rows: a sheet, sheets under one another, and a reference beside them if the relation is safe."""
    if "append" in scope.mode:
        rows = append({name: sheets[name] for name in scope.sheets}, origin="hoja_origen")
    else:
        rows = sheets[scope.sheets[0]]
    if scope.join:
        rows = safe_left_join(rows, sheets[scope.join.right], scope.join.left_keys, scope.join.right_keys, suffix=scope.join.right)
    return rows


def columns_of(done: Standardized) -> dict[str, Column]:
    """The typed column of each role."""
    suffix = {"numero": "__num", "fecha": "__date"}
    return {role: col(f"{c}{suffix.get(done.types[c].kind, '')}") for role, c in done.roles.items()}


def counting_rows(done: Standardized, since: str | None = None, until: str | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """Rows that count: neither cancelled nor totals inside the data, within the dates, with the filtered labels.

    An unknown dimension in filters leaves no rows. Rows stay in the base; this is a view of them.
    """
    roles, frame = columns_of(done), done.frame
    raw = frame.select(*[col(c) for c in done.types])
    keep = ~structural_total(raw, roles.get("fecha"))
    status = next((c for c in done.types if spaced(c).split()[:1] == ["estado"]), None)
    if status:
        keep = keep & ~F.coalesce(plain(col(status)).rlike(CANCELLED), F.lit(False))
    if "fecha" in roles:
        keep = keep & within(roles["fecha"], since, until)
    for role, wanted in (filters or {}).items():
        keep = keep & (norm_key(roles[role]) == norm_key(F.lit(wanted))) if role in roles else F.lit(False)
    return frame.where(keep)


@dataclass(frozen=True)
class Metrics:
    """Tables of figures; those whose roles are missing are left out. Mixed currencies leave out all amounts.

    profile is "ventas", or what the sheet is instead; only sales have figures, so that a list of products, a purchase or
    a stock is never summed as sales.
    """

    totals: DataFrame | None = None
    monthly: DataFrame | None = None
    weekdays: DataFrame | None = None
    histogram: DataFrame | None = None
    groups: dict[str, DataFrame] = field(default_factory=dict)
    projection: DataFrame | None = None
    mixed_currency: bool = False
    profile: str | None = None


def compute(done: Standardized, since: str | None = None, until: str | None = None, filters: dict[str, str] | None = None) -> Metrics:
    roles = columns_of(done)
    columns = list(done.types)
    if not is_sales(columns, done.roles):
        return Metrics(profile="catalogo" if is_catalogue(columns, done.roles) else other_kind(columns, done.roles))
    money = [done.roles[r] for r in ("monto", "costo") if r in done.roles]
    if A.mixed_currency(done.frame.select(*[col(c).alias(f"m{i}") for i, c in enumerate(money)]), *[f"m{i}" for i in range(len(money))]):
        return Metrics(mixed_currency=True, profile="ventas")
    rows, amount = counting_rows(done, since, until, filters), roles["monto"]
    cost = roles.get("costo")
    if cost is not None and "cantidad" in roles and "unit" in spaced(done.roles["costo"]):
        cost = F.when(cost > 0, cost) * roles["cantidad"]
    totals = A.with_rates(rows.agg(*[c.alias(n) for n, c in A.measures(amount, cost).items()]))
    dated = roles.get("fecha")
    monthly = A.monthly(rows, dated, amount, cost) if dated is not None else None
    groups = {r: A.group_profit(rows, roles[r], amount, cost) for r in ("producto", "categoria", "cliente", "canal", "sucursal", "vendedor") if r in roles}
    return Metrics(totals, monthly, A.by_weekday(rows, dated, amount) if dated is not None else None, A.histogram(rows, amount), groups, A.projection(monthly) if monthly is not None else None, profile="ventas")


@dataclass(frozen=True)
class Relation:
    left: str
    right: str
    left_keys: list[str]
    right_keys: list[str]
    stats: RelationStats


def detect_relations(sheets: dict[str, DataFrame]) -> list[Relation]:
    """Relations from facts to references, best first: the safest key pair of each pair of sheets, two keys where one is not safe.

    Every pair of keys is tried alone; two keys are tried among the first six pairs, up to the first safe combination.
    """
    facts = {"ventas", "devoluciones", "compras", "inventario", "metas", "cobranzas", "detalle_ot", "ordenes_trabajo", "horas_tecnicos"}
    kinds = {name: sheet_kind(name, df.columns) for name, df in sheets.items()}
    found = []
    for left in (n for n, k in kinds.items() if k in facts):
        for right in (n for n, k in kinds.items() if n != left and k not in facts):
            pairs = candidate_keys([c for c in sheets[left].columns if not c.startswith("_")], [c for c in sheets[right].columns if not c.startswith("_")])
            tried = [_relation(sheets, left, right, [a], [b]) for a, b in pairs]
            if not any(r.stats.safe for r in tried):
                for p, q in combinations(pairs[:6], 2):
                    tried.append(_relation(sheets, left, right, [p[0], q[0]], [p[1], q[1]]))
                    if tried[-1].stats.safe:
                        break
            tried = [r for r in tried if r.stats.common_keys]
            if tried:
                found.append(max(tried, key=lambda r: (r.stats.safe, r.stats.coverage or 0, -len(r.left_keys))))
    return sorted(found, key=lambda r: (not r.stats.safe, -(r.stats.coverage or 0)))


def _relation(sheets: dict[str, DataFrame], left: str, right: str, a: list[str], b: list[str]) -> Relation:
    key = lambda names: F.when(_all_known(names), F.struct(*[relation_key(col(n)).alias(f"k{i}") for i, n in enumerate(names)]))
    return Relation(left, right, a, b, RelationStats(**relation_stats(sheets[left], key(a), sheets[right], key(b)).first().asDict()))


def _all_known(names: list[str]) -> Column:
    known = F.lit(True)
    for n in names:
        known = known & relation_key(col(n)).isNotNull()
    return known


def dashboard(sheets: dict[str, DataFrame], relation: Relation, amount: str, label: str, cost: str | None = None, top: int = 10) -> dict[str, DataFrame]:
    """The figures of one relation: matched rows, the top labels of the reference by amount, profit if costs are known."""
    if not relation.stats.safe:
        raise UnsafeJoin(f"{relation.left} and {relation.right} are not safely related")
    joined = safe_left_join(_keyed(sheets[relation.left], relation.left_keys), _keyed(sheets[relation.right], relation.right_keys), [f"_k{i}" for i in range(len(relation.left_keys))], [f"_k{i}" for i in range(len(relation.right_keys))], suffix=relation.right)
    groups = A.group_profit(joined, col(label), col(amount), col(cost) if cost else None)
    quality = joined.agg(F.count("*").alias("rows"), F.count(col(label)).alias("matched"))
    return {"quality": quality, "groups": groups, "top": groups.orderBy(F.desc("net"), "group").limit(top)}


def _keyed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("*", *[relation_key(col(n)).alias(f"_k{i}") for i, n in enumerate(names)])
