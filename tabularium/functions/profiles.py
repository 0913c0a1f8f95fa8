"""What a sheet's headers say it is: sales, a list of products, or another operation whose amounts are no sales."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tabularium.functions.roles import compact, detect_roles, spaced


@dataclass(frozen=True)
class Profile:
    """A kind of sheet: of each group one marker stands in some header; no marker of ``none`` does; roles are there or not."""

    kind: str
    groups: tuple[tuple[str, ...], ...]
    none: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    no_roles: tuple[str, ...] = ()
    most_columns: int = 1_000_000

    def fits(self, names: set[str], roles: dict[str, str]) -> bool:
        says = lambda marker: marker[1:] in names if marker.startswith("=") else any(marker in n for n in names)
        return (
            len(names) <= self.most_columns and all(any(map(says, group)) for group in self.groups) and not any(map(says, self.none))
            and all(r in roles for r in self.roles) and not any(r in roles for r in self.no_roles)
        )


_OT, _TECHNICIAN, _CONTRACT = ("=not", "numeroot", "nroot", "ordentrabajo"), ("codtecnico", "idtecnico"), ("codcontrato", "idcontrato")
# Profiles in the order in which they are asked; after "=" a marker is a whole compact header.
SERVICE_PROFILES = (
    Profile("detalle_ot", (_OT, ("tipolinea", "tipodelinea", "tipodetalle"), ("cantidad", "preciounitario", "monto"))),
    Profile("horas_tecnicos", (_OT, _TECHNICIAN, ("horas", "horanormal", "horaextra"))),
    Profile("tarifas_tecnicos", (_TECHNICIAN, ("valorhoraventa", "tarifaventa"), ("costohora", "costohorario"))),
    Profile("tecnicos", (_TECHNICIAN, ("nombretecnico", "especialidad", "tecnico")), none=_OT),
    Profile("ordenes_trabajo", (_OT, ("estado",), ("cliente", "codcliente", "supervisor", "fechaapertura")), none=("tipolinea", "horas")),
    Profile("cuotas_contrato", (_CONTRACT, ("periodo",), ("monto",), ("estado", "moneda"))),
    Profile("contratos", (_CONTRACT, ("montomensual", "valorcontrato"), ("vigenciadesde", "fechadesde", "vigenciahasta", "fechahasta"))),
    Profile("valor_uf", (("valoruf", "ufclp"), ("periodo", "fecha")), most_columns=6),
    Profile("gastos_estructura", (("idarea", "codarea"), ("conceptogasto",), ("tipogasto",), ("periodo",), ("monto",))),
    Profile("items", (("coditem", "iditem"), ("descripcion", "nombreitem", "unidad")), none=_OT),
)
OTHER_PROFILES = (
    Profile("compras", (("idcompra", "fechacompra", "totalcompra", "montonetocompra"), ("proveedor", "costounitariocompra", "estadorecepcion"))),
    Profile("gastos", (("idgasto", "fechagasto", "totalgasto", "categoriagasto"), ("tipogasto", "estadogasto", "proveedor"))),
    Profile("cobranzas", (("idpago", "idcobranza", "fechapago", "montopago", "montopagado"), ("estadopago", "estadocobranza", "documento"))),
    Profile("metas", (("metaventa", "metamargen", "metanuevosclientes"),)), Profile("metas", (("meta",),), roles=("sucursal",)),
    Profile("inventario", (("valorinventario",),)), Profile("inventario", (("stockminimo",), ("stocksistema", "stockfisico", "stockdisponible"))),
    Profile("historial_costos", (("mesvigencia", "fechadesde", "vigenciadesde", "effectivefrom"),), roles=("costo", "producto")),
    Profile("proveedores", (("idproveedor",),), none=("idcompra", "idgasto"), no_roles=("producto",)),
    Profile("trabajadores", (("idvendedor", "idtrabajador", "idempleado"), ("cargo", "comision", "sueldo", "salario"))),
    Profile("clientes", (("idcliente",),), none=("idventa", "idpago", "fechaventa", "montoventa", "tipomovimiento", "venta", "ingreso", "facturacion")),
    Profile("sucursales", (("idsucursal",),), none=("idventa", "idcompra", "idgasto", "idpago", "sku")),
    Profile("productos", (), none=("idventa", "idcompra", "cantidadvendida", "montoventa"), roles=("producto",), no_roles=("monto",)),
)
SALE_IDS = ("idventa", "idtransaccion", "numeroventa", "numeroboleta", "numerofactura")
SALE_WORDS = {"venta", "ventas", "ingreso", "ingresos", "factura", "revenue", "sales"}
AMOUNT_WORDS = {"monto", "venta", "ventas", "ingreso", "ingresos", "importe", "facturacion", "revenue", "sales"}
TRADE_DATES = ("venta", "operacion", "transaccion", "factura", "boleta", "pedido", "orden", "emision", "sale", "transaction", "operation", "invoice", "order", "compra", "purchase")
RECORD_DATES = ("actualizacion", "creacion", "modificacion", "vigencia", "carga", "update", "created", "creation", "modified", "effective", "alta", "registro")


def _words(name: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", spaced(name)))


def other_kind(columns: list[str], roles: dict[str, str] | None = None) -> str | None:
    """The operation that the headers describe and that is no sale; services are asked first. None without enough evidence."""
    roles, names = detect_roles(columns) if roles is None else roles, {compact(c) for c in columns}
    return next((p.kind for p in (*SERVICE_PROFILES, *OTHER_PROFILES) if p.fits(names, roles)), None)


def is_catalogue(columns: list[str], roles: dict[str, str] | None = None) -> bool:
    """A list of products with list prices or unit costs, without a trade's date, document or amount of its own."""
    roles = detect_roles(columns) if roles is None else roles
    listed = {c for c in columns if {"precio", "lista"} <= _words(c) or "costo" in _words(c) and ("unit" in spaced(c) or "por unidad" in spaced(c))}
    if not listed or "producto" not in roles:
        return False
    names, dated = {compact(c) for c in columns}, roles.get("fecha")
    trade = lambda c: any(w in spaced(c) for w in TRADE_DATES)
    is_date = lambda c: c == dated or any(w in spaced(c) for w in ("fecha", "date", "periodo"))
    recorded = dated is not None and any(w in spaced(dated) for w in RECORD_DATES) and not trade(dated)
    own_amount = any(c not in listed and c != roles.get("costo") and _words(c) & AMOUNT_WORDS and not any(w in spaced(c) for w in ("unidad venta", "unidad compra")) for c in columns)
    traded = any(is_date(c) and trade(c) for c in columns) or dated is not None and not recorded or any(i in n for n in names for i in (*SALE_IDS, "idcompra", "numerocompra"))
    return not traded and not own_amount and roles.get("monto") in (None, *listed)


def is_sales(columns: list[str], roles: dict[str, str] | None = None) -> bool:
    """Whether amounts are sales: by a sale's id or an unmistakable amount, else by quantity and product, or date and cost."""
    roles = detect_roles(columns) if roles is None else roles
    if "monto" not in roles or is_catalogue(columns, roles):
        return False
    amount, other = _words(roles["monto"]), other_kind(columns, roles)
    clear = bool(amount & SALE_WORDS) or {"monto", "neto"} <= amount or any(i in compact(c) for c in columns for i in SALE_IDS)
    if other in {p.kind for p in SERVICE_PROFILES} or other is not None and not clear:
        return False
    few = len(columns) <= 2 and ("fecha" in roles or "producto" in roles)
    return clear or few or {"cantidad", "producto"} <= roles.keys() or {"fecha", "costo"} <= roles.keys()
