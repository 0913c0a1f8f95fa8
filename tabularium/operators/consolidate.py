"""Consolidation: a primary table keeps its rows; supplements, codebooks and declared derivations add columns."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.functions.names import col
from tabularium.functions.roles import spaced
from tabularium.functions.text import code, norm_key
from tabularium.operators.labels import codebook, derive, recode
from tabularium.operators.reshape import fill_down


@dataclass(frozen=True)
class Supplement:
    """A table whose columns are added by keys; keys that repeat in it are ambiguous and add nothing."""

    name: str
    frame: DataFrame
    keys: dict[str, str]  # primary's column -> supplement's
    columns: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Equivalence:
    """A code table for one column of the result."""

    column: str
    frame: DataFrame
    code: str
    label: str


@dataclass(frozen=True)
class Consolidated:
    frame: DataFrame
    report: DataFrame  # (source, check, rows)
    status: str


def free_name(taken: list[str], name: str, prefix: str) -> str:
    """The name, with the prefix where it is taken, with a number where that is too."""
    low, tried, n = {t.lower() for t in taken}, name, 1
    if tried.lower() in low:
        tried = f"{prefix}_{name}"
    while tried.lower() in low:
        n += 1
        tried = f"{prefix}_{name}_{n}"
    return tried


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", spaced(text)).strip("-")


def stable_hash(payload: object) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()


def clean_key(column: str):
    return F.coalesce(F.trim(col(column).cast("string")), F.lit(""))


def enrich(primary: DataFrame, supplement: Supplement) -> tuple[DataFrame, dict[str, str]]:
    """primary with the supplement's columns, as many rows as before, and how the columns are called."""
    wanted = supplement.columns or [c for c in supplement.frame.columns if c not in supplement.keys.values()]
    names: dict[str, str] = {}
    for c in wanted:
        names[c] = free_name([*primary.columns, *names.values()], c, slug(supplement.name))
    theirs = F.struct(*[clean_key(c) for c in supplement.keys.values()])
    once = supplement.frame.groupBy(theirs.alias("_key")).agg(F.count("*").alias("_n"), *[F.first(c).alias(n) for c, n in names.items()]).where("_n = 1").drop("_n")
    parts = [clean_key(c) for c in supplement.keys]
    mine = F.when(~F.concat_ws("", *parts).eqNullSafe(F.lit("")), F.struct(*parts))
    return primary.withColumn("_mine", mine).join(once, F.col("_mine") == F.col("_key"), "left").drop("_mine", "_key"), names


def consolidate(primary: DataFrame, supplements: list[Supplement], equivalences: list[Equivalence], derivations: dict[str, tuple[str, str, str | list[str]]] | None = None) -> Consolidated:
    """The primary's rows with everything added, a report of what did not match, and a status.

    derivations: new column -> (source column, operation, operand). CERTIFIED if all matched, else VALID_WITH_WARNINGS.
    """
    out, checks = primary, []
    for s in supplements:
        out, names = enrich(out, s)
        keys = s.frame.groupBy(*[clean_key(c) for c in s.keys.values()]).agg(F.count("*").alias("n"))
        checks.append(keys.where("n > 1").agg(F.lit(s.name).alias("source"), F.lit("ambiguous_keys").alias("check"), F.count("*").alias("rows")))
        empty = F.coalesce(*[col(n).cast("string") for n in names.values()]).isNull()
        checks.append(out.agg(F.lit(s.name).alias("source"), F.lit("unmatched_rows").alias("check"), F.count(F.when(empty, 1)).alias("rows")))
    for e in equivalences:
        out = recode(out, e.column, codebook(e.frame, e.code, e.label), f"{e.column}_label")
        status = col(f"{e.column}_label_status")
        checks.append(out.agg(F.lit(e.column).alias("source"), F.lit("codes_without_label").alias("check"), F.count(F.when(status.isin("unmapped", "conflict"), 1)).alias("rows")))
    for name, (column, operation, operand) in (derivations or {}).items():
        out = out.withColumn(name, derive(col(column), operation, operand))
    report = primary.agg(F.lit("primary").alias("source"), F.lit("rows").alias("check"), F.count("*").alias("rows"))
    for check in checks:
        report = report.union(check)
    troubled = report.where("check <> 'rows' AND rows > 0").limit(1).count()
    return Consolidated(out, report, "VALID_WITH_WARNINGS" if troubled else "CERTIFIED")


def keys_seen_once(frame: DataFrame, key: str, authority: DataFrame, authority_key: str) -> DataFrame:
    """Rows of frame whose key the authority knows and that stand there once."""
    known = frame.join(authority.select(col(authority_key).alias("_k")).distinct(), col(key) == F.col("_k"), "left_semi")
    once = known.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(col(key).alias("_k"))
    return known.join(once, col(key) == F.col("_k"), "left_semi")


def null_reasons(frame: DataFrame, columns: list[str], reasons: dict[str, str]) -> DataFrame:
    """(column, nulls, reason) of the columns that have nulls."""
    wide = frame.agg(*[F.count(F.when(col(c).isNull(), 1)).alias(c) for c in columns])
    known = F.create_map(*[F.lit(x) for p in (reasons or {"": ""}).items() for x in p])
    return wide.unpivot([], columns, "column", "nulls").where("nulls > 0").withColumn("reason", F.coalesce(F.try_element_at(known, F.col("column")), F.lit("sin_clasificar")))


def cohort_ids(frame: DataFrame, ids: str, cohort: str, to: str = "cohort_id") -> DataFrame:
    """frame with cohort:id, which must be there and differ in every row."""
    out = frame.withColumn(to, F.concat_ws(":", F.lit(cohort), F.nullif(F.trim(col(ids).cast("string")), F.lit(""))))
    bad = frame.groupBy(F.trim(col(ids).cast("string")).alias("k")).count().where("k IS NULL OR k = '' OR count > 1")
    if bad.limit(1).count():
        raise ValueError("ids of a cohort must be there and be unique")
    return out


# ---- contracts of cohorts


def target_columns(template: list[str], required: tuple[str, ...] = ()) -> list[str]:
    """A template's columns, trimmed; empty or repeated names, or a missing required one, are refused."""
    columns = [str(c).strip() for c in template]
    if not columns or "" in columns or len(columns) != len(set(columns)):
        raise ValueError("the template has empty or repeated columns")
    if missing := sorted(set(required) - set(columns)):
        raise ValueError(f"the template lacks {', '.join(missing)}")
    return columns


def shaped(df: DataFrame, columns: list[str], numbers: set[str]) -> DataFrame:
    """df in the template's columns and order: numbers as doubles (null where they are none), others as text; absent ones null."""
    have = set(df.columns)
    cell = lambda c: col(c) if c in have else F.lit(None).cast("string")
    return df.select(*[(cell(c).cast("string").try_cast("double") if c in numbers else cell(c).cast("string")).alias(c) for c in columns])


def contract_issues(annual: DataFrame, expected_rows: int, columns: list[str], key: str, cohort_column: str, cohort: int) -> DataFrame:
    """(code, rows) of what a year's result breaks: its rows, its columns, repeated keys, other cohorts."""
    number = col(cohort_column).cast("string").try_cast("double")
    by_key = annual.groupBy(F.trim(col(key).cast("string")).alias("k")).agg(F.count("*").alias("n"), F.count(F.when(number == cohort, 1)).alias("good"))
    s = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"), F.coalesce(F.sum(F.col("n") - F.col("good")), F.lit(0)).alias("other"))
    found = [
        ("row_count_changed", F.abs(F.col("rows") - expected_rows)), ("target_schema_mismatch", F.lit(int(annual.columns != list(columns)))), ("duplicate_key", F.col("repeated")), ("invalid_cohort", F.col("other")),
    ]
    made = F.array(*[F.struct(F.lit(code).alias("code"), n.cast("long").alias("rows")) for code, n in found])
    return s.select(F.inline(F.filter(made, lambda x: x["rows"] > 0)))


def idempotency_key(project: str, configuration: str, sources: list[dict]) -> str:
    """The same for the same project, configuration and sources in whatever order."""
    listed = [{k: s.get(k) for k in ("role", "dataset_id", "selected_sheet", "configuration")} for s in sources]
    return stable_hash({"project_id": project, "config_hash": configuration, "sources": sorted(listed, key=lambda s: (str(s["role"]), str(s["dataset_id"])))})


def inline_codebook(rows: DataFrame, variable: str, variable_column: str, detail_column: str, row: str) -> DataFrame:
    """(code, label, conflict) of one variable of a book that lists "1. Label" below each variable's name.

    A variable's section ends where the next one starts; sections are found by filling names down.
    """
    known = rows.select(col(row).alias("_r"), F.nullif(F.trim(col(variable_column)), F.lit("")).alias("_v"), col(detail_column).alias("_d"))
    filled = fill_down(known, "_v", "_r").where(norm_key(F.col("_v")) == norm_key(F.lit(variable)))
    pattern = r"^\s*([^\s.)-]+)\s*[.)-]\s*(.+?)\s*$"
    listed = filled.where(F.col("_d").rlike(pattern)).select(code(F.regexp_extract("_d", pattern, 1)).alias("code"), F.regexp_extract("_d", pattern, 2).alias("label"))
    return codebook(listed, "code", "label")


def detect_source(columns: list[str], roles: dict[str, tuple[set[str], set[str]]]) -> str | None:
    """The role whose required columns are all there and whose signature matches most; None if two do alike."""
    have = {norm(c) for c in columns}
    scored = sorted(((len({norm(c) for c in signature} & have), name) for name, (required, signature) in roles.items() if {norm(c) for c in required} <= have), reverse=True)
    return None if not scored or len(scored) > 1 and scored[0][0] == scored[1][0] else scored[0][1]


def missing_columns(columns: list[str], required: set[str], aliases: dict[str, str] | None = None) -> list[str]:
    """Required columns that neither the source nor an alias has."""
    have = {norm(c) for c in columns}
    have |= {norm(to) for name, to in (aliases or {}).items() if norm(name) in have}
    return sorted(r for r in required if norm(r) not in have)


def norm(name: str) -> str:
    return slug(name).replace("-", "_")


def looks_like_codes(df: DataFrame) -> bool:
    """Whether a sheet of two columns translates codes: one is named as a code, the other as a label, and one is nearly unique."""
    own = [c for c in df.columns if not c.startswith("_")]
    if len(own) != 2:
        return False
    says = lambda words: any(any(w in norm(c) for w in words) for c in own)
    if not (says(("cod", "id", "clave")) and says(("desc", "nombre", "label", "detalle"))):
        return False
    seen = df.agg(F.count("*").alias("n"), *[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(own)]).first()
    return seen["n"] > 0 and max(seen["d0"], seen["d1"]) >= 0.9 * seen["n"]


def common_keys(base: list[str], related: list[str], most: int = 3) -> list[tuple[str, str]]:
    """Columns of the same name in both, those that look like keys first; a short suggestion for a person."""
    a, b = {norm(c): c for c in base}, {norm(c): c for c in related}
    keyed = lambda n: not any(w in n for w in ("id", "cod", "rut", "clave"))
    return [(a[n], b[n]) for n in sorted(set(a) & set(b), key=lambda n: (keyed(n), n))[:most]]
