"""Text normalisation as native expressions: accents, comparison keys, join keys, tax ids."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that a combining accent makes, by rule: Latin-1 and the first Latin extensions, to their base letter.
_ACCENTED = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))) > 1]
ACCENTED = "".join(c for c in _ACCENTED if sum(not unicodedata.combining(x) for x in unicodedata.normalize("NFKD", c)) == 1)
BARE = "".join(unicodedata.normalize("NFKD", c)[0] for c in ACCENTED)

# Tokens that stand for a missing value, abbreviations of company forms, placeholders by role.
MISSING = ("", "-", "--", "n/a", "na", "null", "none", "s/i", "sin dato")
COMPANY_FORMS = {"limitada": "ltda", "sociedadanonima": "sa", "socanon": "sa", "sociedadporacciones": "spa", "empresaindividual": "eirl"}
PLACEHOLDERS = ("-", "--", ".", "?", "xx", "n/a", "n/d", "s/i", "sin dato", "sin informacion", "(vacio)", "0000-00-00")
CUSTOMER_PLACEHOLDERS = ("sin nombre", "cliente desconocido", "sin identificar", "no informa")
ABBREVIATIONS = {"stgo": "santiago", "avda": "avenida", "av": "avenida", "sta": "santa", "sto": "santo", "gral": "general"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain(text: Column) -> Column:
    """Without accents, lower case, trimmed."""
    bare = F.translate(F.regexp_replace(text.cast("string"), r"\p{M}+", ""), ACCENTED, BARE)
    return F.lower(F.trim(bare))


def norm_key(text: Column) -> Column:
    """Letters a-z and digits alone."""
    return F.regexp_replace(plain(text), "[^a-z0-9]", "")


def company_key(text: Column) -> Column:
    """norm_key with company forms abbreviated."""
    key = norm_key(text)
    for full, short in COMPANY_FORMS.items():
        key = F.replace(key, F.lit(full), F.lit(short))
    return key


def is_missing(text: Column) -> Column:
    """Null, or a token that stands for a missing value."""
    return text.isNull() | F.lower(F.trim(text.cast("string"))).isin(*MISSING)


def is_blank(text: Column) -> Column:
    """Physically empty: null or white space."""
    return text.isNull() | (F.trim(text.cast("string")) == "")


def is_placeholder(text: Column, role: str | None = None, kind: str = "texto") -> Column:
    """A written mark for "no data": unmistakable ones anywhere, a role's own, ambiguous ones in number and date columns."""
    value = plain(text)
    found = value.isin(*PLACEHOLDERS)
    if role == "cliente":
        found = found | value.isin(*CUSTOMER_PLACEHOLDERS)
    if kind in ("numero", "fecha"):
        found = found | F.lower(F.trim(text)).isin(*MISSING)
    return ~is_blank(text) & F.coalesce(found, F.lit(False))


def _code_key(value: Column) -> Column:
    """Codes without zero padding after their letters; months as yyyy-mm."""
    code, month = r"^([a-z][a-z0-9 ._/\-]*?[-_/ ]?)0*(\d+)$", r"^(\d{4})[-/](\d{1,2})$"
    number = F.regexp_extract(value, month, 2)
    known = value.rlike(month) & number.try_cast("int").between(1, 12)
    return F.when(known, F.concat(F.regexp_extract(value, month, 1), F.lit("-"), F.lpad(number, 2, "0"))).otherwise(F.regexp_replace(value, code, "$1$2"))


def relation_key(text: Column) -> Column:
    """Key for relating sheets: null where missing; inner spaces stay."""
    return F.when(~is_missing(text), _code_key(plain(text)))


def entity_key(text: Column) -> Column:
    """Key for entities of the business model: spaces collapse, null only where blank."""
    value = F.regexp_replace(plain(text), r"\s+", " ")
    return F.nullif(_code_key(value), F.lit(""))


def composite_key(*texts: Column) -> Column:
    """A struct of relation keys, null if any part is missing."""
    parts = [relation_key(t) for t in texts]
    complete = parts[0].isNotNull()
    for part in parts[1:]:
        complete = complete & part.isNotNull()
    return F.when(complete, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))


def code(text: Column) -> Column:
    """Trimmed, without the .0 that spreadsheets add to whole numbers."""
    return F.regexp_replace(F.trim(text), r"^(\d+)\.0$", "$1")


def expanded(text: Column) -> Column:
    """norm words with local abbreviations written out."""
    words = F.split(F.regexp_replace(plain(text), "[^a-z0-9 ]", ""), " +")
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def label(text: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(fallback))


def safe_cell(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula, with an apostrophe before it."""
    return F.when(F.ltrim(text).rlike(r"^[=+@\-]"), F.concat(F.lit("'"), text)).otherwise(text)


def rut(text: Column) -> Column:
    """Canonical tax id body-digit, null where the structure is wrong."""
    compact = F.upper(F.regexp_replace(F.trim(text), r"[.\s\-]", ""))
    body = F.regexp_replace(compact, r"^0*(\d+)[0-9K]$", "$1")
    good = compact.rlike(r"^\d{1,9}[0-9K]$") & ~compact.rlike(r"^0+[0-9K]$")
    return F.when(good, F.concat_ws("-", body, F.right(compact, F.lit(1))))


def rut_digit(body: Column) -> Column:
    """Check digit of a tax id's body, modulo 11 with weights 2 to 7 from the right."""
    digits = F.reverse(F.split(body, ""))
    weighed = F.transform(digits, lambda d, i: d.try_cast("int") * (i % 6 + 2))
    rest = 11 - F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 11
    return F.when(rest == 11, "0").when(rest == 10, "K").otherwise(rest.cast("string"))


def rut_valid(text: Column) -> Column:
    canonical = rut(text)
    return F.coalesce(rut_digit(F.split_part(canonical, F.lit("-"), F.lit(1))) == F.split_part(canonical, F.lit("-"), F.lit(2)), F.lit(False))


def rut_masked(canonical: Column) -> Column:
    return F.regexp_replace(canonical, r"^(\d{1,3}?)(\d{6}|\d{0,5})-([0-9K])$", "$1.***.***-$3")


#: Text whose Latin-1 characters, as bytes, are well-formed UTF-8.
UTF8_AS_LATIN = (
    r"^(?:[\x{00}-\x{7F}]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}"
    r"|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2})*+$"
)


def mojibake_repaired(text: Column) -> Column:
    """UTF-8 text that was read as Latin-1, read again; only where all of it is well-formed that way."""
    broken = text.rlike(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]") & text.rlike(UTF8_AS_LATIN)
    return F.when(broken, F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")).otherwise(text)
