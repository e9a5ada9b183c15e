"""Predicates on the stored text of a cell: filled, placeholder, declared type, entity-like."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for "no value".
ABSENCE_WORDS = (
    "na", "n/a", "n.a.", "n.a", "nan", "null", "nil", "none", "unknown",
    "unspecified", "not specified", "not available", "not found",
    "not provided", "not applicable", "not listed", "tbd", "tba", "xxx",
    "no data", "no value", "empty", "missing",
)

#: How a headline begins, and what only a headline says.
HEADLINE_PREFIXES = ("exclusive:", "breaking:", "watch:", "list:", "opinion:", "analysis:", "sponsored:")
HEADLINE_MARKERS = (
    "funding round", "funding deal", "funding record", "series a", "series b",
    "series c", "series d", "seed round",
    "biggest", "largest", "fastest growing", "fastest-growing",
    "raises", "raised", "secures", "lands", "bags", "snags",
    "top 10", "top ten", "best companies", "top companies",
    "shuts down", "files for bankruptcy", "is acquired", "to be acquired",
    "announces", "announcement", "exclusive", "breaking",
)
MOST_NAME_WORDS = 8


def is_filled(text: Column) -> Column:
    """The form of the guarded SQL surface: ASCII letters or digits, and no absence word even inside list brackets."""
    plain = F.lower(F.btrim(text))
    inner = F.lower(F.btrim(F.btrim(text), F.lit("[]()\"' ")))
    return F.coalesce((F.btrim(text) != "") & ~plain.isin(*ABSENCE_WORDS) & ~inner.isin(*ABSENCE_WORDS) & text.rlike("[A-Za-z0-9]"), F.lit(False))


def is_placeholder(text: Column) -> Column:
    """The form of the record API: null, blank, no letter or digit of any script, or an absence word."""
    plain = F.lower(F.btrim(text))
    return F.coalesce((plain == "") | ~text.rlike(r"[\p{L}\p{N}]") | plain.isin(*ABSENCE_WORDS), F.lit(True))


#: The text forms that a declared type accepts.
TYPE_FORMS = {
    "number": r"^\s*~?[$£€¥₹]?\s*-?[0-9][0-9,]*(\.[0-9]+)?\s*([kKmMbBtT]|bn|mn|million|billion|trillion|thousand)?\s*%?\s*$",
    "boolean": r"(?i)^\s*(true|false|yes|no|0|1)\s*$",
    "date": r"(?i)^\s*[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b.*\b(19|20)[0-9]{2}\b",
    "url": r"^https?://\S+$",
}


def type_accepts(text: Column, kind: str) -> Column:
    """Whether the text may stand in a field of this declared type; unknown types accept everything."""
    return F.coalesce(text.rlike(TYPE_FORMS[kind]), F.lit(False)) if kind in TYPE_FORMS else F.lit(True)


def entity_rejection(name: Column) -> Column:
    """Why a value is no entity name, or null; the first rule that holds gives the reason."""
    low = F.lower(F.btrim(name))
    marker = r"\b(" + "|".join(m.replace("-", "[-]") for m in HEADLINE_MARKERS) + r")(es|s)?\b"
    prefixes = "^(" + "|".join(HEADLINE_PREFIXES) + ")"
    return (
        F.when(low.rlike(r"https?://|www\."), "url")
        .when(F.contains(name, F.lit("?")), "question")
        .when(F.left(low, F.lit(12)).rlike(prefixes), "headline prefix")
        .when(low.rlike(marker), "headline marker")
        .when(low.rlike(r"\btop\s*[0-9]+\b"), "top n")
        .when(F.size(F.split(F.btrim(name), r"\s+")) > MOST_NAME_WORDS, "too many words")
    )


#: Words in a field's name that make it an entity field.
ENTITY_WORDS = (
    "company", "companies", "founder", "founders", "startup", "startups",
    "person", "people", "author", "authors", "ceo", "cfo", "cto", "coo",
    "executive", "executives", "team", "member", "members",
    "organisation", "organization", "organisations", "organizations",
    "org", "employer", "employers", "name", "names", "vendor", "supplier",
    "customer", "client", "publisher", "owner", "operator", "agency",
    "investor", "investors", "employee", "employees", "candidate",
)


def name_tokens(field: str) -> list[str]:
    """The words of a camel or snake case name."""
    import re

    return [w.lower() for w in re.split(r"[^A-Za-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", field)) if w]


def is_entity_field(field: str) -> bool:
    return bool(set(name_tokens(field)) & set(ENTITY_WORDS)) or "compan" in field.lower()


def is_identity_field(field: str) -> bool:
    low = field.lower()
    return low in {"name", "title", "company", "organization", "organisation", "entity"} or low.endswith(("_name", "_names", "_title"))


def display_text(value: Column, limit: int = 160) -> Column:
    """A cell's text as shown: longer ones end in an ellipsis within ``limit``."""
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit - 1)), F.lit("…"))).otherwise(value)


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet will not run as a formula; null is empty."""
    filled = F.coalesce(text, F.lit(""))
    return F.when(filled.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), filled)).otherwise(filled)
