"""Values by the name of their field, labels and keys of fields, lenient JSON, elements found again."""

from __future__ import annotations

import difflib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import name_tokens
from .dates import iso_date
from .html import Node, parse
from .numbers import currency_amount
from .texts import company, phone
from .urls import website


def normalized(field: str, value: Column) -> Column:
    """A value in the normal form that its field's name asks for; money is recognised by the value itself."""
    name = field.lower()
    if "date" in name or "founded" in name:
        plain = iso_date(value)
    elif any(w in name for w in ("url", "website", "link")):
        plain = website(value)
    elif "phone" in name or "tel" in name:
        plain = phone(value)
    elif "company" in name or "name" in name:
        plain = company(value)
    else:
        plain = F.btrim(value)
    money = F.contains(value, F.lit("$")) | F.lower(value).rlike("usd|million")
    return F.when(money, currency_amount(value)["amount"].cast("string")).otherwise(plain)


def reference_key(value: Column) -> Column:
    """A reference without corporate form, case and punctuation. Not an identity: different firms can share it."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"\b(inc|llc|corp|ltd|limited|co|pvt|private)\b", ""), "[^a-z0-9]+", "")


def acronym(value: Column) -> Column:
    """The initials of a name of two words or more; else empty."""
    words = F.filter(F.split(F.lower(value), "[^a-z0-9]+"), lambda w: F.length(w) > 1)
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")).otherwise("")


def label_fits(label: str, field: str) -> bool:
    """Whether a printed label names a field: equal, the beginning of it, or two words in common."""
    a, b = name_tokens(label), name_tokens(field)
    return bool(a) and (a == b or a == b[: len(a)] or b == a[: len(b)] or len(set(a) & set(b)) >= 2)


def lenient_json(text: str) -> object:
    """JSON as models write it: plain, in a code fence, or with doubled braces; None if it is none of these."""
    fenced = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", text or "")
    for attempt in (text or "", fenced, fenced.replace("{{", "{").replace("}}", "}")):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    return None


def json_kind(text: Column) -> Column:
    """object, array, string, number, boolean or null by the JSON in a text; null if it is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def html_sample(html: Column, budget: int = 12000) -> Column:
    """The beginning, the middle and the end of a long document."""
    quarter, half = budget // 4, budget // 2
    middle = F.substring(html, (F.length(html) / 2 - half / 2).cast("int"), F.lit(half))
    return F.when(F.length(html) <= budget, html).otherwise(F.concat_ws("\n", F.left(html, F.lit(quarter)), middle, F.right(html, F.lit(quarter))))


def relocate(html: str, snapshot: dict, threshold: float = 0.4, most: int | None = None) -> Node | None:
    """The element most like a remembered one (tag, parent_tag, text, attrs), if any is alike enough; of the first ``most`` elements or all."""

    def likeness(node: Node) -> float:
        ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
        attrs = " ".join(f"{k}={v}" for k, v in sorted(node.attrs.items()))
        wanted = " ".join(f"{k}={v}" for k, v in sorted(snapshot.get("attrs", {}).items()))
        parent = node.parent.tag if node.parent else ""
        return (float(node.tag == snapshot.get("tag")) + float(parent == snapshot.get("parent_tag")) + ratio(node.text()[:200], snapshot.get("text", "")[:200]) + ratio(attrs, wanted)) / 4

    nodes = [n for n in parse(html).walk() if n.tag][:most]
    best = max(nodes, key=likeness, default=None)
    return best if best is not None and likeness(best) >= threshold else None
