"""Plans: from a question to fields and queries by rule, what a plan costs, which tool answers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..functions.cells import is_identity_field, name_tokens

#: Caps of a plan and the price of a step in credits.
MOST_FIELDS, MOST_REQUIRED, MOST_QUERIES = 12, 2, 5
PRICES = {"plan": 1, "search": 1, "page": 3, "export": 1}
#: Words that name what is asked for, and words that ask for a change.
INTENTS = {
    "backfill": ("fill", "missing", "complete", "backfill"),
    "refresh": ("refresh", "update", "recheck", "stale"),
    "add_column": ("add", "column", "field", "new"),
    "dedupe": ("duplicate", "duplicates", "merge", "dedupe"),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    description: str = ""
    required: bool = False


@dataclass(frozen=True)
class Plan:
    goal: str
    entity: str
    fields: tuple[Field, ...]
    search_queries: tuple[str, ...] = ()
    dedupe_keys: tuple[str, ...] = ()
    phrases: dict[str, str] = field(default_factory=dict)
    allowed_sources: tuple[str, ...] = ()
    seed_domains: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    edition: str = ""


def compile_plan(prompt: str) -> Plan:
    """A plan without a model: "<entities> with <field>, <field> and <field>"."""
    text = " ".join(prompt.split())
    head, _, rest = text.partition(" with ")
    names = [re.sub(r"[^a-z0-9]+", "_", n.strip().lower()).strip("_") for n in re.split(r",| and ", rest) if n.strip()]
    words = re.findall(r"[A-Za-z]+", head)
    entity = words[-1].lower().rstrip("s") if words else "item"
    return finalize(Plan(text, entity, tuple(Field(n) for n in dict.fromkeys([f"{entity}_name", *names]))))


def finalize(plan: Plan) -> Plan:
    """At most MOST_FIELDS fields with valid names, only identity required, queries and keys filled in."""
    kept, required = [], 0
    for f in plan.fields:
        if not re.fullmatch(r"[a-z0-9_]+", f.name) or len(kept) == MOST_FIELDS:
            continue
        need = is_identity_field(f.name) and required < MOST_REQUIRED
        required += need
        kept.append(replace(f, required=need))
    queries = plan.search_queries or tuple(dict.fromkeys([plan.goal, *(f"{plan.entity} {plan.phrases.get(f.name, f.name.replace('_', ' '))}" for f in kept[1:3])]))
    keys = plan.dedupe_keys or tuple(f.name for f in kept if is_identity_field(f.name))[:1]
    return replace(plan, fields=tuple(kept), search_queries=queries[:MOST_QUERIES], dedupe_keys=keys)


def apply_profile(plan: Plan, fields: list[Field], phrases: dict[str, str]) -> Plan:
    """Domain fields and phrases added to a plan; twice is as once."""
    have = {f.name for f in plan.fields}
    return finalize(replace(plan, fields=(*plan.fields, *(f for f in fields if f.name not in have)), phrases={**phrases, **plan.phrases}))


def diff(old: Plan, new: Plan) -> dict[str, list[str]]:
    """Fields added, removed and changed; equal plans are an error."""
    a, b = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}
    out = {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "changed": sorted(n for n in a.keys() & b.keys() if a[n] != b[n])}
    if not any(out.values()):
        raise ValueError("the plans do not differ")
    return out


def union(existing: list[str], extra: list[str]) -> list[str]:
    return [x for x in dict.fromkeys([*existing, *extra]) if x.strip()]


def cost(plan: Plan, pages: int) -> int:
    return PRICES["plan"] + PRICES["search"] * len(plan.search_queries) + PRICES["page"] * pages + PRICES["export"]


def affordable_pages(budget: int, spent: int) -> int:
    return max(0, (budget - spent - PRICES["export"]) // PRICES["page"])


def classify(question: str) -> tuple[str, float]:
    """What a question asks for: an action needs one of its words and no question mark; ties by the order of INTENTS."""
    if question.strip().endswith("?"):
        return "query", 1.0
    words = set(name_tokens(question))
    scores = {k: len(words & set(v)) / 2 for k, v in INTENTS.items()}
    best = max(scores, key=lambda k: scores[k])
    return (best, min(1.0, scores[best])) if scores[best] else ("query", 0.5)


#: Stages of a run and what may follow each.
STAGES = ("PLANNING", "DISCOVERING", "FETCHING", "REDUCING", "EXTRACTING", "VALIDATING", "DEDUPLICATING", "FINALIZING", "COMPLETED")


def legal(before: str, after: str) -> bool:
    """Stages follow in order; any open stage may fail or be cancelled."""
    if after in ("FAILED", "CANCELLED"):
        return before not in ("COMPLETED", "FAILED", "CANCELLED")
    return before in STAGES[:-1] and STAGES.index(after) == STAGES.index(before) + 1 if after in STAGES and before in STAGES else False


def grounded(figures: list[dict], results: list[float]) -> list[dict]:
    """The figures of an answer that its results hold: equal numbers, or percentages within 1.0 of a ratio of two results."""
    ratios = [100.0 * a / b for a in results for b in results if b]
    return [f for f in figures if f["value"] in results or (f.get("unit") == "%" and any(abs(f["value"] - r) <= 1.0 for r in ratios))]
