"""Editions: what a field of business adds to a plan. They only add, and adding one twice is adding it once."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field, replace

from .compiler import Field, Plan

#: The edition that adds nothing, and forms of names and hosts.
GENERIC = "generic"
NAME = re.compile(r"[a-z][a-z0-9_]*")
HOST = re.compile(r"(?:https?://)?(?:www\.)?([a-z0-9-]+(?:\.[a-z0-9-]+)+)(?:/.*)?")


@dataclass(frozen=True)
class Edition:
    name: str
    version: str = "1"
    entity: str = ""
    fields: tuple[Field, ...] = ()
    required: tuple[str, ...] = ()
    dedupe_keys: tuple[str, ...] = ()
    phrases: dict[str, str] = field(default_factory=dict)
    allowed_sources: tuple[str, ...] = ()
    seed_domains: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    examples: tuple[str, ...] = ()


def both(first: tuple[str, ...], then: tuple[str, ...]) -> tuple[str, ...]:
    """The first list and what the second adds to it, in order."""
    return tuple(dict.fromkeys([*first, *then]))


def adopt(plan: Plan, edition: Edition) -> Plan:
    """The plan with an edition: what the plan says itself stays, required fields become required, lists are joined."""
    have = {f.name for f in plan.fields}
    fields = [*plan.fields, *(f for f in edition.fields if f.name not in have)]
    return replace(
        plan, entity=plan.entity or edition.entity, fields=tuple(replace(f, required=True) if f.name in edition.required else f for f in fields), dedupe_keys=plan.dedupe_keys or edition.dedupe_keys,
        phrases={**edition.phrases, **plan.phrases}, allowed_sources=plan.allowed_sources or edition.allowed_sources, seed_domains=both(plan.seed_domains, edition.seed_domains), terms=both(plan.terms, edition.terms),
        rules=both(plan.rules, edition.rules), edition=f"{edition.name}@{edition.version}",
    )


def problems(edition: Edition) -> list[str]:
    """Everything that keeps an edition from being used."""
    names = [f.name for f in edition.fields]
    found = [f"{n} is declared twice" for n, k in Counter(names).items() if k > 1]
    found += [f"{n!r} is no field name" for n in [*dict.fromkeys(names), *edition.phrases] if not NAME.fullmatch(n)]
    found += [f"{what} names {n}, which is not declared" for what, listed in (("required", edition.required), ("dedupe_keys", edition.dedupe_keys)) for n in listed if n not in names]
    found += [f"{s!r} is no host" for s in edition.allowed_sources if not HOST.fullmatch(s.strip().lower())]
    found += ["an example is blank"] * any(not e.strip() for e in edition.examples)
    if edition.name != GENERIC and not (names or edition.phrases or edition.allowed_sources or edition.rules):
        found.append("it adds nothing to a plan")
    return found


class Registry:
    """Editions by name; the generic one is always there, and one with problems is refused."""

    def __init__(self, *editions: Edition):
        self._held = {GENERIC: Edition(GENERIC)}
        for e in editions:
            self.add(e)

    def add(self, edition: Edition) -> None:
        if found := problems(edition):
            raise ValueError(f"edition {edition.name}: {'; '.join(found)}")
        self._held[edition.name] = edition

    def names(self) -> list[str]:
        return sorted(self._held)

    def get(self, name: str | None) -> Edition:
        """An edition by name, whatever its case; none is the generic one, an unknown one an error that names those there are."""
        wanted = (name or GENERIC).strip().lower()
        if wanted not in self._held:
            raise KeyError(f"there is no edition {name!r}; there are {', '.join(self.names())}")
        return self._held[wanted]
