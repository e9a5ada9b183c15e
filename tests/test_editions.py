"""Editions add to plans and take nothing away."""

import pytest

from attestra.plans.compiler import Field, Plan
from attestra.plans.editions import Edition, Registry, adopt, problems

VENTURE = Edition(
    "venture", "2", "startup", (Field("startup_name"), Field("round", "string", "last round"), Field("valuation", "number")), ("startup_name",), ("startup_name",), {"round": "funding round", "valuation": "worth"},
    ("https://www.filings.example/x", "news.example"), ("news.example",), ("startup", "funding"), ("valuation > 0",), ("startups with rounds",),
)


def test_a_plan_keeps_what_it_says():
    plan = Plan("goal", "", (Field("round", "date", "own"), Field("city")), phrases={"round": "own words"}, terms=("funding", "seed"))
    got = adopt(plan, VENTURE)
    assert [(f.name, f.type, f.required) for f in got.fields] == [("round", "date", False), ("city", "string", False), ("startup_name", "string", True), ("valuation", "number", False)]
    assert got.entity == "startup" and got.dedupe_keys == ("startup_name",) and got.phrases == {"round": "own words", "valuation": "worth"} and got.terms == ("funding", "seed", "startup")
    assert adopt(got, VENTURE) == got and plan.fields[0].name == "round" and got.edition == "venture@2" and adopt(plan, Edition("generic")).fields == plan.fields
    assert adopt(Plan("g", "firm", (), dedupe_keys=("x",), allowed_sources=("own.example",)), VENTURE).allowed_sources == ("own.example",)


def test_editions_with_problems_are_refused():
    assert problems(VENTURE) == [] and problems(Edition("generic")) == []
    bad = Edition("bad", fields=(Field("a"), Field("a"), Field("B c")), required=("z",), dedupe_keys=("y",), phrases={"No": "x"}, allowed_sources=("nohost", "a b.c"), examples=("", "x"))
    assert problems(bad) == ["a is declared twice", "'B c' is no field name", "'No' is no field name", "required names z, which is not declared", "dedupe_keys names y, which is not declared", "'nohost' is no host", "'a b.c' is no host", "an example is blank"]
    assert problems(Edition("empty")) == ["it adds nothing to a plan"]
    held = Registry(VENTURE)
    assert held.names() == ["generic", "venture"] and held.get(" Venture ") is VENTURE and held.get(None).name == held.get("").name == "generic"
    with pytest.raises(KeyError, match="generic, venture"):
        held.get("other")
    with pytest.raises(ValueError, match="declared twice"):
        held.add(bad)
