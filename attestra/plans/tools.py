"""Named tools over a dataset: each is a DataFrame function; a plan names at most four of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage, hosts, profile, records

Tool = Callable[..., DataFrame]


def _coverage(cells: DataFrame, declared: DataFrame, **_) -> DataFrame:
    return coverage.field_coverage(cells, declared)


def _conflicts(cells: DataFrame, declared: DataFrame, limit: int = 10, **_) -> DataFrame:
    return coverage.conflicts(cells).orderBy("dataset_id", "record_id", "field").limit(limit)


def _gaps(cells: DataFrame, declared: DataFrame, limit: int = 12, **_) -> DataFrame:
    return coverage.gaps(coverage.field_coverage(cells, declared)).limit(limit)


def _sources(cells: DataFrame, declared: DataFrame, limit: int = 12, **_) -> DataFrame:
    return hosts.yield_by_host(cells).orderBy(F.desc("verified"), F.desc("records"), "host").limit(limit)


def _values(cells: DataFrame, declared: DataFrame, field: str = "", limit: int = 12, **_) -> DataFrame:
    return profile.value_counts(cells.filter(F.col("field") == field), min(12, limit))


def _where(cells: DataFrame, declared: DataFrame, conditions: list | None = None, limit: int = 10, **_) -> DataFrame:
    return records.records_where(records.documents_of(cells), [tuple(c) for c in conditions or []]).orderBy("record_id").limit(min(10, limit))


def _facts(cells: DataFrame, declared: DataFrame, **_) -> DataFrame:
    return coverage.verdict_totals(coverage.field_coverage(cells, declared))


TOOLS: dict[str, Tool] = {"facts": _facts, "coverage": _coverage, "conflicts": _conflicts, "gaps": _gaps, "sources": _sources, "value_counts": _values, "records_where": _where}


def validate_plan(calls: list[dict], fields: list[str]) -> list[dict]:
    """The known calls of a plan, four at most, facts first; fields that the dataset lacks are dropped."""
    good = [c for c in calls if c.get("tool") in TOOLS and (not c.get("args", {}).get("field") or c["args"]["field"] in fields)]
    return [{"tool": "facts", "args": {}}, *(c for c in good if c["tool"] != "facts")][:4]


def answer(cells: DataFrame, declared: DataFrame, calls: list[dict]) -> dict[str, DataFrame]:
    fields = [r[0] for r in declared.select("field").distinct().collect()]
    return {f"{i}:{c['tool']}": TOOLS[c["tool"]](cells, declared, **c.get("args", {})) for i, c in enumerate(validate_plan(calls, fields))}
