"""Maintenance of stored datasets: backfill, refresh and rejudging. Nothing is written; changes are returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_placeholder
from ..operators import coverage, dedupe, verify


class RefusedMaintenance(RuntimeError):
    """Nothing was done, for the reason given."""


def backfill(cells: DataFrame, extracted: DataFrame, keys: list[str], declared: DataFrame, include_partial: bool = False) -> DataFrame:
    """Cells of ``extracted`` (identity columns, field, new_value) for empty cells of the stored records of equal identity.

    The first stored record of an identity is filled, the first extraction of a cell counts, filled cells never change.
    """
    if not keys:
        raise RefusedMaintenance("no identity keys")
    targets = coverage.absent_fields(coverage.field_coverage(cells, declared), include_partial)
    names = cells.filter(F.col("field").isin(keys)).groupBy("dataset_id", "record_id").pivot("field", keys).agg(F.first("value"))
    matched, _ = dedupe.identity_join(extracted.filter(~is_placeholder(F.col("new_value"))), names, keys, "record_id")
    first = matched.join(targets.select("field").distinct(), "field", "left_semi").groupBy("matched_id", "field").agg(F.min("new_value").alias("new_value"))
    filled = cells.filter(~is_placeholder(F.col("value"))).select(F.col("record_id").alias("matched_id"), "field")
    return first.join(filled, ["matched_id", "field"], "left_anti").withColumnRenamed("matched_id", "record_id")


def refresh(cells: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per cell read again (record_id, field, new_value, new_status): the decision; only verified changes are written, the old value becomes a rival."""
    both = cells.join(fresh, ["record_id", "field"])
    decision = verify.refresh_decision(F.col("value"), F.col("new_value"), F.col("new_status"))
    rows = both.withColumn("decision", decision)
    changed = F.col("decision") == "changed"
    return rows.select("record_id", "field", "decision", F.when(changed, F.col("new_value")).otherwise(F.col("value")).alias("value"), F.when(changed, F.col("value")).alias("rival"))


def refresh_sources(hosts: DataFrame, limit: int = 8) -> DataFrame:
    """The sources to read again: most trusted first, then the best yield."""
    return hosts.orderBy(F.desc("trust"), F.desc("verified_cells"), "host").limit(limit)


def repair_placeholders(records: DataFrame) -> DataFrame:
    """Records without their placeholder cells."""
    return records.withColumn("fields", F.map_filter("fields", lambda _, v: ~is_placeholder(v)))
