"""Coverage, verdicts, provenance, conflicts, gaps and the dashboard over long cells.

Every operator takes cells (dataset_id, record_id, field, value, verification_status, ...) and returns a
DataFrame. A field's counts are one grouped aggregation with a map-side part; declared fields that no
record carries are added by an anti-join on the small schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_placeholder

VERDICTS = ("verified", "unverified", "conflicting")


def status(column: str = "verification_status") -> Column:
    """A cell's verdict; whatever is unknown counts as unverified."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    return F.when(low.isin("verified", "conflicting"), low).otherwise("unverified")


def present() -> Column:
    return F.col("value").isNotNull() & (F.btrim("value") != "")


def field_counts(cells: DataFrame) -> DataFrame:
    here = present()
    return cells.groupBy("dataset_id", "field").agg(
        F.count_if(here).alias("present"), *[F.count_if(here & (status() == v)).alias(v) for v in VERDICTS]
    )


def record_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("dataset_id").agg(F.countDistinct("record_id").alias("records"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(0.0)


def field_coverage(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """dataset_id, field, records, present, missing, verified, unverified, conflicting, coverage_pct, proven_pct, declared ones included."""
    counted = field_counts(cells)
    zero = declared.select("dataset_id", "field").join(counted, ["dataset_id", "field"], "left_anti")
    both = counted.unionByName(zero.select("*", *[F.lit(0).cast("long").alias(c) for c in ("present", *VERDICTS)]))
    totals = record_counts(cells)
    return both.join(totals, "dataset_id", "left").withColumn("records", F.coalesce("records", F.lit(0))).select(
        "dataset_id", "field", "records", "present", (F.col("records") - F.col("present")).alias("missing"), *VERDICTS,
        percent(F.col("present"), F.col("records")).alias("coverage_pct"), percent(F.col("verified"), F.col("records")).alias("proven_pct"),
    )


def verdict_totals(coverage: DataFrame) -> DataFrame:
    """Per dataset: sums of the verdicts, fields that are empty or partial."""
    return coverage.groupBy("dataset_id").agg(
        F.max("records").alias("records"), F.count("*").alias("fields"), *[F.sum(c).alias(c) for c in ("present", *VERDICTS)],
        F.count_if(F.col("present") == 0).alias("empty_fields"), F.count_if((F.col("present") > 0) & (F.col("present") < F.col("records"))).alias("partial_fields"),
    )


def dashboard(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """One row for each dataset and one for all (dataset_id null), in one pass over the coverage."""
    coverage = field_coverage(cells, declared).withColumn("slots", F.col("records"))
    sums = {c: F.sum(c).alias(c) for c in ("slots", "present", *VERDICTS)}
    out = coverage.rollup("dataset_id").agg(*sums.values(), F.count("*").alias("fields"))
    return out.withColumn("coverage_pct", percent(F.col("present"), F.col("slots"))).withColumn("proven_pct", percent(F.col("verified"), F.col("slots")))


def provenance_summary(cells: DataFrame) -> DataFrame:
    """Per dataset: cells by verdict, and records whose cells are all verified."""
    bucket = F.when(F.col("verification_status").isin("verified", "conflicting", "judgment_unavailable", "rejected"), F.col("verification_status")).otherwise("unverified")
    records = cells.groupBy("dataset_id", "record_id").agg(
        F.bool_and(bucket == "verified").alias("whole"),
        *[F.count_if(bucket == b).alias(b) for b in ("verified", "unverified", "conflicting", "judgment_unavailable", "rejected")],
    )
    return records.groupBy("dataset_id").agg(
        F.count("*").alias("records"), F.count_if("whole").alias("fully_verified"),
        *[F.sum(b).alias(b) for b in ("verified", "unverified", "conflicting", "judgment_unavailable", "rejected")],
    )


def conflicts(cells: DataFrame) -> DataFrame:
    """Every conflicting cell with its incumbent and its rivals in order."""
    rivals = F.when(F.col("rival").isNotNull(), F.array("rival")).otherwise(F.array().cast("array<string>"))
    return cells.filter(status() == "conflicting").select(
        "dataset_id", "record_id", "field", F.col("value").alias("incumbent"), F.posexplode_outer(rivals).alias("rival_index", "rival")
    )


def category(present: Column, missing: Column, unverified: Column, conflicting: Column) -> Column:
    """What kind of gap a field has; null without one."""
    return (
        F.when((missing == 0) & (unverified + conflicting > 0), "evidence_gap")
        .when(present == 0, "schema_gap")
        .when(missing > 0, "depth_gap")
    )


def gaps(coverage: DataFrame) -> DataFrame:
    """Fields with a gap: category, cells of work, most work first."""
    kind = category(F.col("present"), F.col("missing"), F.col("unverified"), F.col("conflicting"))
    rows = coverage.withColumn("category", kind).filter("category is not null")
    rows = rows.withColumn("outstanding", F.col("missing") + F.col("unverified") + F.col("conflicting"))
    return rows.select("dataset_id", "field", "category", "present", "missing", "unverified", "conflicting", "outstanding").orderBy("dataset_id", F.desc("outstanding"), "field")


def scorecard(coverage: DataFrame) -> DataFrame:
    """Every declared field with its coverage, and the gap and the work that are left, if any."""
    left = gaps(coverage).select("dataset_id", "field", "category", "outstanding")
    shown = coverage.select("dataset_id", "field", "records", "present", "coverage_pct", "proven_pct")
    return shown.join(left, ["dataset_id", "field"], "left").withColumn("outstanding", F.coalesce("outstanding", F.lit(0)))


def backlog(coverage: DataFrame) -> DataFrame:
    """Per field: why work is left, how much, and whether fetching can help."""
    reason = (
        F.when(F.col("present") == 0, "never extracted").when(F.col("missing") > 0, "partly extracted").when(F.col("conflicting") > 0, "sources disagree")
        .when(F.col("unverified") > 0, "not verified")
    )
    rows = coverage.withColumn("reason", reason).filter("reason is not null")
    return rows.select(
        "dataset_id", "field", "reason", (F.col("missing") + F.col("unverified") + F.col("conflicting")).alias("outstanding"), (F.col("missing") > 0).alias("routable")
    )


def gap_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("dataset_id", "category").agg(F.count("*").alias("fields"), F.sum("outstanding").alias("outstanding"))


def reconcile(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Derived gaps against stored ones (dataset_id, field, state, phase): the new state of each.

    A gap that is gone is resolved; one that comes back after it was resolved starts at phase 0; a new one is open.
    """
    old = stored.select("dataset_id", "field", F.col("state").alias("old_state"), F.col("phase").alias("old_phase"))
    both = found.select("dataset_id", "field", "category", "outstanding").join(old, ["dataset_id", "field"], "full_outer")
    state = F.when(F.col("category").isNull(), "resolved").when(F.col("old_state").isNull() | (F.col("old_state") == "resolved"), "open").otherwise(F.col("old_state"))
    phase = F.when(F.col("old_state").isNull() | ((F.col("old_state") == "resolved") & F.col("category").isNotNull()), 0).otherwise(F.col("old_phase"))
    return both.select("dataset_id", "field", state.alias("state"), phase.cast("int").alias("phase"), F.coalesce("outstanding", F.lit(0)).alias("outstanding"))


def attempt(stored: DataFrame, results: DataFrame, most_attempts: int = 3) -> DataFrame:
    """Gap states after attempts (dataset_id, field, filled, error): filled ones are resolved, failed ones stay open, spent ones are exhausted."""
    both = stored.join(results, ["dataset_id", "field"], "left")
    tried = F.col("filled").isNotNull()
    attempts = F.col("attempts") + F.when(tried, 1).otherwise(0)
    state = (
        F.when(~tried, F.col("state")).when(F.col("filled") > 0, "resolved").when(F.col("error") != "", "open")
        .when(attempts >= most_attempts, "exhausted").otherwise("open")
    )
    return both.select("dataset_id", "field", state.alias("state"), attempts.alias("attempts"), (F.col("phase") + F.when(tried & (F.col("error") == ""), 1).otherwise(0)).alias("phase"))


def absent_fields(coverage: DataFrame, include_partial: bool = False) -> DataFrame:
    """Fields that a second reading of stored pages may fill."""
    wanted = F.col("present") == 0
    if include_partial:
        wanted = wanted | (F.col("missing") > 0)
    return coverage.filter(wanted).select("dataset_id", "field", F.when(F.col("present") == 0, "never_extracted").otherwise("partial").alias("why"))


def health(coverage: DataFrame) -> DataFrame:
    """Per dataset: shares filled, proven and undisputed, with a tone for each."""
    sums = coverage.groupBy("dataset_id").agg(F.sum("records").alias("slots"), *[F.sum(c).alias(c) for c in ("present", *VERDICTS)])
    tone = lambda c, good, fair: F.when(c >= good, "good").when(c >= fair, "fair").otherwise("poor")
    filled, proven = percent(F.col("present"), F.col("slots")), percent(F.col("verified"), F.col("present"))
    steady = percent(F.col("present") - F.col("conflicting"), F.col("present"))
    return sums.select(
        "dataset_id", filled.alias("coverage"), tone(filled, 90, 70).alias("coverage_tone"), proven.alias("evidence"), tone(proven, 90, 60).alias("evidence_tone"),
        steady.alias("consistency"), tone(steady, 95, 85).alias("consistency_tone"),
    )


def without_placeholders(cells: DataFrame) -> DataFrame:
    return cells.filter(~is_placeholder(F.col("value")))
