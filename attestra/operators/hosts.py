"""Hosts: yield, reputation, freshness, ranking and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import age_days, stale_after_days
from ..functions.scores import trust
from ..functions.urls import host_of


def yield_by_host(cells: DataFrame) -> DataFrame:
    """Per dataset and host: cells by verdict, records, the verified share."""
    rows = cells.filter(F.col("value").isNotNull()).withColumn("host", host_of(F.col("url")))
    out = rows.groupBy("dataset_id", "host").agg(
        F.count("*").alias("cells"), F.count_if(F.col("verification_status") == "verified").alias("verified"),
        F.count_if(F.col("verification_status") == "conflicting").alias("conflicting"), F.countDistinct("record_id").alias("records"),
    )
    rest = F.col("cells") - F.col("verified") - F.col("conflicting")
    return out.withColumn("unverified", rest).withColumn("verified_share", F.round(F.col("verified") / F.col("cells"), 3))


def counters(visits: DataFrame, proven: DataFrame) -> DataFrame:
    """Counters of each host from visits (url, ok, blocked, at) and its cells (host, cells, verified)."""
    seen = visits.withColumn("host", host_of(F.col("url"))).groupBy("host").agg(
        F.count("*").alias("visits"), F.count_if("ok").alias("successes"), F.count_if("blocked").alias("block_count"),
        F.max("at").alias("last_seen"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success_at"),
    )
    own = proven.groupBy("host").agg(F.sum("cells").alias("cells"), F.sum("verified").alias("verified_cells"))
    return seen.join(own, "host", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("cells", "verified_cells")})


def ranked(counted: DataFrame, now: Column) -> DataFrame:
    """Hosts with their trust, best first."""
    last = F.coalesce("last_success_at", "last_seen")
    score = trust(F.col("visits"), F.col("successes"), F.col("cells"), F.col("verified_cells"), F.col("block_count"), last, now)
    return counted.withColumn("trust", score).orderBy(F.desc("trust"), F.desc(last), "host")


def add_counters(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Additive upsert of counters: sums add, the later times win, a missing new time keeps the old one."""
    both = base.unionByName(delta, allowMissingColumns=True)
    sums = ("visits", "successes", "block_count", "cells", "verified_cells")
    return both.groupBy("host").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums], *[F.max(c).alias(c) for c in ("last_seen", "last_success_at")])


def blocked(counted: DataFrame) -> DataFrame:
    """Hosts that history says refuse: three blocks, four visits, a quarter or fewer successes."""
    return counted.filter((F.col("block_count") >= 3) & (F.col("visits") >= 4) & (F.col("successes") <= 0.25 * F.col("visits")))


def adaptive_cap(score: Column, flat: int) -> Column:
    """Pages a host may use: all for a trusted or unknown one, fewer for others, two at least."""
    return F.when(score.isNull() | (score >= 0.35), flat).otherwise(F.greatest(F.lit(2), F.round(flat * (0.4 + 0.6 * score)))).cast("int")


def freshness(cells: DataFrame) -> DataFrame:
    """Per field: when a value was last verified, and how many are."""
    good = F.col("verification_status") == "verified"
    return cells.filter(F.col("value").isNotNull() & ~F.col("field").startswith("_")).groupBy("dataset_id", "field").agg(
        F.max(F.when(good, F.col("retrieved_at"))).alias("last_verified_at"), F.count_if(good).alias("verified_cells"), F.count("*").alias("total_cells")
    )


def staleness(fresh: DataFrame, now: Column) -> DataFrame:
    """Per field: age, the age at which it is stale, and whether it is; never verified is stale."""
    age = age_days(F.col("last_verified_at"), now)
    return fresh.select("dataset_id", "field", F.round(age, 3).alias("age_days"), stale_after_days(F.col("field")).alias("stale_after"), F.coalesce(age > stale_after_days(F.col("field")), F.lit(True)).alias("stale"))


def dataset_staleness(stale: DataFrame) -> DataFrame:
    """Per dataset: share of stale fields, oldest age, upper median age."""
    ordered = F.sort_array(F.collect_list("age_days"))
    return stale.groupBy("dataset_id").agg(
        F.round(100.0 * F.count_if("stale") / F.count("*"), 1).alias("stale_pct"), F.max("age_days").alias("max_age_days"),
        F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")).alias("median_age_days"),
    )


def refresh_order(stale: DataFrame) -> DataFrame:
    return stale.orderBy(F.col("age_days").desc_nulls_first(), "field")


def cap_per_host(links: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """At most ``most`` rows of each host, in order."""
    place = Window.partitionBy("host").orderBy(*order)
    return links.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)


def round_robin(links: DataFrame, order: list[Column]) -> DataFrame:
    """Rows so that every host comes once before any comes twice."""
    place = Window.partitionBy("host").orderBy(*order)
    return links.withColumn("turn", F.row_number().over(place)).orderBy("turn", *order)


def timing(samples: DataFrame, last: int = 200) -> DataFrame:
    """Per rung over its last samples: count, successes, and the values at half and nine tenths of the order."""
    recent = samples.withColumn("age", F.row_number().over(Window.partitionBy("rung").orderBy(F.desc("seq")))).filter(F.col("age") <= last)
    ordered, n = F.sort_array(F.collect_list("ms")), F.size(F.collect_list("ms"))
    at = lambda i: F.get(ordered, i.cast("int"))
    return recent.groupBy("rung").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("ok"), at(F.floor(n / 2)).alias("p50"), at(F.least(n - 1, F.floor(n * 0.9))).alias("p90")
    )
