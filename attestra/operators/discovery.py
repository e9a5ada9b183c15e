"""Finding sources in rounds: search, drop what is known or blocked, screen, decide whether to go on.

The state of all runs is three tables: queries that may still be asked, addresses that were seen, and sources that were accepted. A round takes each run's next
queries, and a run leaves the loop when it has what it asked for, when nothing is left to ask, or when its bounds are reached. Search, screening and
proposals are injected functions from tables to tables; what they ask for beyond the bounds is cut by rank, so the result is the same each time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, host_of
from ..session import checkpoint_folder


@dataclass(frozen=True)
class Bounds:
    """What a run may spend: rounds, queries in a round, results of a query, screenings in a round, sources in all and of a host."""

    rounds: int = 3
    queries: int = 5
    results: int = 10
    screened: int = 20
    sources: int = 12
    per_host: int = 3


QUERIES = "run_id string, query string, place int"
ACCEPTED = "run_id string, url string, host string, title string, confidence double, trust double, round int, position int"


def discover(
    queries: DataFrame, wanted: DataFrame, search: Callable[[DataFrame], DataFrame], screen: Callable[[DataFrame], DataFrame], priors: DataFrame | None = None,
    seeds: DataFrame | None = None, propose: Callable[[DataFrame, int], DataFrame] | None = None, bounds: Bounds = Bounds(),  # noqa: B008
) -> tuple[DataFrame, DataFrame]:
    """(sources, log): run_id, url, host, title, confidence, trust, round, position of accepted sources, and for each run and round what was asked, found, screened and accepted.

    ``queries``: run_id, query, place; ``wanted``: run_id, requested. ``search`` gets the queries of a round and gives run_id, query, url, title, position.
    ``screen`` gets run_id, url, host, title and gives run_id, url, keep, confidence. ``priors``: host, trust, blocked of earlier runs; blocked hosts are never searched
    out again, trusted ones come first. ``seeds``: run_id, url are accepted unscreened. ``propose`` gets the runs that lack sources and the round and gives more queries.
    """
    spark = queries.sparkSession
    checkpoint_folder(spark)
    known = priors if priors is not None else spark.createDataFrame([], "host string, trust double, blocked boolean")
    known = known.groupBy("host").agg(F.max("trust").alias("trust"), F.bool_or(F.coalesce("blocked", F.lit(False))).alias("blocked"))
    accepted = spark.createDataFrame([], ACCEPTED)
    if seeds is not None:
        own = seeds.select("run_id", canonical_url(F.col("url")).alias("url")).filter("url <> ''").distinct().withColumn("host", host_of(F.col("url")))
        place = F.row_number().over(Window.partitionBy("run_id").orderBy("url"))
        accepted = own.withColumn("position", place).filter(F.col("position") <= bounds.sources).join(known.select("host", "trust"), "host", "left").select(
            "run_id", "url", "host", F.lit("").alias("title"), F.lit(None).cast("double").alias("confidence"), "trust", F.lit(0).alias("round"), "position"
        ).checkpoint()
    seen = accepted.select("run_id", "url")
    waiting = queries.groupBy("run_id", "query").agg(F.min("place").alias("place")).checkpoint()
    asked, log = spark.createDataFrame([], "run_id string, query string"), spark.createDataFrame([], "run_id string, round int, queries long, found long, screened long, accepted long")
    for turn in range(1, bounds.rounds + 1):
        have = accepted.groupBy("run_id").agg(F.count("*").alias("have"))
        open_ = wanted.join(have, "run_id", "left").withColumn("room", F.least("requested", F.lit(bounds.sources)) - F.coalesce("have", F.lit(0))).filter("room > 0").select("run_id", "room").checkpoint()
        if turn > 1 and propose is not None and not open_.isEmpty():
            more = propose(open_.join(accepted, "run_id", "left").select("run_id", "room", "url", "host"), turn).select("run_id", "query", "place")
            waiting = waiting.unionByName(more.join(waiting, ["run_id", "query"], "left_anti").groupBy("run_id", "query").agg(F.min("place").alias("place")))
            waiting = waiting.join(asked, ["run_id", "query"], "left_anti").checkpoint()
        place = F.row_number().over(Window.partitionBy("run_id").orderBy("place", "query"))
        now = waiting.join(open_, "run_id", "left_semi").withColumn("n", place).filter(F.col("n") <= bounds.queries).select("run_id", "query", "place").checkpoint()
        if now.isEmpty():
            break
        waiting, asked = waiting.join(now, ["run_id", "query"], "left_anti").checkpoint(), asked.unionByName(now.select("run_id", "query")).checkpoint()
        hits = search(now).filter(F.col("position") < bounds.results).join(now.select("run_id", "query", "place"), ["run_id", "query"])
        hits = hits.withColumn("url", canonical_url(F.col("url"))).withColumn("host", host_of(F.col("url"))).filter("coalesce(host, '') <> ''")
        # an address that several queries found is one candidate, at its best place
        fresh = hits.groupBy("run_id", "url", "host").agg(F.min(F.struct("place", "position", F.coalesce("title", F.lit("")).alias("title"))).alias("best"))
        fresh = fresh.join(seen, ["run_id", "url"], "left_anti").checkpoint()
        able = fresh.join(known, "host", "left").filter("not coalesce(blocked, false)").withColumn("trust", F.coalesce("trust", F.lit(0.0)))
        first = Window.partitionBy("run_id").orderBy(F.desc("trust"), "best.place", "best.position", "url")
        tried = able.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= bounds.screened).checkpoint()
        told = screen(tried.select("run_id", "url", "host", F.col("best.title").alias("title"))).groupBy("run_id", "url").agg(F.max(F.struct("keep", "confidence")).alias("x"))
        good = tried.join(told, ["run_id", "url"]).filter("x.keep")
        # of a host at most per_host, those before this round included
        held = accepted.groupBy("run_id", "host").agg(F.count("*").alias("held"))
        order = [F.desc("trust"), F.desc("x.confidence"), F.col("n")]
        good = good.join(held, ["run_id", "host"], "left").withColumn("of_host", F.row_number().over(Window.partitionBy("run_id", "host").orderBy(*order)) + F.coalesce("held", F.lit(0)))
        good = good.filter(F.col("of_host") <= bounds.per_host).join(open_, "run_id").withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy(*order))).filter(F.col("position") <= F.col("room"))
        taken = good.select("run_id", "url", "host", F.col("best.title").alias("title"), "x.confidence", "trust", F.lit(turn).alias("round"), "position").checkpoint()
        log = log.unionByName(_counts(now, fresh, tried, taken, turn)).checkpoint()
        accepted, seen = accepted.unionByName(taken).checkpoint(), seen.unionByName(tried.select("run_id", "url")).checkpoint()
    return accepted, log


def _counts(now: DataFrame, fresh: DataFrame, tried: DataFrame, taken: DataFrame, turn: int) -> DataFrame:
    out = now.groupBy("run_id").agg(F.count("*").alias("queries"))
    for name, rows in (("found", fresh), ("screened", tried), ("accepted", taken)):
        out = out.join(rows.groupBy("run_id").agg(F.count("*").alias(name)), "run_id", "left")
    return out.select("run_id", F.lit(turn).alias("round"), "queries", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "screened", "accepted")])


def decision(said: str, queries: list[str], used: int, most: int = 8) -> tuple[str, list[str]]:
    """What a supervisor may do: go on with the queries that are new and within what is left of ``most``, or stop. Anything else is stop."""
    fresh = [q for q in dict.fromkeys(" ".join(q.split()) for q in queries if isinstance(q, str)) if q][: max(0, most - used)]
    return ("continue", fresh) if (said or "").strip().lower() == "continue" and fresh else ("stop", [])
