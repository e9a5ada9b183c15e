"""Filling gaps in two phases and rounds: stored pages are read again first, then the web is searched within a budget.

Everything is a table: the gaps of all datasets, the budget that each has left, and the frontier, which is the cells still open
for the fields of a round. One round takes the field of one rank of every dataset, so a dataset's fields share its budget in a fixed order
while datasets, records and pages are worked on side by side. What a phase fills leaves the frontier by an anti-join. Search,
fetch and reading are injected functions from tables to tables. State between rounds is written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host_of
from ..session import checkpoint_folder
from . import coverage, dedupe, gapfill

STORED, SEARCH = 1, 2
CELL = ["dataset_id", "field", "record_id"]
GAP = ["dataset_id", "field"]


@dataclass(frozen=True)
class Bounds:
    """What a pass may cost: searches and fields of a dataset, searches of a field, results and fetches of a record, attempts of a gap."""

    searches: int = 8
    fields: int = 2
    searches_per_field: int = 12
    results: int = 4
    fetches: int = 3
    attempts: int = 3


@dataclass(frozen=True)
class Sources:
    """The injected functions.

    ``stored``: frontier (dataset_id, field, record_id) to found cells (CELL, value, page_id, quote, text).
    ``search``: queries (CELL, entity, query, place) to results (CELL, url, title, position), or rows with ``error``.
    ``fetch``: results to pages (CELL, url, page_id, text); what cannot be fetched has no row.
    ``read``: pages to found values (dataset_id, field, page_id, value, quote, text and the identity fields that the page gives).
    """

    stored: Callable[[DataFrame], DataFrame] | None = None
    search: Callable[[DataFrame], DataFrame] | None = None
    fetch: Callable[[DataFrame], DataFrame] | None = None
    read: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Pass:
    """Cells with what was filled, gaps after the pass, and a row for every phase that a gap went through."""

    cells: DataFrame
    gaps: DataFrame
    log: DataFrame
    rounds: int = field(default=0)


def materially_missing(present: Column, missing: Column, disputed: Column) -> Column:
    """Whether absence, rather than values without a verdict, is what ails a field that some record has."""
    return (present > 0) & (missing > 0) & (missing > disputed)


def open_gaps(found: DataFrame, stored: DataFrame, bounds: Bounds) -> DataFrame:
    """The gaps that a pass takes up, at most ``bounds.fields`` for each dataset, ranked by the work that is left.

    ``found`` are derived gaps; ``stored`` has dataset_id, field, state, phase, attempts of what was tried before.
    """
    known = coverage.reconcile(found, stored).select(*GAP, "state", "phase")
    tried = stored.select(*GAP, "attempts")
    rows = found.join(known, GAP).join(tried, GAP, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    material = materially_missing(F.col("present"), F.col("missing"), F.col("unverified") + F.col("conflicting"))
    fillable = (F.col("category").isin("depth_gap", "schema_gap") & (F.col("missing") > 0)) | material
    able = rows.withColumn("material", material).filter(fillable & (F.col("state") == "open") & (F.col("attempts") < bounds.attempts))
    rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("outstanding"), "field"))
    return able.withColumn("rank", rank).filter(F.col("rank") <= bounds.fields)


def _small(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """A table with a row for each gap, dataset or range, sent to every task if it is small; it is counted first."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _said() -> Column:
    return F.coalesce(F.btrim("value"), F.lit("")) != ""


def profile_of(cells: DataFrame, identity: list[str]) -> DataFrame:
    """dataset_id, record_id, filled (values), entity (place and value of the first identity field), website, held (the identity fields): what rounds ask of a record."""
    named = F.when(_said() & F.col("field").isin(*identity), F.struct(F.array_position(F.array(*map(F.lit, identity)), F.col("field")).alias("place"), F.btrim("value").alias("entity")))
    return cells.groupBy("dataset_id", "record_id").agg(
        F.count_if(_said()).alias("filled"), F.min(named).alias("entity"), F.min(F.when(F.col("field") == "website", F.col("value"))).alias("website"),
        F.struct(*[F.max(F.when(F.col("field") == k, F.col("value"))).alias(k) for k in identity]).alias("held"),
    )


def updated_profile(profile: DataFrame, fresh: DataFrame, identity: list[str]) -> DataFrame:
    """A profile after cells were written; these take the place of cells without a value only."""
    new = profile_of(fresh, identity)
    rows = profile.join(new.select("dataset_id", "record_id", *[F.col(c).alias(f"_{c}") for c in ("filled", "entity", "website", "held")]), ["dataset_id", "record_id"], "left")
    held = F.struct(*[F.coalesce(F.col("_held")[k], F.col("held")[k]).alias(k) for k in identity])
    return rows.select("dataset_id", "record_id", (F.col("filled") + F.coalesce("_filled", F.lit(0))).alias("filled"), F.least("entity", "_entity").alias("entity"), F.coalesce("_website", "website").alias("website"), held.alias("held"))


def frontier_of(profile: DataFrame, filled: DataFrame, gaps: DataFrame) -> DataFrame:
    """The open cells of some gaps: every record of the dataset that has no value for the field. ``filled`` are the cells with a value."""
    asked = _small(gaps.select(*GAP))
    return profile.select("dataset_id", "record_id").join(asked, "dataset_id").select(*CELL).join(filled.select(*CELL).join(asked, GAP, "left_semi"), CELL, "left_anti")


def _placed(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each gap with ``place`` from 1, the fullest records first."""
    order = [F.desc("filled"), F.col("record_id")]
    if most <= 10_000:
        # the budget bounds a group's rows before they are shuffled, so a field that all records miss is no hot group
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*GAP).orderBy(*order))).filter(F.col("place") <= most)
    # with a large budget it would be one: rows are sorted in ranges and numbered there, and the ranges before them are added
    ranged = rows.repartitionByRange(*map(F.col, GAP), *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy(*GAP, "_range").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*GAP).orderBy("_range")) - F.col("_n")
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range", *GAP).orderBy(*order)))
    placed = placed.join(_small(sizes.select(*GAP, "_range", ahead.alias("_ahead"))), [*GAP, "_range"])
    return placed.withColumn("place", F.col("_place") + F.col("_ahead")).filter(F.col("place") <= most).drop("_range", "_place", "_ahead")


def queries_for(frontier: DataFrame, profile: DataFrame, left: DataFrame, bounds: Bounds) -> DataFrame:
    """CELL, entity, query, place: one search for each open cell of a record that says who it is, the fullest records first, within the budget left."""
    known = profile.filter("entity is not null").select("dataset_id", "record_id", "filled", "entity.entity")
    rows = _placed(frontier.join(known, ["dataset_id", "record_id"]), min(bounds.searches_per_field, bounds.searches))
    rows = rows.join(_small(left), "dataset_id").filter(F.col("place") <= F.col("left"))
    query = F.concat(F.lit('"'), F.col("entity"), F.lit('" '), F.replace("field", F.lit("_"), F.lit(" ")))
    return rows.select(*CELL, "entity", query.alias("query"), "place")


def plausible(url: Column, title: Column, entity: Column) -> Column:
    """Whether a result is worth a fetch: its host, address or title names the entity, punctuation aside."""
    squash = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    slug, first = squash(entity), squash(F.split(F.btrim(entity), r"\s+")[0])
    named = lambda text: F.contains(text, F.left(slug, F.lit(10))) | ((F.length(first) >= 6) & F.contains(text, first))
    return (F.length(slug) >= 4) & (F.startswith(squash(host_of(url)), F.left(slug, F.lit(12))) | named(squash(url)) | named(squash(title)))


def chosen_results(results: DataFrame, queries: DataFrame, profile: DataFrame, bounds: Bounds) -> DataFrame:
    """The results to fetch for each record: plausible ones, its own site first and social sites last."""
    site = profile.select("dataset_id", "record_id", "website")
    rows = results.filter(F.col("position") <= bounds.results).join(queries.select(*CELL, "entity"), CELL)
    rows = rows.filter(plausible(F.col("url"), F.col("title"), F.col("entity"))).join(site, ["dataset_id", "record_id"], "left")
    order = Window.partitionBy(*CELL).orderBy(gapfill.result_order(F.col("url"), F.col("website")), "position")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= bounds.fetches).select(*CELL, "url", "title", "place")


def written_cells(found: DataFrame, frontier: DataFrame, order: Column) -> DataFrame:
    """One cell for each open one that something was found for; a value that its quote and page hold is verified."""
    held = found.filter(_said()).join(frontier, CELL, "left_semi")
    first = held.groupBy(*CELL).agg(F.min_by(F.struct("value", "page_id", "quote", "text"), order).alias("x")).select(*CELL, "x.*")
    proven = (F.coalesce("quote", F.lit("")) != "") & F.contains("text", F.col("quote")) & F.contains("quote", F.col("value"))
    return first.select(*CELL, "value", "page_id", "quote", F.when(F.coalesce(proven, F.lit(False)), "verified").otherwise("unverified").alias("verification_status"))


def identities_of(profile: DataFrame, identity: list[str]) -> DataFrame:
    """dataset_id, signature, and the first record of that identity."""
    signed = dedupe.with_signature(profile.select("dataset_id", "record_id", "held.*"), identity)
    return signed.filter("signature is not null").groupBy("dataset_id", "signature").agg(F.min("record_id").alias("record_id"))


def matched(found: DataFrame, known: DataFrame, identity: list[str]) -> DataFrame:
    """Found values with the record_id of the dataset's first record of the same identity; others belong to no record."""
    return dedupe.with_signature(found.drop("record_id"), identity).join(known, ["dataset_id", "signature"])


def autofill(cells: DataFrame, declared: DataFrame, stored: DataFrame, sources: Sources, identity: list[str], bounds: Bounds = Bounds()) -> Pass:  # noqa: B008
    """One pass over the open gaps of all datasets.

    ``cells``: CELL, value, verification_status; ``stored``: dataset_id, field, state, phase, attempts. A gap that lacks most of its
    values is searched for at once; any other is first looked for in stored pages, and is searched for only if they held nothing and
    some record has the field. A gap is resolved when a cell was written, exhausted when a search found nothing, and stays open when stored
    pages held nothing or the search itself failed. The pass ends when no gap has a phase left or no dataset has a search left for one.
    """
    checkpoint_folder(cells.sparkSession)
    spark = cells.sparkSession
    found = coverage.gaps(coverage.field_coverage(cells, declared)).checkpoint()
    gaps = open_gaps(found, stored, bounds).checkpoint()
    left = gaps.select("dataset_id").distinct().withColumn("left", F.lit(bounds.searches)).checkpoint()
    held, log = cells.select(*CELL, "value", "verification_status").withColumns({"page_id": F.lit(None).cast("string"), "quote": F.lit(None).cast("string")}), None
    # what rounds ask of the cells is kept once; a round adds what it wrote, and the cells themselves are put together at the end
    profile = filled = known = written = None
    done = 0
    for rank in range(1, bounds.fields + 1):
        for phase in (STORED, SEARCH):
            turn = gaps.filter((F.col("rank") == rank) & (F.col("state") == "open") & (F.col("phase") < phase))
            if phase == STORED:
                turn = turn.filter("not material")
            else:
                turn = turn.filter((F.col("category") == "depth_gap") | F.col("material")).join(left.filter("left > 0"), "dataset_id", "left_semi")
            if turn.isEmpty():
                continue
            done += 1
            if profile is None:
                profile, filled = profile_of(cells, identity).checkpoint(), cells.filter(_said()).select(*CELL).checkpoint()
            frontier = frontier_of(profile, filled if written is None else filled.unionByName(written.select(*CELL)), turn).checkpoint()
            if phase == STORED:
                fresh, steps = _read_stored(frontier, turn, sources)
            else:
                if known is None:
                    known = identities_of(profile, identity).checkpoint()
                fresh, steps = _search(frontier, turn, profile, known, identity, left, sources, bounds)
                used = steps.groupBy("dataset_id").agg(F.sum("searches").alias("used"))
                left = left.join(used, "dataset_id", "left").select("dataset_id", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")).checkpoint()
            if not fresh.isEmpty():
                written = fresh if written is None else written.unionByName(fresh)
                profile = updated_profile(profile, fresh, identity).checkpoint()
                if not turn.filter(F.col("field").isin(*identity)).isEmpty():
                    known = None
            steps = steps.withColumns({"rank": F.lit(rank), "phase": F.lit(phase)}).checkpoint()
            gaps = _after(gaps, steps, phase).checkpoint()
            log = steps if log is None else log.unionByName(steps)
    if log is None:
        log = spark.createDataFrame([], "dataset_id string, field string, searches long, pages long, written long, error string, rank int, phase int")
    return Pass(held if written is None else held.join(written, CELL, "left_anti").unionByName(written), gaps, log, done)


def _counted(turn: DataFrame, fresh: DataFrame, searches: DataFrame | None, pages: DataFrame | None, errors: DataFrame | None) -> DataFrame:
    out = turn.select(*GAP)
    for name, rows in (("searches", searches), ("pages", pages), ("written", fresh)):
        if rows is None:
            out = out.withColumn(name, F.lit(0).cast("long"))
        else:
            out = out.join(rows.groupBy(*GAP).agg(F.count("*").alias(name)), GAP, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    if errors is None:
        return out.withColumn("error", F.lit(""))
    said = errors.groupBy(*GAP).agg(F.min("error").alias("error"))
    # an error matters only where nothing was fetched
    return out.join(said, GAP, "left").withColumn("error", F.when(F.col("pages") == 0, F.coalesce("error", F.lit(""))).otherwise(""))


def _read_stored(frontier: DataFrame, turn: DataFrame, sources: Sources) -> tuple[DataFrame, DataFrame]:
    if sources.stored is None:
        raise RuntimeError("no reader of stored pages is configured")
    found = sources.stored(frontier).checkpoint()
    fresh = written_cells(found, frontier, F.struct("page_id", "value")).checkpoint()
    return fresh, _counted(turn, fresh, None, found.select(*GAP, "page_id").distinct(), None)


def _search(frontier: DataFrame, turn: DataFrame, profile: DataFrame, known: DataFrame, identity: list[str], left: DataFrame, sources: Sources, bounds: Bounds) -> tuple[DataFrame, DataFrame]:
    if sources.search is None or sources.fetch is None or sources.read is None:
        raise RuntimeError("no search, fetch or reader is configured")
    queries = queries_for(frontier, profile, left, bounds).checkpoint()
    results = sources.search(queries).checkpoint()
    errors = results.filter("error is not null") if "error" in results.columns else None
    good = results.filter("error is null").drop("error") if "error" in results.columns else results
    pages = sources.fetch(chosen_results(good, queries, profile, bounds)).checkpoint()
    found = matched(sources.read(pages), known, identity)
    fresh = written_cells(found, frontier, F.struct("page_id", "value")).checkpoint()
    return fresh, _counted(turn, fresh, queries, pages, errors)


def _after(gaps: DataFrame, steps: DataFrame, phase: int) -> DataFrame:
    """Gaps after a phase ran; a failed search and an empty first phase leave a gap open, and the phase counts as reached either way."""
    tried = steps.select(*GAP, "written", "error")
    rows = gaps.join(tried, GAP, "left")
    ran = F.col("written").isNotNull()
    missed = F.lit("open") if phase == STORED else F.when(F.col("error") != "", "open").otherwise("exhausted")
    state = F.when(~ran, F.col("state")).when(F.col("written") > 0, "resolved").otherwise(missed)
    return rows.withColumns({
        "state": state, "phase": F.when(ran, F.greatest(F.col("phase"), F.lit(phase))).otherwise(F.col("phase")), "attempts": F.col("attempts") + ran.cast("int"),
    }).drop("written", "error")
