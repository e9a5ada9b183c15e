"""Reads of stored tables: pages by address, id or run, lists of datasets and runs, sources, joined plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_by_url(pages: DataFrame, url: str, with_html: bool = True) -> DataFrame:
    """The newest good revision of an address over all runs."""
    found = pages.filter((F.col("url") == url) & (F.col("status") == "ok")).orderBy(F.desc("revision"), F.desc("retrieved_at")).limit(1)
    return found if with_html or "raw_html" not in pages.columns else found.drop("raw_html")


def page(pages: DataFrame, page_id: str) -> DataFrame:
    return pages.filter(F.col("page_id") == page_id).drop("raw_html")


def pages_of_run(pages: DataFrame, run_id: str, limit: int = 200) -> DataFrame:
    """A run's pages, newest first, at most 500."""
    return pages.filter(F.col("run_id") == run_id).drop("raw_html").orderBy(F.desc("retrieved_at"), "page_id").limit(max(1, min(500, limit)))


def newest(rows: DataFrame, by: str = "created_at", limit: int = 50) -> DataFrame:
    """Datasets or runs, newest first, at most 100."""
    return rows.orderBy(F.desc(by)).limit(max(1, min(100, limit)))


def history(runs: DataFrame, datasets: DataFrame, limit: int = 50) -> DataFrame:
    """Runs with the dataset that each made, if any."""
    return newest(runs, limit=limit).join(datasets.select("run_id", "dataset_id"), "run_id", "left")


def sources_of_dataset(datasets: DataFrame, sources: DataFrame, dataset_id: str, limit: int = 500) -> DataFrame:
    own = datasets.filter(F.col("dataset_id") == dataset_id).select("run_id")
    return sources.join(own, "run_id", "left_semi").orderBy("url").limit(limit)


def plan_of_dataset(datasets: DataFrame, runs: DataFrame, workflows: DataFrame, dataset_id: str) -> DataFrame:
    """The plan behind a dataset, and the first link that is missing if one is."""
    rows = datasets.filter(F.col("dataset_id") == dataset_id).join(runs.select("run_id", "workflow_id"), "run_id", "left").join(workflows.select("workflow_id", "plan"), "workflow_id", "left")
    missing = F.when(F.col("run_id").isNull(), "run").when(F.col("workflow_id").isNull(), "workflow").when(F.col("plan").isNull(), "plan")
    return rows.select("dataset_id", "plan", missing.alias("missing"))


def job_page(events: DataFrame, skip: int = 0, limit: int = 100) -> tuple[DataFrame, Column]:
    """A page of events in order and the offset of the next."""
    skip, limit = max(0, skip), max(1, min(500, limit))
    return events.orderBy("seq").offset(skip).limit(limit), F.lit(skip + limit)


def event_type_of(message: Column) -> Column:
    """The type of an old event by its message, the first rule that fits."""
    low = F.lower(message)
    return (
        F.when(low.like("%failed%"), "run.failed").when(low.like("%completed%"), "run.completed").when(low.like("%fetched%"), "source.fetched")
        .when(low.like("%extract%"), "record.extracted").when(low.like("started%"), "stage.started").otherwise("stage.progress")
    )
