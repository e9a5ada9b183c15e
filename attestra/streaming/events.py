"""Run events: folds, guards and micro-batched sinks. All functions take batch or streaming DataFrames unless they say otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Types an event may have; others count as progress.
KNOWN_TYPES = ("signup", "error", "click", "view", "purchase")
TERMINAL = ("purchase", "error")


def guarded(events: DataFrame, known: tuple[str, ...] = KNOWN_TYPES) -> DataFrame:
    return events.withColumn("type", F.when(F.col("type").isin(*known), F.col("type")).otherwise("stage.progress"))


def fold(events: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Per run: the latest type and value, events so far, whether a terminal one came."""
    return events.groupBy("run_id").agg(
        F.max_by("type", "seq").alias("last_type"), F.max_by("value", "seq").alias("last_value"), F.count("*").alias("events"),
        F.max(F.col("type").isin(*terminal)).alias("done"), F.max("seq").alias("last_seq"),
    )


def snapshot(events: DataFrame, run_id: str, after: int = 0) -> DataFrame:
    """The events of a run past an offset, in order."""
    return events.filter((F.col("run_id") == run_id) & (F.col("seq") > after)).orderBy("seq")


def ledger(charges: DataFrame) -> DataFrame:
    """Charges once per id; on a stream each id is remembered."""
    return charges.dropDuplicates(["charge_id"])


def totals(charges: DataFrame) -> DataFrame:
    return charges.groupBy("job_id").agg(F.sum("credits").alias("credits"), F.count("*").alias("charges"))


def within_budget(charges: DataFrame, budget: int) -> DataFrame:
    """Charges in order until one would exceed the budget; 0 is no limit. Batch only."""
    running = F.sum("credits").over(Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return charges.withColumn("running", running).withColumn("accepted", F.lit(budget == 0) | (F.col("running") <= budget))


def illegal_steps(events: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Stage events that do not follow the one before. Batch only."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    steps = events.withColumn("place", place).withColumn("before", F.lag("place").over(Window.partitionBy("run_id").orderBy("seq")))
    return steps.filter(F.col("before").isNotNull() & (F.col("place") != F.col("before") + 1))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and values of each type by time; later ones than ``late`` are dropped on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "run_id").agg(F.count("*").alias("n"))


def audit_sink(events: DataFrame, path: str, checkpoint: str, on_error: Callable[[Exception], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Append a stream of events to a table in micro-batches. A batch has its own folder, so a repeated one replaces itself.

    With ``on_error`` a batch that cannot be written goes, as JSON, to a folder beside the table (``path`` with _dead), and the stream goes on; if that fails too, or
    without ``on_error``, the query fails and the batch is tried again at its restart. No batch counts as done that is in neither place.
    """

    def write(batch: DataFrame, number: int) -> None:
        try:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        except Exception as error:
            if on_error is None:
                raise
            batch.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}_dead/batch={number}")
            on_error(error)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
