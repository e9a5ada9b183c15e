"""Record and page tables: scans, searches, conditions, latest rows, revisions, upserts, deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import is_filled, is_placeholder
from ..functions.numbers import agent_number, currency_sign



def documents_of(cells: DataFrame) -> DataFrame:
    """One row for each record: its fields as a map."""
    return cells.groupBy("dataset_id", "record_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def search(records: DataFrame, query: str, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Records whose serialised fields contain the text, keys too; a page of ``limit`` of them in order of id, or all from ``offset`` on if it is None."""
    found = records.filter(F.contains(F.lower(F.to_json("fields")), F.lit(query.lower()))) if query else records
    page = found.orderBy("dataset_id", "record_id").offset(max(0, offset))
    return page if limit is None else page.limit(max(1, limit))


OPS = ("filled", "empty", "equals", "contains", "gt", "lt")


def condition(field: Column, op: str, operand: str | float | None = None, longest: int | None = None) -> Column:
    """One condition on a cell's text, or on its first ``longest`` characters; comparisons are of magnitudes."""
    text = F.coalesce(field, F.lit(""))
    text = text if longest is None else F.left(text, F.lit(longest))
    plain = F.lower(F.btrim(text))
    if op == "filled":
        return ~is_placeholder(field)
    if op == "empty":
        return is_placeholder(field)
    if op == "equals":
        return plain == str(operand).strip().lower()
    if op == "contains":
        return F.contains(plain, F.lit(str(operand).strip().lower()))
    if op in ("gt", "lt"):
        number = agent_number(text)
        held = number > float(operand) if op == "gt" else number < float(operand)
        return F.coalesce(held, F.lit(False)) & ~is_placeholder(field)
    raise ValueError(f"unknown operation {op!r}; there are {', '.join(OPS)}")


def records_where(records: DataFrame, conditions: list[tuple[str, str, str | float | None]], longest: int | None = None) -> DataFrame:
    """Records that meet one to four conditions (field, operation, operand)."""
    if not 1 <= len(conditions) <= 4:
        raise ValueError("one to four conditions")
    value = lambda f: F.try_element_at("fields", F.lit(f))
    return records.filter(reduce(lambda a, b: a & b, [condition(value(f), op, x, longest) for f, op, x in conditions]))


def unreadable(records: DataFrame, field: str) -> DataFrame:
    """How many filled texts of a field are no magnitude, and which currencies but dollars occur."""
    value = F.try_element_at("fields", F.lit(field))
    sign = currency_sign(value)
    return records.agg(
        F.count_if(~is_placeholder(value) & agent_number(value).isNull()).alias("unreadable"),
        F.array_join(F.array_sort(F.collect_set(F.when(~sign.isin("$", ""), sign))), ",").alias("other_currencies"),
    )


def in_order_of(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows with these keys, in the order of the list."""
    wanted = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], ["position", key])
    return rows.join(F.broadcast(wanted), key).orderBy("position")


def latest_per_key(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last appended row of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("row")).select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def first_per_key(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Insert-or-ignore: the first row of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("row")).select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def insert_new(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``fresh`` whose key is not stored yet."""
    return fresh.join(stored.select(*keys), keys, "left_anti")


def revisions(writes: DataFrame, keys: list[str], seq: str, digest: str) -> DataFrame:
    """The writes that change a page against its latest revision, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(seq)
    changed = ~F.col(digest).eqNullSafe(F.lag(digest).over(order)) | (F.row_number().over(order) == 1)
    rows = writes.withColumn("_changed", changed.cast("int"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("revision", F.sum("_changed").over(running)).filter("_changed = 1").drop("_changed")


def latest_revision(pages: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("revision"))
    return pages.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def last_events(events: DataFrame, most: int = 2000) -> DataFrame:
    """A ring: the last rows of each run, with the number that the ring dropped."""
    order = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    total = F.count("*").over(Window.partitionBy("run_id"))
    return events.withColumn("dropped", F.greatest(F.lit(0), total - most)).withColumn("_age", F.row_number().over(order)).filter(F.col("_age") <= most).drop("_age")


def update_cell(records: DataFrame, dataset_id: str, record_id: str, field: str, value: str | None) -> DataFrame:
    """Records with one field of one record replaced; a field that it lacks is not added."""
    here = (F.col("dataset_id") == dataset_id) & (F.col("record_id") == record_id)
    changed = F.transform_values("fields", lambda k, v: F.when(k == field, F.lit(value)).otherwise(v))
    return records.withColumn("fields", F.when(here, changed).otherwise(F.col("fields")))


def add_column(schema: list[dict], name: str, kind: str = "string") -> tuple[list[dict], bool]:
    """The schema with one more field, and whether it was added."""
    import re

    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]{0,63}", name):
        raise ValueError(f"{name!r} is no field name")
    if any(f["name"] == name for f in schema):
        return schema, False
    return [*schema, {"name": name, "type": kind, "description": "", "required": False}], True


def without_dataset(tables: dict[str, DataFrame], dataset_id: str) -> dict[str, DataFrame]:
    """Datasets, records, gaps and exports without one dataset; sources, pages and runs survive."""
    gone = ("datasets", "records", "gaps", "exports")
    return {k: t.filter(F.col("dataset_id") != dataset_id) if k in gone else t for k, t in tables.items()}


def orphans_failed(runs: DataFrame) -> DataFrame:
    """Runs that a crash left unfinished, marked failed and partial."""
    open_ = F.col("completed_at").isNull() & ~F.col("status").isin("COMPLETED", "FAILED", "CANCELLED", "PARTIAL")
    return runs.withColumn("status", F.when(open_, "FAILED").otherwise(F.col("status"))).withColumn("partial", F.when(open_, True).otherwise(F.col("partial")))


def relation_of(cells: DataFrame, fields: list[str]) -> DataFrame:
    """``filled_companions`` of the records of cells with value and verification_status."""
    maps = {name: F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", column)))) for name, column in (("fields", "value"), ("statuses", "verification_status"))}
    return filled_companions(cells.filter(F.col("field").isin(*fields)).groupBy("record_id").agg(*[m.alias(name) for name, m in maps.items()]), fields)


def filled_companions(records: DataFrame, fields: list[str]) -> DataFrame:
    """The flat relation of the SQL surface: four columns for each field."""
    from ..functions.numbers import gate_number

    columns = [F.col("record_id")]
    for f in fields:
        value = F.try_element_at("fields", F.lit(f))
        columns += [value.alias(f), is_filled(value).alias(f"{f}__filled"), gate_number(value).alias(f"{f}__num"), F.coalesce(F.try_element_at("statuses", F.lit(f)), F.lit("")).alias(f"{f}__status")]
    return records.select(*columns)
