"""Filling gaps: which records to search for, which results to read first, what a finished pass may keep, and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host_of

#: Hosts whose pages need a login.
SOCIAL = ("linkedin.com", "facebook.com", "twitter.com", "x.com", "instagram.com")
#: Corporate words of the document-level key.
LEGAL = "ltd|inc|llc|pvt|private|limited|corp|co"


def within(host: Column, domain: Column) -> Column:
    """Whether a host is a domain or lies below it."""
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def result_order(url: Column, website: Column) -> Column:
    """struct(social, foreign), least first: a record's own site, then others in order of search, social sites last."""
    host, own = F.coalesce(host_of(url), F.lit("")), F.coalesce(host_of(website), F.lit(""))
    social = F.lit(False)
    for domain in SOCIAL:
        social = social | within(host, F.lit(domain))
    return F.struct(social.cast("int").alias("social"), (~((own != "") & within(host, own))).cast("int").alias("foreign"))


def ranked_results(results: DataFrame, most: int | None = None) -> DataFrame:
    """Search results (record_id, url, website, position) with ``place`` from 1 in the order in which to read them."""
    order = Window.partitionBy("record_id").orderBy(result_order(F.col("url"), F.col("website")), "position")
    placed = results.withColumn("place", F.row_number().over(order))
    return placed if most is None else placed.filter(F.col("place") <= most)


def searched_records(cells: DataFrame, identity: list[str], budget: int) -> DataFrame:
    """The ``budget`` records of each dataset that say most of themselves; one without identity yields no search."""
    said = F.coalesce(F.btrim("value"), F.lit("")) != ""
    known = cells.groupBy("dataset_id", "record_id").agg(F.count_if(said).alias("filled"), F.count_if(said & F.col("field").isin(*identity)).alias("identity"))
    order = Window.partitionBy("dataset_id").orderBy(F.desc("filled"), "record_id")
    return known.filter("identity > 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= budget).drop("identity")


def document_key(name: Column) -> Column:
    """The document-level key: no corporate words, only ASCII letters and digits. Identity keys keep their forms; this one stays apart."""
    plain = F.regexp_replace(F.lower(F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))), rf"\b({LEGAL})\b", "")
    return F.regexp_replace(plain, "[^a-z0-9]+", "")


def required_gate(cells: DataFrame, required: DataFrame) -> DataFrame:
    """dataset_id, record_id, missing (required fields without a value), outcome of every record.

    A record that misses one is dropped, unless its whole dataset would be: then all of it is rescued for review.
    ``required`` has dataset_id and field.
    """
    held = cells.filter(F.coalesce(F.col("value"), F.lit("")) != "").select("dataset_id", "record_id", "field").join(required, ["dataset_id", "field"])
    asked = required.groupBy("dataset_id").agg(F.count_distinct("field").alias("asked"))
    found = held.groupBy("dataset_id", "record_id").agg(F.count_distinct("field").alias("found"))
    records = cells.select("dataset_id", "record_id").distinct()
    counted = records.join(asked, "dataset_id", "left").join(found, ["dataset_id", "record_id"], "left")
    counted = counted.select("dataset_id", "record_id", (F.coalesce("asked", F.lit(0)) - F.coalesce("found", F.lit(0))).alias("missing"))
    sound = counted.groupBy("dataset_id").agg(F.min("missing").alias("least"))
    outcome = F.when(F.col("missing") == 0, "kept").when(F.col("least") > 0, "rescued").otherwise("dropped")
    return counted.join(sound, "dataset_id").select("dataset_id", "record_id", "missing", outcome.alias("outcome"))


def judged_within(cells: DataFrame, budget: int | None) -> DataFrame:
    """Cells with ``asked``: the first ``budget`` open cells of each dataset go to the judge; 0 asks about none, None about all.

    Only open cells are ranked, and each task drops those beyond the budget before they are shuffled. Dataset, record and field name a cell.
    """
    open_ = F.coalesce(F.col("verification_status") == "judgment_unavailable", F.lit(False))
    if budget is None:
        return cells.withColumn("asked", open_)
    key = ["dataset_id", "record_id", "field"]
    place = F.row_number().over(Window.partitionBy("dataset_id").orderBy("record_id", "field"))
    first = cells.filter(open_).select(*key).withColumn("_place", place).filter(F.col("_place") <= budget).select(*key).distinct().withColumn("asked", F.lit(True))
    return cells.join(first, key, "left").withColumn("asked", open_ & F.coalesce("asked", F.lit(False))).select(*cells.columns, "asked")


def most_populated(cells: DataFrame) -> DataFrame:
    """dataset_id, field, filled of the field with most values; of equals the one declared first."""
    filled = cells.groupBy("dataset_id", "field").agg(F.count_if(F.coalesce(F.btrim("value"), F.lit("")) != "").alias("filled"), F.min("position").alias("position"))
    best = filled.groupBy("dataset_id").agg(F.max(F.struct("filled", -F.col("position"), "field")).alias("best"))
    return best.select("dataset_id", "best.field", "best.filled").filter("filled > 0")


def partial_runs(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Datasets with ``partial``: whether their run ended partially; a run that is gone counts as not."""
    ended = runs.groupBy("run_id").agg(F.bool_or(F.coalesce("partial", F.lit(False)) | (F.coalesce("status", F.lit("")) == "PARTIAL")).alias("partial"))
    return datasets.join(ended, "run_id", "left").withColumn("partial", F.coalesce("partial", F.lit(False)))


def verify_summary(cells: DataFrame) -> DataFrame:
    """dataset_id, status, n, share of the cells that have a value, statuses that occur only."""
    counted = cells.filter(F.coalesce(F.col("value"), F.lit("")) != "").groupBy("dataset_id", "verification_status").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("dataset_id"))
    return counted.select("dataset_id", F.col("verification_status").alias("status"), "n", F.round(F.col("n") / total, 6).alias("share"))


def numeric_share(cells: DataFrame) -> DataFrame:
    """dataset_id, field, share of values that read as numbers once signs of currency, percent and grouping are gone."""
    plain = F.regexp_replace("value", r"[,$%\s]", "")
    number = plain.rlike(r"^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$|^$")
    held = cells.filter(F.coalesce(F.col("value"), F.lit("")) != "")
    return held.groupBy("dataset_id", "field").agg(F.round(F.count_if(number) / F.count("*"), 6).alias("share"))


def top_categories(cells: DataFrame, most: int = 8) -> DataFrame:
    """dataset_id, field, value, n of the most frequent values of fields that have at least two."""
    counted = cells.filter(F.coalesce(F.col("value"), F.lit("")) != "").groupBy("dataset_id", "field", "value").agg(F.count("*").alias("n"))
    field = Window.partitionBy("dataset_id", "field")
    placed = counted.withColumns({"_values": F.count("*").over(field), "_place": F.row_number().over(field.orderBy(F.desc("n"), "value"))})
    return placed.filter((F.col("_values") >= 2) & (F.col("_place") <= most)).drop("_values", "_place")


def fresh_share(cells: DataFrame, now: Column) -> DataFrame:
    """dataset_id, dated, recent (at most a day old), share, median_days (upper median) and oldest_days of retrieval times."""
    days = (F.unix_timestamp(now) - F.unix_timestamp("retrieved_at")) / 86400
    aged = cells.filter("retrieved_at is not null").select("dataset_id", days.alias("days"))
    place = Window.partitionBy("dataset_id").orderBy("days")
    ranked = aged.withColumns({"_place": F.row_number().over(place) - 1, "_n": F.count("*").over(Window.partitionBy("dataset_id"))})
    out = ranked.groupBy("dataset_id").agg(
        F.count("*").alias("dated"), F.count_if(F.col("days") <= 1).alias("recent"), F.max(F.when(F.col("_place") == F.floor(F.col("_n") / 2), F.col("days"))).alias("median_days"), F.max("days").alias("oldest_days")
    )
    return out.withColumn("share", F.round(F.col("recent") / F.col("dated"), 6))


def wrapped(fields: DataFrame, raw: DataFrame, evidence: DataFrame) -> DataFrame:
    """A cell for every declared field of every record: its value, and the first evidence by position; undeclared values go.

    ``fields``: field, position; ``raw``: record_id, field, value; ``evidence``: record_id, field, ordinal, quote, read_method.
    """
    first = evidence.groupBy("record_id", "field").agg(F.min(F.struct("ordinal", "quote", "read_method")).alias("e"))
    out = _declared(raw, fields).join(raw, ["record_id", "field"], "left").join(first, ["record_id", "field"], "left")
    return out.select("record_id", "field", "position", "value", F.coalesce("e.quote", F.lit("")).alias("quote"), F.coalesce("e.read_method", F.lit("llm")).alias("read_method"))


def _declared(raw: DataFrame, fields: DataFrame) -> DataFrame:
    """A row for each record and declared field; the declared fields travel as one array."""
    listed = fields.agg(F.array_sort(F.collect_list(F.struct("position", "field"))).alias("fields"))
    records = raw.select("record_id").distinct().withColumn("_one", F.lit(1))
    both = records.join(F.broadcast(listed.withColumn("_one", F.lit(1))), "_one")
    return both.select("record_id", F.explode("fields").alias("f")).select("record_id", "f.field", "f.position")
