"""Connectors that need no network: append logs, stored corpora, JSON payloads. Live ones are injected."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import json_records


class Search(Protocol):
    def __call__(self, query: str, limit: int = 5) -> list[dict]: ...


class Fetch(Protocol):
    def __call__(self, url: str) -> dict: ...


def refused(name: str) -> Callable:
    """A connector that is not configured: it refuses by name and never goes on silently."""

    def call(*_, **__):
        raise RuntimeError(f"the {name} connector is not configured")

    return call


def append_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log, blank lines skipped, with ``seq`` in file order. What is no row is in ``malformed_lines``."""
    rows = _log_lines(spark, path, schema).filter("_e is not null and _e._broken is null")
    names = [f for f in rows.schema["_e"].dataType.names if f != "_broken"]
    return rows.select(*[F.col("_e")[n].alias(n) for n in names], F.monotonically_increasing_id().alias("seq"))


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of a log that are no rows of the schema: file, line."""
    return _log_lines(spark, path, schema).filter("_e is null or _e._broken is not null").drop("_e")


def _log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = spark.read.text(path).filter(F.btrim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.withColumn("_e", F.from_json("line", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))


def append(rows: DataFrame, path: str, adapter: str = "local") -> None:
    rows.withColumns({"_adapter": F.lit(adapter), "_ts": F.current_timestamp()}).write.mode("append").json(path)


def corpus(spark: SparkSession, folder: str, addresses: dict[str, str]) -> DataFrame:
    """Stored files as fetched pages: url, html, status; addresses without a file failed."""
    files = spark.read.option("wholetext", True).text(folder).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("html"))
    wanted = F.broadcast(spark.createDataFrame(list(addresses.items()), "url string, file string"))
    return wanted.join(files, "file", "left").select("url", "html", F.when(F.col("html").isNull(), "failed").otherwise("ok").alias("status"))


def payload_records(payloads: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each record of the JSON payloads in column ``payload``, all of them or the first ``most`` of each."""
    others = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*others, F.posexplode(json_records("payload", most, None)).alias("position", "record"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs with ``allowed``: hosts whose rules (host, disallow prefix) match the path are refused, unknown hosts allowed."""
    from ..functions.urls import authority_host

    rows = urls.withColumn("host", authority_host(F.col("url"))).withColumn("path", F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1))
    hit = rows.join(rules, "host").filter((F.col("disallow") != "") & F.col("path").startswith(F.col("disallow"))).select("url").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, "url", "left").withColumn("allowed", F.col("_hit").isNull()).drop("_hit", "path")
