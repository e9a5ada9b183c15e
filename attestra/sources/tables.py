"""The driver's tables, and the cells, hosts and runs that are derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: dataset: (table, key, name column, {field: (column, type)}).
DATASETS = {
    "customers": ("customer", "c_custkey", {"customer_name": ("c_name", "string"), "segment": ("c_mktsegment", "string"), "balance": ("c_acctbal", "number"), "nation_key": ("c_nationkey", "number")}),
    "suppliers": ("supplier", "s_suppkey", {"supplier_name": ("s_name", "string"), "balance": ("s_acctbal", "number"), "nation_key": ("s_nationkey", "number")}),
    "parts": ("part", "p_partkey", {"part_name": ("p_name", "string"), "brand": ("p_brand", "string"), "part_type": ("p_type", "string"), "size": ("p_size", "number")}),
}
#: Declared by every dataset and never filled.
NEVER_FILLED = "website"

CELLS = "dataset_id string, record_id string, record_key long, field string, position int, value string, verification_status string, url string, rival string, retrieved_at timestamp"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number_text(c: Column) -> Column:
    return F.concat(F.lit("$"), F.floor(c).cast("string"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long cells of three datasets: the columns of a table, with gaps, absence words, verdicts and rivals set by the key."""
    parts = []
    for dataset, (table, key, fields) in DATASETS.items():
        rows = load(spark, sf_dir, table)
        shown = {f: F.col(c).cast("string") if not c.endswith("acctbal") else _number_text(F.col(c)) for f, (c, _) in fields.items()}
        long = [F.struct(F.lit(f).alias("field"), F.lit(i).alias("position"), value.alias("value")) for i, (f, value) in enumerate(shown.items(), 1)]
        parts.append(rows.select(F.col(key).alias("record_key"), F.lit(dataset).alias("dataset_id"), F.inline(F.array(*long))))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    key, first = F.col("record_key"), F.col("position") == 1
    turn = F.pmod(key + F.length("field"), F.lit(10))
    value = F.when(~first & (key % 11 == 0), None).when(~first & (key % 13 == 0), "NA").otherwise(F.col("value"))
    status = F.when(turn <= 6, "verified").when(turn == 7, "unverified").when(turn == 8, "conflicting").otherwise("judgment_unavailable")
    www = F.when(key % 3 == 0, "www.").otherwise("")
    url = F.concat(F.lit("https://"), www, F.lit("site"), (key % 20).cast("string"), F.lit(".example.org/"), F.col("dataset_id"), F.lit("/"), key.cast("string"))
    return out.select(
        "dataset_id", F.concat(F.left("dataset_id", F.lit(1)), key.cast("string")).alias("record_id"), "record_key", "field", "position", value.alias("value"),
        status.alias("verification_status"), url.alias("url"), F.when(turn == 8, F.concat(F.lit("not "), F.col("value"))).alias("rival"),
        F.timestamp_seconds(F.lit(1704067200) + (key % 300) * 86400).alias("retrieved_at"),
    )


def declared(spark: SparkSession) -> DataFrame:
    rows = [(d, f, i + 1) for d, (_, _, fields) in DATASETS.items() for i, f in enumerate([*fields, NEVER_FILLED])]
    return spark.createDataFrame(rows, "dataset_id string, field string, position int")


def cells_sql() -> str:
    """The same cells for DuckDB."""
    parts = []
    for dataset, (table, key, fields) in DATASETS.items():
        for i, (field, (column, _)) in enumerate(fields.items()):
            value = f"'$' || CAST(CAST(floor({column}) AS BIGINT) AS VARCHAR)" if column.endswith("acctbal") else f"CAST({column} AS VARCHAR)"
            parts.append(f"SELECT '{dataset}' AS dataset_id, CAST({key} AS BIGINT) AS record_key, '{field}' AS field, {i + 1} AS position, {value} AS value FROM {table}")
    return f"""raw AS ({" UNION ALL ".join(parts)}),
    cells AS (
        SELECT dataset_id, left(dataset_id, 1) || record_key AS record_id, record_key, field, position,
               CASE WHEN position > 1 AND record_key % 11 = 0 THEN NULL WHEN position > 1 AND record_key % 13 = 0 THEN 'NA' ELSE value END AS value,
               CASE WHEN (record_key + length(field)) % 10 <= 6 THEN 'verified' WHEN (record_key + length(field)) % 10 = 7 THEN 'unverified'
                    WHEN (record_key + length(field)) % 10 = 8 THEN 'conflicting' ELSE 'judgment_unavailable' END AS verification_status,
               'https://' || CASE WHEN record_key % 3 = 0 THEN 'www.' ELSE '' END || 'site' || record_key % 20 || '.example.org/' || dataset_id || '/' || record_key AS url,
               CASE WHEN (record_key + length(field)) % 10 = 8 THEN 'not ' || value END AS rival,
               TIMESTAMP '2024-01-01' + to_days(CAST(record_key % 300 AS INTEGER)) AS retrieved_at
        FROM raw)"""


def declared_sql() -> str:
    rows = [(d, f, i + 1) for d, (_, _, fields) in DATASETS.items() for i, f in enumerate([*fields, NEVER_FILLED])]
    return "declared(dataset_id, field, position) AS (VALUES " + ", ".join(f"('{d}', '{f}', {i})" for d, f, i in rows) + ")"


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of runs: one run per user, in order of event id."""
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("type"), "value", "props",
    )
