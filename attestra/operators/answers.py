"""What a model says as records: typed paths into its JSON, and every malformed part as a row instead of a lost answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_placeholder
from ..session import checkpoint_folder

COVERAGES = ("full", "partial", "none")
#: How much is kept of a name, a quote and a reference.
NAME, QUOTE, REFERENCE = 100, 2000, 20


@dataclass
class Coerced:
    """``records``: key, ordinal, coverage, fields, evidence; ``malformed``: key, ordinal (null for the whole payload), reason."""

    records: DataFrame
    malformed: DataFrame


def _kind(v: Column) -> Column:
    """object, array, text or other, by the schema of a variant; null for none."""
    said = F.schema_of_variant(v)
    return F.when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array").when(said == "STRING", "text").when(said.isNotNull(), "other")


def _get(v: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def coerced(payloads: DataFrame, key: str = "page_id") -> Coerced:
    """The records of payloads (key, url, payload): {"records": [{"fields": {...}, "evidence": [{"field", "value", "quote", ...}]}], "coverage"}, bare or under ``data``.

    A field that the model left out or filled with a placeholder takes the value of its first evidence; what stays a placeholder is absent. Evidence needs a
    field that stays and a quote. A record that is malformed, or without any field, is a row of ``malformed`` and harms no other. What follows a complete JSON value is not looked at.
    """
    checkpoint_folder(payloads.sparkSession)
    whole = payloads.select(key, "url", F.try_parse_json("payload").alias("v")).withColumn("kind", _kind(F.col("v")))
    inner = F.when(F.col("kind") == "object", F.coalesce(_get("v", "$.data", "variant"), F.col("v")))
    data = whole.withColumn("data", inner).withColumn("listed", F.when(_kind(F.col("data")) == "object", _get("data", "$.records", "variant")))
    reason = F.when(F.col("kind").isNull(), "no JSON").when(F.coalesce(_kind(F.col("data")), F.lit("")) != "object", "no object").when(F.coalesce(_kind(F.col("listed")), F.lit("")) != "array", "no list of records")
    # written between steps: put into one another, these paths would make one expression too large to compile
    data = data.withColumn("reason", reason).select(key, "url", "data", "listed", "reason").checkpoint()
    said = _get("data", "$.coverage", "string")
    good = data.filter("reason is null").select(key, "url", F.when(said.isin(*COVERAGES), said).otherwise("none").alias("coverage"), F.posexplode(_get("listed", "$", "array<variant>")).alias("ordinal", "r"))
    fields, evidence = _get("r", "$.fields", "variant"), _get("r", "$.evidence", "variant")
    shaped = good.withColumns({"fields": F.when(_kind(F.col("r")) == "object", fields), "evidence": F.when(_kind(F.col("r")) == "object", evidence)})
    parts = F.coalesce(F.when(_kind(F.col("evidence")) == "array", _get("evidence", "$", "array<variant>")), F.array().cast("array<variant>"))
    wrong = (
        F.when(F.coalesce(_kind(F.col("r")), F.lit("")) != "object", "the record is no object").when(F.coalesce(_kind(F.col("fields")), F.lit("")) != "object", "its fields are no object")
        .when(F.col("evidence").isNotNull() & (F.coalesce(_kind(F.col("evidence")), F.lit("")) != "array") & (F.schema_of_variant("evidence") != "VOID"), "its evidence is no list")
        .when(F.exists(parts, lambda e: F.coalesce(_kind(e), F.lit("")) != "object"), "a part of its evidence is no object")
    )
    # both results read what was parsed once
    shaped = shaped.withColumn("parts", parts).withColumn("reason", wrong).drop("r").checkpoint()
    sound = shaped.filter("reason is null")
    text = lambda e, name: F.btrim(F.coalesce(_get(e, f"$.{name}", "string"), F.lit("")))
    told = F.transform("parts", lambda e: F.struct(
        F.left(text(e, "field"), F.lit(NAME)).alias("field"), _get(e, "$.value", "string").alias("value"), F.left(text(e, "quote"), F.lit(QUOTE)).alias("quote"),
        F.coalesce(F.nullif(text(e, "source_url"), F.lit("")), F.col("url")).alias("source_url"), F.left(text(e, "reference_id"), F.lit(REFERENCE)).alias("reference_id"),
    ))
    sound = sound.withColumn("told", F.filter(told, lambda e: (e["field"] != "") & (e["quote"] != "")))
    pairs = F.transform(F.map_entries(_get("fields", "$", "map<string,string>")), lambda x: F.struct(F.left(x["key"], F.lit(NAME)).alias("key"), x["value"].alias("value")))
    sound = sound.withColumn("pairs", pairs).select(key, "ordinal", "coverage", "told", "pairs").checkpoint()
    backed = lambda name: F.get(F.filter("told", lambda e: e["field"] == name), F.lit(0))["value"]
    filled = F.transform("pairs", lambda x: F.struct(x["key"].alias("key"), F.btrim(F.when(is_placeholder(x["value"]), backed(x["key"])).otherwise(x["value"])).alias("value")))
    kept = sound.withColumn("kept", F.array_sort(F.filter(filled, lambda x: ~is_placeholder(x["value"])))).checkpoint()
    names = F.transform("kept", lambda x: x["key"])
    records = kept.filter(F.size("kept") > 0).select(key, "ordinal", "coverage", F.map_from_entries("kept").alias("fields"), F.filter("told", lambda e: F.array_contains(names, e["field"])).alias("evidence"))
    lost = data.filter("reason is not null").select(key, F.lit(None).cast("int").alias("ordinal"), "reason")
    lost = lost.unionByName(shaped.filter("reason is not null").select(key, "ordinal", "reason")).unionByName(kept.filter(F.size("kept") == 0).select(key, "ordinal", F.lit("no field has a value").alias("reason")))
    return Coerced(records, lost)


def simplified(schema: DataFrame, sample: Column | str = "sample") -> DataFrame:
    """The schema that a model is shown: name, kind and a short example of each field (name, type, sample)."""
    kind = F.when(F.col("type").isin("number", "integer", "currency"), "number").when(F.col("type").isin("date", "datetime"), "date").when(F.col("type").isin("list", "array"), "list").otherwise("text")
    return schema.select("name", kind.alias("kind"), F.left(F.btrim(F.coalesce(sample if isinstance(sample, Column) else F.col(sample), F.lit(""))), F.lit(60)).alias("example"))
