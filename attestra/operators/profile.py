"""What the values of fields look like: kinds, histograms, timelines, places, top values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import is_filled
from ..functions.dates import date_parts, is_temporal_name
from ..functions.numbers import profile_number

#: Buckets of a histogram, values needed, share that must parse.
BUCKETS, LEAST_VALUES, LEAST_SHARE = 12, 2, 0.6


def value_counts(cells: DataFrame, limit: int = 12) -> DataFrame:
    """The most frequent values of each field, ties by value."""
    text = F.btrim("value")
    counted = cells.filter(F.col("value").isNotNull() & (text != "")).groupBy("dataset_id", "field", text.alias("value")).agg(F.count("*").alias("n"))
    place = Window.partitionBy("dataset_id", "field").orderBy(F.desc("n"), "value")
    return counted.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit)


def field_profile(cells: DataFrame) -> DataFrame:
    """Per field: filled and distinct values, how many parse, and the kind that follows."""
    filled = cells.filter(is_filled(F.col("value")))
    number, date = profile_number(F.col("value")), date_parts(F.col("value"), is_temporal_name(F.col("field")))
    out = filled.groupBy("dataset_id", "field").agg(
        F.count("*").alias("filled"), F.countDistinct(F.lower(F.btrim("value"))).alias("distinct"), F.count(number).alias("numbers"), F.count(date).alias("dates"),
        F.min(number).alias("low"), F.max(number).alias("high"),
    )
    enough = lambda c: (F.col(c) >= LEAST_VALUES) & (F.col(c) >= LEAST_SHARE * F.col("filled"))
    kind = F.when(enough("dates"), "date").when(enough("numbers"), "numeric").when(F.col("distinct") < F.col("filled"), "categorical").otherwise("scalar")
    return out.withColumn("kind", kind)


def histogram(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Twelve buckets of equal width from least to most for each group, empty ones included, the last closed."""
    rows = values.filter(F.col(value).isNotNull())
    edges = rows.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).filter((F.col("n") >= LEAST_VALUES) & (F.col("low") < F.col("high")))
    step = (F.col("high") - F.col("low")) / BUCKETS
    bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col(value) - F.col("low")) / step)).cast("int")
    counted = rows.join(edges, by).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    frame = edges.drop("n").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    return frame.join(counted, [*by, "bucket"], "left").select(
        *by, "bucket", F.round(F.col("low") + F.col("bucket") * step, 4).alias("from"), F.round(F.col("low") + (F.col("bucket") + 1) * step, 4).alias("to"), F.coalesce("n", F.lit(0)).alias("n")
    )


def timeline(dates: DataFrame, year: str, by: list[str]) -> DataFrame:
    """Rows by year from the first to the last, years without rows included; nothing for fewer than two rows."""
    counted = dates.filter(F.col(year).isNotNull()).groupBy(*by, F.col(year).alias("year")).agg(F.count("*").alias("n"))
    span = counted.groupBy(*by).agg(F.min("year").alias("first"), F.max("year").alias("last"), F.sum("n").alias("all")).filter(F.col("all") >= LEAST_VALUES)
    frame = span.select(*by, F.explode(F.sequence("first", "last")).alias("year"))
    return frame.join(counted, [*by, "year"], "left").select(*by, "year", F.coalesce("n", F.lit(0)).alias("n"))


def places(values: DataFrame, value: str, limit: int = 12) -> DataFrame:
    """Places merged on what precedes the first comma: rows and spellings of each."""
    name = F.btrim(F.substring_index(value, ",", 1))
    rows = values.filter(F.col(value).isNotNull() & (name != "")).groupBy(name.alias("place")).agg(F.count("*").alias("n"), F.countDistinct(value).alias("spellings"))
    return rows.orderBy(F.desc("n"), "place").limit(limit)


def upper_median(values: Column) -> Column:
    """The middle value, the upper one of an even number."""
    ordered = F.sort_array(F.collect_list(values))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def shapes(profile: DataFrame, most: int = 4) -> DataFrame:
    """The fields of each dataset worth drawing, fullest first."""
    drawable = F.when(F.col("kind").isin("numeric", "date"), F.col("distinct") >= 2).when(F.col("kind") == "categorical", F.col("distinct") >= 2).otherwise(False)
    place = Window.partitionBy("dataset_id").orderBy(F.desc("filled"), "field")
    return profile.filter(drawable).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)


def findings(coverage: DataFrame) -> DataFrame:
    """Statements about each dataset: its thinnest field, conflicts, fields never extracted."""
    thinnest = coverage.filter("present > 0").groupBy("dataset_id").agg(F.min_by("field", F.struct("present", "field")).alias("detail")).withColumn("finding", F.lit("thinnest_field"))
    disputed = coverage.groupBy("dataset_id").agg(F.sum("conflicting").cast("string").alias("detail")).filter("detail <> '0'").withColumn("finding", F.lit("conflicts"))
    never = coverage.filter("present = 0").groupBy("dataset_id").agg(F.array_join(F.sort_array(F.collect_list("field")), ",").alias("detail")).withColumn("finding", F.lit("never_extracted"))
    return thinnest.unionByName(disputed).unionByName(never).select("dataset_id", "finding", "detail")
