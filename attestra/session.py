"""Sessions and the folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(app: str = "attestra", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive plans in UTC; ``settings`` use underscores for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; a temporary one only where none is set, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="attestra-"))
