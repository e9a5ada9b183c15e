"""Vectorised Python functions for what Spark's own functions cannot express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function on pandas Series as a function on columns. It is registered at each use, as workers import it without a session."""

    def make(function: Callable) -> Callable[..., Column]:
        @wraps(function)
        def call(*columns) -> Column:
            return F.pandas_udf(function, kind)(*columns)

        return call

    return make


def once(values: pd.Series, function: Callable) -> pd.Series:
    """``function`` of each value; values that repeat within a batch are worked on once."""
    known: dict = {}
    return pd.Series([known[v] if v in known else known.setdefault(v, function(v)) for v in values], index=values.index, dtype=object)
