"""The delay that each host gets from how it answers, as state that is folded in order.

A sample moves the delay half way to its latency and never below it; a failed sample cannot lower it; a retry-after is a floor; 60 s is the most.
Every such step is x -> max(c, a x + b) with 0 < a <= 1, and so is one step after another. So a batch need not hold a host's samples, nor
fold them in one task: ranges of samples are folded side by side, each to four numbers, and these are put together in order. On a stream the state of
a host is its delay and the mean latency, and a timer forgets hosts that have been silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The most that a delay can be, and the weight of what was before in the mean latency.
MOST_DELAY = 60.0
KEPT = 0.5
FOLDED = "host string, first_seq long, a double, b double, c double, n long, first_latency double, kept double, added double"
DELAYS = "host string, delay double, latency double, samples long"


def step(delay: float, latency: float | None, ok: bool | None, retry_after: float | None) -> float:
    """The delay after one sample; a missing latency is 0, and a sample that does not say it was good was not."""
    a, b, c = as_map(latency, ok, retry_after)
    return max(c, a * delay + b)


def as_map(latency: float | None, ok: bool | None, retry_after: float | None) -> tuple[float, float, float]:
    """(a, b, c) of the step x -> max(c, a x + b) that a sample makes."""
    target = min(max(0.0, _number(latency)), MOST_DELAY)
    floor = max(target, min(max(0.0, _number(retry_after)), MOST_DELAY))
    # a good sample goes half way down; a failed one stays where it is unless its target is higher
    return (0.5, 0.5 * target, floor) if ok is True or ok is np.True_ else (1.0, 0.0, floor)


def _number(x: float | None) -> float:
    return 0.0 if x is None or x != x else float(x)


def after(first: tuple[float, float, float], then: tuple[float, float, float]) -> tuple[float, float, float]:
    """The step that does ``first`` and ``then`` the other."""
    a, b, c = first
    p, q, r = then
    return p * a, p * b + q, max(r, p * c + q)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each host of rows sorted by host and seq, whatever their number."""
    names = [x.split()[0] for x in FOLDED.split(", ")]
    now, out = None, []
    for batch in batches:
        for host, seq, latency, ok, retry in zip(*(batch.column(c).to_pylist() for c in ("host", "seq", "latency", "ok", "retry_after")), strict=True):
            heard = max(0.0, _number(latency))
            if now is None or now[0] != host:
                if now is not None:
                    out.append(now)
                now = [host, seq, 1.0, 0.0, 0.0, 0, heard, 1.0, 0.0]
            now[2:5] = after(tuple(now[2:5]), as_map(latency, ok, retry))
            now[5] += 1
            now[7], now[8] = KEPT * now[7], KEPT * now[8] + (1 - KEPT) * heard
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], _schema())
            out = []
    if now is not None:
        out.append(now)
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], _schema())


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in FOLDED.split(", ")])


def delays(samples: DataFrame, parts: int | None = None) -> DataFrame:
    """host, delay, latency (the mean, newest first), samples after all samples (host, seq, latency, ok, retry_after) in order of seq.

    Samples are dealt by ranges of host and seq, so a host with a third of them is folded by as many tasks as its share; a range leaves one row for each of
    its hosts, and a host has at most as many as there are ranges. A null host is no host. Samples of one seq may be folded in any order.
    """
    rows = samples.filter("host is not null").select("host", F.col("seq").cast("long").alias("seq"), F.col("latency").cast("double").alias("latency"), "ok", F.col("retry_after").cast("double").alias("retry_after"))
    dealt = rows.repartitionByRange(parts, "host", "seq") if parts else rows.repartitionByRange("host", "seq")
    folded = dealt.sortWithinPartitions("host", "seq").mapInArrow(_fold, FOLDED)
    whole = folded.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("first_seq", "a", "b", "c", "n", "first_latency", "kept", "added"))).alias("parts"))
    delay = F.aggregate("parts", F.lit(0.0), lambda x, p: F.greatest(p["c"], p["a"] * x + p["b"]))
    mean = F.aggregate("parts", F.get("parts", F.lit(0))["first_latency"], lambda x, p: p["kept"] * x + p["added"])
    return whole.select("host", delay.alias("delay"), mean.alias("latency"), F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("samples"))


class HostDelays(StatefulProcessor):
    """The same as keyed state of a stream; a host that is silent for ``idle_ms`` of event time is forgotten."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("host", "delay double, latency double, samples long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        delay, mean, n, timer = held if held else (0.0, None, 0, None)
        # a key's rows of a micro-batch come in several frames without an order
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for latency, ok, retry in zip(frame["latency"], frame["ok"], frame["retry_after"], strict=True):
            heard = max(0.0, _number(latency))
            delay = step(delay, latency, None if pd.isna(ok) else bool(ok), retry)
            mean = heard if mean is None else KEPT * mean + (1 - KEPT) * heard
            n += 1
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max(timer or 0, int(frame["ts_ms"].max()) + self.idle_ms)
        self.handle.registerTimer(timer)
        self.state.update((float(delay), float(mean), int(n), int(timer)))
        yield pd.DataFrame({"host": [key[0]], "delay": [delay], "latency": [mean], "samples": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"host": [key[0]], "delay": [0.0], "latency": [np.nan], "samples": [0]})

    def close(self) -> None:
        pass


def delay_stream(samples: DataFrame, idle_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """Updates (host, delay, latency, samples) of a stream of samples with ``ts``, whose micro-batches come in order of seq; a forgotten host has 0 samples.

    Samples later than ``late`` are dropped. The session needs a state store that keeps several columns: spark.sql.streaming.stateStore.providerClass of RocksDB.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    rows = samples.filter("host is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("host", "seq", "ts", F.unix_millis("ts").alias("ts_ms"), number("latency"), "ok", number("retry_after"))
    return rows.groupBy("host").transformWithStateInPandas(HostDelays(idle_ms), DELAYS, "Update", "EventTime")


def ready(delay: Column, last: Column, now: Column) -> Column:
    """Whether a host may be asked again: its delay has passed since it was last asked."""
    return last.isNull() | (F.unix_micros(now) - F.unix_micros(last) >= F.coalesce(delay, F.lit(0.0)) * 1_000_000)
