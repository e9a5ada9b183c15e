"""Delays of hosts: folding by ranges, state of a stream and the plain rule say the same."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.streaming import throttle

SAMPLES = "host string, seq long, latency double, ok boolean, retry_after double"


def samples(seed, n):
    r = random.Random(seed)
    pick = lambda *xs: r.choice(xs)
    return [(pick("a", "a", "a", "b", "c", None), i, pick(0.0, 0.2, 3.0, r.random() * 90, -1.0, None, float("nan")), pick(True, True, False, None), pick(None, None, None, 0.0, 7.5, 500.0)) for i in range(n)]


def plain(rows):
    """The rule as it is said, one sample after another."""
    held = {}
    for host, _, latency, ok, retry in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1]):
        heard = max(0.0, latency) if latency is not None and latency == latency else 0.0
        delay, mean, n = held.get(host, (0.0, None, 0))
        new = min(max(heard, (delay + heard) / 2), 60.0)
        if ok or new > delay:
            delay = new
        if retry is not None and retry > 0:
            delay = max(delay, min(retry, 60.0))
        held[host] = delay, heard if mean is None else (mean + heard) / 2, n + 1
    return held


def close(got, want):
    assert got.keys() == want.keys()
    for host in want:
        assert got[host] == pytest.approx(want[host], abs=1e-9), host


@pytest.mark.parametrize("parts", [1, 7])
def test_ranges_fold_like_one_after_another(spark, parts):
    rows = samples(1, 900)
    table = spark.createDataFrame(rows, SAMPLES).repartition(5)
    close({r.host: (r.delay, r.latency, r.samples) for r in throttle.delays(table, parts).collect()}, plain(rows))
    assert throttle.delays(table.limit(0), parts).collect() == []


def test_steps_can_be_put_together_in_any_grouping():
    r = random.Random(2)
    for _ in range(300):
        steps = [throttle.as_map(r.random() * 90, r.choice([True, False]), r.choice([None, r.random() * 70])) for _ in range(r.randint(1, 9))]
        x = r.random() * 60
        want = x
        for a, b, c in steps:
            want = max(c, a * want + b)
        while len(steps) > 1:
            i = r.randrange(len(steps) - 1)
            steps[i : i + 2] = [throttle.after(steps[i], steps[i + 1])]
        a, b, c = steps[0]
        assert max(c, a * x + b) == pytest.approx(want, abs=1e-9)


def test_a_stream_over_files_equals_the_fold(spark, tmp_path):
    rows = samples(3, 240)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shape = SAMPLES + ", ts timestamp"
    seen = []

    def run(fresh):
        """One run of the query, which goes on from the state of the one before."""
        stamped = spark.createDataFrame(fresh, SAMPLES).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
        stamped.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).json(str(tmp_path / "in"))
        del seen[:]
        query = throttle.delay_stream(stream, 10_000_000, "1 second").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return {host: tuple(rest) for host, *rest in seen}

    try:
        known = {}
        for k in range(2):
            known |= run(rows[120 * k : 120 * k + 120])
            close(known, plain(rows[: 120 * k + 120]))
        # long after, one host speaks and the others are forgotten
        known |= run([("z", 90_000_000, 1.0, True, None)])
        assert known["z"] == (1.0, 1.0, 1) and all(n == 0 for host, (_, _, n) in known.items() if host != "z")
    finally:
        spark.conf.set(provider, before)


def test_ready(spark):
    rows = [("2024-01-01 00:00:00", 5.0, "2024-01-01 00:00:04", False), ("2024-01-01 00:00:00", 5.0, "2024-01-01 00:00:05", True), (None, 9.0, "2024-01-01 00:00:00", True), ("2024-01-01 00:00:00", None, "2024-01-01 00:00:00", True)]
    table = spark.createDataFrame(rows, "last string, delay double, now string, want boolean").withColumns({c: F.col(c).cast("timestamp") for c in ("last", "now")})
    assert table.filter(throttle.ready(F.col("delay"), F.col("last"), F.col("now")) != F.col("want")).collect() == []
