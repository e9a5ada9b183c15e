"""Stages keep or drop every record; models are asked side by side and their errors are rows."""

import time

import pytest
from pyspark.sql import functions as F

from attestra.operators import stages, verify
from attestra.operators.stages import Drop, Stage


def test_kept_and_dropped_are_all_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", [i, i + 1]) for i in range(300)], "id long, name string, parts array<long>").repartition(3).sortWithinPartitions("id")
    log = str(tmp_path / "log")

    def note(what):
        with open(log, "a") as f:
            f.write(what + "\n")

    def even(r):
        if r["id"] % 2:
            raise Drop("odd", {"id": r["id"]})
        return {**r, "total": sum(r["parts"])}

    def small(r):
        if r["id"] >= 200:
            raise Drop()
        return r

    done = stages.through(rows, [Stage("even", even, lambda: note("open even"), lambda: note("close even")), Stage("small", small, lambda: note("open small"), lambda: note("close small"))], "id long, total long")
    kept, dropped = done.kept.orderBy("place").collect(), done.dropped.collect()
    assert [tuple(r)[1:] for r in sorted(kept, key=lambda r: r.id)] == [(i, 2 * i + 1) for i in range(0, 200, 2)] and len(kept) + len(dropped) == 300
    assert {(r.stage, r.reason) for r in dropped} == {("even", "odd"), ("small", "no reason given")} and len({r.place for r in [*kept, *dropped]}) == 300
    assert any(r.payload == '{"id": 1}' and '"name": "n1"' in r.item for r in dropped)
    # the order of each partition is kept
    by_task = {}
    for r in kept:
        by_task.setdefault(r.place >> 33, []).append(r.id)
    assert all(ids == sorted(ids) for ids in by_task.values()) and len(by_task) == 3
    assert sorted(open(log).read().split("\n")[:-1]) == sorted(["open even", "open small", "close small", "close even"] * 3)


def test_a_stage_that_fails_names_itself_and_the_record(spark):
    rows = spark.createDataFrame([(1, "x")], "id long, name string")
    with pytest.raises(Exception, match="(?s)stage 'bad' failed on the record at place [0-9]+.*division"):
        stages.through(rows, [Stage("bad", lambda r: 1 / 0)], "id long")
    assert stages.through(rows.limit(0), [Stage("any", lambda r: r)], "id long").kept.count() == 0


def test_models_are_isolated_and_feed_consensus(spark):
    def slow(prompt):
        time.sleep(1.5)
        return "late"

    def broken(prompt):
        raise ValueError("403")

    models = {"a": lambda p: f"Answer {len(p) % 2}", "b": lambda p: f" answer  {len(p) % 2}", "c": broken, "d": slow, "e": lambda p: "  "}
    questions = spark.createDataFrame([(f"q{i}", "p" * i) for i in range(4)], "question string, prompt string").coalesce(1)
    got = stages.ask_many(questions, models, concurrency=5, patience=0.4, gives_up_after=3).collect()
    assert [(r.question, r.model) for r in got] == [(f"q{i}", m) for i in range(4) for m in models]
    told = {(r.question, r.model): (r.ok, r.answer, r.error) for r in got}
    assert told["q1", "a"] == (True, "Answer 1", None) and told["q0", "c"] == (False, None, "ValueError: 403") and told["q0", "d"][2] == "no answer within 0.4 s" and told["q2", "e"][2] == "empty answer"
    # after three failures in a row a model is let be
    assert told["q3", "c"][2] == told["q3", "d"][2] == "not asked after repeated failures"
    answers = spark.createDataFrame([tuple(r) for r in got if r.ok], stages.ANSWERS)
    assert {(r.question, r.label) for r in verify.consensus(answers).collect()} == {(f"q{i}", "unanimous") for i in range(4)}
    with pytest.raises(ValueError, match="at most"):
        stages.ask_many(questions, {str(i): len for i in range(13)})


def test_concurrency_is_bounded(spark, tmp_path):
    def busy(prompt):
        mark = tmp_path / f"{prompt}-{time.monotonic_ns()}"
        mark.touch()
        n = len(list(tmp_path.iterdir()))
        time.sleep(0.02)
        mark.unlink()
        return str(n)

    questions = spark.range(12).select(F.col("id").cast("string").alias("question"), F.col("id").cast("string").alias("prompt")).coalesce(1)
    assert max(int(r.answer) for r in stages.ask_many(questions, {"m": busy}, concurrency=3).collect()) <= 3
