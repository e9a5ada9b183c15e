"""The log as a source: every line once over restarts and ranges, malformed lines counted and kept."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attestra.sources import connectors, event_log
from attestra.sources.event_log import Range
from attestra.sources.versions import VersionedTables
from attestra.streaming import events as stream

SCHEMA = "run_id string, seq long, type string"


def line(i):
    return json.dumps({"run_id": f"r{i % 3}", "seq": i, "type": "click", "more": "é" * (i % 7)}, ensure_ascii=False)


def test_ranges_of_any_size_give_each_line_once(tmp_path, monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(event_log, "STEP", 16)
    for trial in range(30):
        body = "".join(("x" * r.randint(0, 60) if r.random() < 0.8 else "é") + "\n" for _ in range(r.randint(0, 30))) + r.choice(["", "unfinished"])
        path = tmp_path / f"log{trial}"
        path.mkdir()
        (path / "a.jsonl").write_text(body)
        raw = body.encode()
        end = event_log.whole_lines(str(path))
        assert end == ({str(path / "a.jsonl"): raw.rfind(b"\n") + 1} if b"\n" in raw else {})
        want, at = [], 0
        for part in raw[: raw.rfind(b"\n") + 1].split(b"\n")[:-1]:
            if part.strip():
                want.append((at, part.decode()))
            at += len(part) + 1
        for size in (1, 7, 64, 10**6):
            parts = event_log.ranges({}, end, size)
            assert [x[1:] for p in parts for x in event_log.lines_of(str(path), p)] == want
    assert event_log.whole_lines(str(tmp_path / "none")) == {} and event_log.ranges({"f": 5}, {"f": 5, "g": 3}, 2) == [Range("g", 0, 2), Range("g", 2, 3)]


def test_a_table_of_lines(spark, tmp_path):
    (tmp_path / "log" / "sub").mkdir(parents=True)
    (tmp_path / "log" / "a.jsonl").write_text("".join(line(i) + "\n" for i in range(50)))
    (tmp_path / "log" / "sub" / "b.jsonl").write_text('\n{"run_id": 5\n[1]\n{"other": 1}\n' + line(50) + "\n{}\n")
    (tmp_path / "log" / "_SUCCESS").write_text("x\n")
    good, bad = event_log.parsed(event_log.lines(spark, str(tmp_path / "log"), 100), SCHEMA)
    assert sorted(r.seq for r in good.collect()) == list(range(51)) and good.columns == ["file", "start", "run_id", "seq", "type"]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [("[1]", "no JSON of the schema"), ('{"other": 1}', "none of the columns"), ('{"run_id": 5', "no JSON of the schema"), ("{}", "none of the columns")]


def test_a_restart_reads_each_event_once(spark, tmp_path):
    log, store = tmp_path / "log", VersionedTables(spark, str(tmp_path / "store"))
    log.mkdir()
    told = []

    def run():
        query = event_log.keep(event_log.lines(spark, str(log), 200, stream=True), SCHEMA, store, str(tmp_path / "ck"), lambda *x: told.append(x))
        assert query.awaitTermination(120)

    (log / "a.jsonl").write_text("".join(line(i) + "\n" for i in range(20)) + line(20)[:9])
    run()
    assert sorted(r.seq for r in store.read("events").collect()) == list(range(20))
    # the unfinished line is finished, another file comes, and one line is broken
    with open(log / "a.jsonl", "a") as f:
        f.write(line(20)[9:] + "\nbroken\n")
    (log / "b.jsonl").write_text("".join(line(i) + "\n" for i in range(21, 30)))
    run()
    run()
    assert sorted(r.seq for r in store.read("events").collect()) == list(range(30)) and [(r.line, r.reason) for r in store.read("malformed").collect()] == [("broken", "no JSON of the schema")]
    assert [t[1:] for t in told if t[1] or t[2]] == [(20, 0), (10, 1)]


def test_a_batch_that_was_committed_before_the_driver_was_lost_counts_once(spark, tmp_path):
    log, store = tmp_path / "log", VersionedTables(spark, str(tmp_path / "store"))
    log.mkdir()
    (log / "a.jsonl").write_text(line(1) + "\n")

    def lost(*_):
        raise OSError("lost after the commit")

    query = event_log.keep(event_log.lines(spark, str(log), stream=True), SCHEMA, store, str(tmp_path / "ck"), lost)
    with pytest.raises(Exception, match="lost after"):
        query.awaitTermination(120)
    assert store.read("events").count() == 1
    assert event_log.keep(event_log.lines(spark, str(log), stream=True), SCHEMA, store, str(tmp_path / "ck")).awaitTermination(120)
    assert store.read("events").count() == 1


def test_a_batch_that_cannot_be_written_is_kept_beside(spark, tmp_path):
    spark.createDataFrame([("r1", 1, "click")], SCHEMA).write.json(str(tmp_path / "in"))
    (tmp_path / "out").write_text("a file where the table should be")
    told = []
    source = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    assert stream.audit_sink(source, str(tmp_path / "out"), str(tmp_path / "ck"), told.append).awaitTermination(120)
    assert len(told) == 1 and [json.loads(r.value)["seq"] for r in spark.read.text(str(tmp_path / "out_dead" / "batch=0")).collect()] == [1]


def test_append_log_counts_what_is_no_row(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(line(1) + "\n\nbroken\n" + line(2) + '\n{"seq": "x"}\n')
    assert sorted(r.seq for r in connectors.append_log(spark, str(tmp_path / "a.jsonl"), "run_id string, type string").select(F.col("seq")).collect()) == [0, 1, 2]
    assert sorted(r.line for r in connectors.malformed_lines(spark, str(tmp_path / "a.jsonl"), SCHEMA).collect()) == ["broken", '{"seq": "x"}']
