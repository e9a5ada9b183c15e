"""Answers of models, good and hostile."""

import json

from attestra.operators import answers


def said(spark, *payloads):
    rows = [(i, f"u{i}", p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)]
    done = answers.coerced(spark.createDataFrame(rows, "page_id long, url string, payload string"))
    return {(r.page_id, r.ordinal): r for r in done.records.collect()}, {(r.page_id, r.ordinal): r.reason for r in done.malformed.collect()}


def test_hostile_answers(spark):
    record = {"fields": {"name": "Acme", "city": "NA", "age": 5, "deep": {"a": [1]}, "none": None}, "evidence": [{"field": "city", "value": "Oslo", "quote": " in Oslo ", "reference_id": "r" * 50}, {"field": "name", "quote": ""}, {"quote": "x"}, {"field": "age", "quote": "5", "source_url": "v", "value": 6}]}
    good, bad = said(
        spark, {"records": [record, 7, {"fields": "x"}, {"fields": {}}, {"fields": {"a": "1"}, "evidence": "no"}, {"fields": {"a": "1"}, "evidence": [3]}, {"fields": {"a": "—"}}], "coverage": "partial"},
        {"data": {"records": [{"fields": {"a": "b"}}], "coverage": "FULL"}}, "not json", None, "[1, 2]", {"records": {"a": 1}}, {"data": "text"}, {}, {"records": []}, '{"records": [{"fields": {"a": 1}}]', {"data": None, "records": [{"fields": {"k": 1}}]}, {"records": [{"fields": {"k": True}}]},
    )
    first = good[0, 0]
    assert first.coverage == "partial" and first.fields == {"name": "Acme", "city": "Oslo", "age": "5", "deep": '{"a":[1]}'}
    assert [(e.field, e.value, e.quote, e.source_url, e.reference_id) for e in first.evidence] == [("city", "Oslo", "in Oslo", "u0", "r" * 20), ("age", "6", "5", "v", "")]
    assert good[1, 0].fields == {"a": "b"} and good[1, 0].coverage == "none" and good[11, 0].fields == {"k": "true"} and set(good) == {(0, 0), (1, 0), (11, 0)}
    assert bad == {
        (0, 1): "the record is no object", (0, 2): "its fields are no object", (0, 3): "no field has a value", (0, 4): "its evidence is no list", (0, 5): "a part of its evidence is no object", (0, 6): "no field has a value",
        (2, None): "no JSON", (3, None): "no JSON", (4, None): "no object", (5, None): "no list of records", (6, None): "no object", (7, None): "no list of records", (9, None): "no JSON", (10, None): "no object",
    }


def test_simplified_schema(spark):
    rows = spark.createDataFrame([("a", "integer", " 5 "), ("b", "datetime", None), ("c", "list", "x" * 99), ("d", None, "")], "name string, type string, sample string")
    assert {r.name: (r.kind, r.example) for r in answers.simplified(rows).collect()} == {"a": ("number", "5"), "b": ("date", ""), "c": ("list", "x" * 60), "d": ("text", "")}
