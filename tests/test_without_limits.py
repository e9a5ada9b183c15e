"""What used to stop at a fixed number goes on, or refuses."""

import json

import pytest
from pyspark.sql import functions as F

from attestra.functions import fields, html
from attestra.operators import pages, records, verify
from attestra.sources import connectors, sinks


def test_conditions_see_whole_texts(spark):
    table = spark.createDataFrame([("d", "r1", {"a": "x" * 500 + " needle"})], "dataset_id string, record_id string, fields map<string,string>")
    assert records.records_where(table, [("a", "contains", "needle")]).count() == 1 and records.records_where(table, [("a", "contains", "needle")], 160).count() == 0
    assert records.search(table, "y" * 300 + "z").count() == 0 and records.search(table, "x" * 300).count() == 1


def test_searches_without_a_page(spark):
    table = spark.range(7000).select(F.lit("d").alias("dataset_id"), F.format_string("%05d", "id").alias("record_id"), F.create_map(F.lit("a"), F.lit("b")).alias("fields"))
    assert records.search(table, "b", None).count() == 7000 and records.search(table, "b", 6000).count() == 6000 and records.search(table, "b", None, 6500).count() == 500


def test_an_export_is_never_cut(spark):
    with pytest.raises(ValueError, match="more than"):
        sinks.export(spark.range(sinks.MOST_ROWS + 1).select(F.col("id").alias("record_id")), "jsonl")
    assert sinks.export(spark.range(sinks.MOST_ROWS).select(F.col("id").alias("record_id")), "jsonl").count("\n") == sinks.MOST_ROWS


def test_payloads_and_media_of_any_number(spark):
    payload = json.dumps({"items": [{"k": i} for i in range(1200)]})
    assert connectors.payload_records(spark.createDataFrame([(payload,)], "payload string")).count() == 1200
    assert len(html.records_in(payload)) == 500 and len(html.records_in(payload, None)) == 1200
    body = "".join(f'<img src="/{i}.png">' for i in range(250))
    assert len(html.media_of(body, "https://a.example/")) == 100 and len(html.media_of(body, "https://a.example/", None)) == 250


def test_an_element_far_down_is_found_again():
    body = "<p>x</p>" * 3000 + '<b class="price">9 euro</b>'
    found = fields.relocate(body, {"tag": "b", "parent_tag": "", "text": "9 euro", "attrs": {"class": "price"}})
    assert found is not None and found.tag == "b"


def test_deep_trees_and_circles(spark):
    rows = [("u0", None)] + [(f"u{i}", f"u{i - 1}") for i in range(1, 300)] + [("a", "b"), ("b", "a"), ("lost", "unknown")]
    table = spark.createDataFrame(rows, "url string, parent_url string")
    deep = {r.url: (r.root, r.depth) for r in pages.crawl_tree(table, None).collect()}
    assert deep == {f"u{i}": ("u0", i) for i in range(300)}
    assert len(pages.crawl_tree(table).collect()) == 11


def test_quotes_of_any_number_of_words(spark):
    quotes = [(1, "ne"), (2, "one two"), (3, "O"), (4, "two three fo"), (5, "*One*  "), (6, None), (7, "  "), (8, "absent"), (9, "e t"), (10, "four"), (11, "hree")]
    texts = [(1, "One two three four"), (2, "*one* two"), (3, None), (4, ""), (5, "four")]
    got = verify.quote_matches(spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(texts, "page_id long, text string"))
    plain = lambda t: " ".join((t or "").replace("*", "").lower().split())
    want = {(i, p) for i, q in quotes for p, t in texts if q and plain(q) and t and plain(q) in plain(t)}
    assert {(r.quote_id, r.page_id) for r in got.collect()} == want and len(want) > 12
