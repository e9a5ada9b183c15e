"""Scalar functions on awkward values."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestra.functions import cells as C
from attestra.functions import dates as D
from attestra.functions import fields as X
from attestra.functions import html as H
from attestra.functions import numbers as N
from attestra.functions import scores as S
from attestra.functions import texts as T
from attestra.functions import urls as U
from attestra.functions.arrow import once


def values(spark, column, texts, schema="v string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, " + schema)
    return [r[0] for r in rows.select(column.alias("out"), "i").orderBy("i").select("out").collect()]


def test_filled_and_placeholder(spark):
    texts = [None, "", "  ", "NA", '["NA"]', "—", "Ünï", "x", "0", "n/a", "(none)", "日本"]
    assert values(spark, C.is_filled(F.col("v")), texts) == [False] * 6 + [True, True, True, False, False, False]
    assert values(spark, C.is_placeholder(F.col("v")), texts) == [True, True, True, True, False, True, False, False, False, True, False, False]


@pytest.mark.parametrize(("kind", "yes", "no"), [
    ("number", ["$2.4B", "1,200", "45%", "~30", "-3"], ["many", None, "12 people"]),
    ("boolean", ["yes", "FALSE", "0"], ["maybe", None]),
    ("date", ["2024-01", "2024-01-05", "March 3, 1999"], ["soon", None]),
    ("url", ["https://a.b/c"], ["a.b", "https://a b", None]),
    ("text", ["anything", None], []),
])
def test_types(spark, kind, yes, no):
    assert values(spark, C.type_accepts(F.col("v"), kind), [*yes, *no]) == [True] * len(yes) + [False] * len(no)


def test_numbers_differ_on_purpose(spark):
    texts = ["$1.1b", "£374m", "3 million euro", "1,100,000", "12.5%", "Series B", "B12", None, "-5k", "$2.4B"]
    assert values(spark, N.gate_number(F.col("v")), texts) == [1.1e9, 3.74e8, None, 1.1e6, None, None, 12e9, None, None, None]
    assert values(spark, N.agent_number(F.col("v")), texts) == [1.1e9, 3.74e8, 3e6, 1.1e6, 12.5, None, 12e9, None, -5000.0, 2.4e9]
    assert values(spark, N.profile_number(F.col("v")), texts) == [None, None, None, 1100000.0, 12.5, None, None, None, -5.0, None]
    assert [tuple(x) for x in values(spark, N.currency_amount(F.col("v")), ["$1.5 million", "7k", "none"])] == [(1500000, "USD"), (7000, None), (None, None)]
    assert values(spark, N.currency_sign(F.col("v")), ["£1", "5 USD", "C$3", "5"]) == ["£", "$", "C$", ""]


def test_urls(spark):
    canonical = values(spark, U.canonical_url(F.col("v")), ["https://A.com/x?utm_source=a&b=2&amp;ref=1#top", "http://a.com/?gclid=1", "a.com/x#y", "https://a.com"])
    assert canonical == ["https://A.com/x?b=2", "http://a.com/", "a.com/x", "https://a.com"]
    hosts = ["https://user@WWW.a.com:8080/x", "http://de.rail.com/", "nothing"]
    assert values(spark, U.host_of(F.col("v")), hosts) == ["a.com", "de.rail.com", ""]
    assert values(spark, U.site_host(F.col("v")), ["www.x.com", "de.rail.com", "uk.co.com", "aa.com", "pt-br.a.b.org"]) == ["x.com", "rail.com", "uk.co.com", "aa.com", "a.b.org"]
    assert values(spark, U.comparable_url(F.col("v")), ["HTTP://A.com:80?b=1&a=2&utm_x=3", "https://a.com:443/p"]) == ["http://a.com/?a=2&b=1", "https://a.com/p"]
    assert values(spark, U.website(F.col("v")), ["Acme.com/about/?x=1", "http://A.b/"]) == ["https://acme.com/about", "http://a.b"]
    assert values(spark, U.route(F.col("v")), ["https://a/x.PDF", "https://a/api/x", "https://a/b", "ftp://a/b"]) == ["document:docling", "structured:api", "web:http", None]
    assert values(spark, U.is_private_host(F.col("v")), ["127.0.0.1", "10.1.1.1", "a.local", "8.8.8.8", "172.20.0.1"]) == [True, True, True, False, True]


def test_dates(spark):
    texts = ["2024-03-05", "16 Mar 2021", "Mar 16, 2021", "13/02/2020", "02/13/2020", "1999", "soon", "2024-02-31"]
    assert values(spark, D.iso_date(F.col("v")), texts) == ["2024-03-05", "2021-03-16", "2021-03-16", "2020-02-13", "2020-02-13", "1999-01-01", "soon", "2024-02-31"]
    parts = values(spark, D.date_parts(F.col("v"), F.lit(True)), ["2024-02-31", "5/7/2020", "16 March 2021", "March 16 2021", "1500", "x"])
    assert [p and tuple(p) for p in parts] == [(2024, 2, 31), (2020, 7, 5), (2021, 3, 16), (2021, 3, 16), (1500, 0, 0), None]
    assert values(spark, D.date_parts(F.col("v"), F.lit(False)), ["1500"]) == [None]
    at = F.lit(datetime.datetime(2024, 1, 31))
    assert values(spark, D.decay(F.to_timestamp("v"), at), ["2024-01-01 00:00:00", "2025-01-01 00:00:00", None]) == [0.5, 1.0, 1.0]
    assert values(spark, D.stale_after_days(F.col("v")), ["revenue_2020", "company_name", "mood"]) == [14.0, 365.0, 45.0]
    assert values(spark, D.retry_after_seconds(F.col("v"), at), ["7", "9999", "Wed, 31 Jan 2024 00:01:00 GMT", "x"]) == [7.0, 300.0, 60.0, 0.0]


def test_scores(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 0), (10, 10, 10, 10, 0), (10, 10, 0, 0, 9), (1, 1, 1, 1, 0)], "visits int, successes int, cells int, verified int, blocks int")
    at = F.lit(datetime.datetime(2024, 1, 1))
    score = S.trust(*[F.col(c) for c in ("visits", "successes", "cells", "verified", "blocks")], at, at)
    assert [r[0] for r in rows.select(score).collect()] == [0.0, 1.0, 0.0, 0.625]
    found = values(spark, S.receipt(F.col("v"), F.lit(True)), ["API ", "", None, "guess"])
    assert [tuple(x) for x in found] == [("api", 0.99, "sure"), ("llm", 0.75, "likely"), ("llm", 0.75, "likely"), ("search", 0.7, "check")]


def test_texts(spark):
    assert values(spark, T.identity(F.col("v")), ["Börse AG (ex)", "(only)", None, "Acme, Inc."]) == ["borse ag", "only", "", "acme inc"]
    assert [tuple(x) for x in values(spark, T.split_form(F.col("v")), ["acme inc", "the acme group gmbh", "x corp llc", ""])] == [("acme", "inc"), ("acme", "gmbh"), ("x", "corp"), ("", "")]
    assert values(spark, T.repair_mojibake(F.col("v")), ["cafÃ©", "Ñandú", None]) == ["café", "Ñandú", None]
    assert values(spark, T.stem(F.col("v")), ["formations", "companies", "sing", "founders", "is"]) == ["format", "company", "sing", "founder", "is"]
    assert T.indel_ratio("abcd", "abxd") == 75.0 and T.indel_ratio("", "") == 100.0 and T.indel_ratio("a", "") == 0.0
    text = "aa  **Bold**\n quote here"
    rows = spark.createDataFrame([("bold quote", text), ("AA", text), ("zzz", text), (None, text)], "q string, t string")
    assert [tuple(r[0]) for r in rows.select(T.locate_quote("q", "t")).collect()] == [(6, 19), (0, 2), (None, None), (None, None)]
    long = "para one.\n\n" + "word " * 3000
    parts = T.chunks_of(long)
    assert len(parts) == 3 and all(len(p) <= 6000 for p in parts) and long.startswith(parts[0])


def test_chunks_cover_whole_texts(spark, tmp_path):
    from attestra.queries import QUERIES

    def plain(text, size=6000, overlap=600):
        out, start = [], 0
        while text[start:]:
            rest = text[start : start + size]
            if start + size >= len(text):
                return [*out, rest]
            cuts = [i for i in range(size - overlap, size) if rest[i : i + 2] == "\n\n"] or [i for i in range(size - overlap, size) if rest[i] == " "]
            out.append(rest[: max(cuts, default=size)])
            start += len(out[-1]) - overlap
        return out

    long = "".join(f"{i} wörd{' ' if i % 7 else '.'}" + ("\n\n" if i % 900 == 0 else "") for i in range(16000)) + "x" * 20000
    texts = [long, "one two", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.position): r.chunk for r in QUERIES["chunks"](spark, str(tmp_path)).collect()}
    want = {(i, k): c for i, t in enumerate(texts) for k, c in enumerate(plain(t or ""))}
    assert len(long) > 100000 and got == want and got[0, len(got) - 2].endswith(long[-1000:])
    assert len(T.chunks_of(long)) == 4


def test_html():
    page = "<html><head><title>T</title><script>x</script></head><body><nav>no</nav><p>One <b>two</b><p>three<ul><li>a<li>b</ul></body>"
    assert H.visible_text(page) == "One two\nthree\na\nb"
    assert [x["url"] for x in H.links_of('<a href="/x#y">X</a><a href="mailto:a">m</a><a href="/x">again</a>', "https://h/a")] == ["https://h/x"]
    ld = '<script type="application/ld+json">{"@graph":[{"name":"A"},{"name":["B","C"]}]}</script><script type="application/ld+json">{bad</script>'
    assert [H.as_text(x["name"]) for x in H.json_ld(ld)] == ["A", "B; C"]
    assert H.labelled_pairs("# T\nFounded: 1999\n**Site**: x\n## Next\nNo: y") == [("Founded", "1999", "Founded: 1999"), ("Site", "x", "**Site**: x")]
    assert H.records_in('{"data":{"items":[{"a":1},{"a":2}]}}') == [{"a": 1}, {"a": 2}] and H.records_in('{"error":"x"}') == [] and H.records_in("nope") == []
    found = H.css_records('<div class="q"><span class="t x">hi</span><i>a</i><i>b</i></div><div class="q"></div>', "div.q", {"text": ["em", "span.t"], "tags": ["div > i"]})
    assert found == [{"text": "hi", "tags": "a | b"}]
    assert H.metadata('<meta name="d" content="x"><title>T</title>') == {"d": "x", "title": "T"}
    assert len(H.visible_text("<div>" * 3000 + "deep")) == 4


def test_links_of_a_directory_page(spark, tmp_path):
    from attestra.queries import QUERIES

    urls = [f"https://h/thing/{i}" for i in range(1000)] + ["https://h/" + "x" * 3000]
    rows = [(1, "https://h/", "".join(f'<a href="{u}">thing</a>' for u in urls)), (2, "https://h/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.position: r.url for r in QUERIES["page_links_resolved"](spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(got))] == urls
    assert QUERIES["link_scores"](spark, str(tmp_path)).count() == len(urls) and len(H.links_of(rows[0][2], "https://h/")) == 200


def test_fields(spark):
    assert values(spark, X.normalized("company_name", F.col("v")), ["Acme Inc."]) == ["acme"] and values(spark, X.normalized("raised", F.col("v")), ["$2 million", " x "]) == ["2000000", "x"]
    assert values(spark, X.acronym(F.col("v")), ["Amazon Web Services", "Acme"]) == ["aws", ""] and values(spark, X.reference_key(F.col("v")), ["Acme, Inc."]) == ["acme"]
    assert X.label_fits("Founded", "founded_year") and X.label_fits("Head office city", "office_city") and not X.label_fits("Phone", "email")
    assert X.lenient_json('```json\n{"a": 1}\n```') == {"a": 1} and X.lenient_json('{{"a": 1}}') == {"a": 1} and X.lenient_json("no") is None
    assert len(values(spark, X.html_sample(F.col("v"), 100), ["x" * 1000])[0]) == 102
    found = X.relocate('<div><p class="old">n</p><p class="price now">$5</p></div>', {"tag": "p", "parent_tag": "div", "text": "$6", "attrs": {"class": "price"}})
    assert found.attrs["class"] == "price now" and X.relocate("<i>z</i>", {"tag": "p", "text": "abc", "attrs": {"a": "b"}}, 0.9) is None


def test_references_end_with_a_semicolon():
    body = '<head><title>a&amp;&amp</title></head><h1 t&u="1">x &amp; y&lt;z &#38;&#x26; &nosuch; &am</h1><a href="/p?a=1&copy=2&amp;b=3">&lt</a><script type="application/ld+json">{"headline": "a && b &amp;", "author": "\ue000"}</script>'
    tree = H.parse(body)
    assert H.metadata(body) == {"headline": "a && b &amp;", "author": "\ue000", "title": "a&&amp"}
    assert H.visible_text(body) == "x & y<z && &nosuch; &am\n&lt"
    assert H.select(tree, "a")[0].attrs == {"href": "/p?a=1&copy=2&b=3"} and H.select(tree, "h1")[0].attrs == {"t&u": "1"}
    assert H.visible_text("a &amp") == "a &amp" and H.visible_text("<p>a &") == "a &"


def test_scripts_are_read_without_a_tree_and_once():
    rng = random.Random(7)
    parts = ["<p>a &amp b", "</p>", "&#x <b>", "<!-- <script>x</script> -->", '<SCRIPT type="a">', '{"key": "a && b &amp; long", "n": [1, "text"]}', "</script>", "</script >", "<script/>", "<svg>", "x = ", "</b", "<script>", ";", "<", "&"]
    for _ in range(3000):
        body = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert H.script_bodies(body) == ["".join(c for c in n.children if isinstance(c, str)) for n in H.parse(body).walk() if n.tag == "script"], body
    assert H.script_bodies(None) == [] and H.script_bodies("") == []
    seen = []
    assert list(once(pd.Series(["a", None, "a", "b", None]), lambda v: seen.append(v) or [v])) == [["a"], [None], ["a"], ["b"], [None]] and seen == ["a", None, "b"]
