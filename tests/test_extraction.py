"""Staged reading equals asking every rung about everything and taking the first; selectors are learnt only where they are proven."""

import random

from pyspark.sql import functions as F

from attestra.functions import html as H
from attestra.operators import extraction as X

FIELDS = ["company_name", "phone", "price", "city"]
PAGES = [
    (1, "https://a.example.org/1", '<h1 class="n">Acme</h1><p>Phone: 123</p><p>City: Oslo</p><b id="p">9</b>'),
    (2, "https://a.example.org/2", '{"items": [{"companyName": "J", "phone": {"value": 5}}, {"phone": 6}]}'),
    (3, "https://b.example.net/3", '<script type="application/ld+json">{"@graph":[{"companyName":"L","city":{"name":"Rome"}},{"companyName":"M","price":3}]}</script><p>City: Bonn</p>'),
    (4, "https://b.example.net/4", None), (5, "https://b.example.net/5", "  "), (6, "https://b.example.net/6", "{broken"), (7, None, "<p>City: </p><p>Company name: &amp;Co</p>"),
    (8, "https://list.example.com/", '<ul><li><i class="n">x</i><i class="c">p</i></li><li><i class="n">y</i></li></ul>'),
    (9, "https://list.example.com/", '<ul><li><i class="n">x</i></li><li><i class="n">y</i></li></ul><p>City: Rome</p>'),
]
SCHEMAS = [
    ("example.org", None, {"company_name": ["h2", "h1.n"], "price": ["b[id=p]"], "city": ["h1"]}),
    ("example.com", "ul > li", {"company_name": ["i.n"], "city": ["i.c"]}),
]


def tables(spark, pages=PAGES):
    return spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(SCHEMAS, "domain string, item string, fields map<string,array<string>>")


def test_each_rung_is_asked_about_what_is_open(spark):
    done = X.extract(*tables(spark)[:1], FIELDS, tables(spark)[1])
    found = {(r.page_id, r.ordinal, r.field): (r.value, r.rung) for r in done.found.collect()}
    assert found == {
        (1, 0, "company_name"): ("Acme", "selectors"), (1, 0, "phone"): ("123", "labelled"), (1, 0, "city"): ("Oslo", "labelled"), (1, 0, "price"): ("9", "selectors"),
        (2, 0, "company_name"): ("J", "json"), (2, 0, "phone"): ("5", "json"), (3, 0, "company_name"): ("L", "json_ld"), (3, 0, "city"): ("Bonn", "labelled"), (3, 0, "price"): ("3", "json_ld"),
        (7, 0, "company_name"): ("&Co", "labelled"), (8, 0, "company_name"): ("x", "selectors"), (8, 0, "city"): ("p", "selectors"), (8, 1, "company_name"): ("y", "selectors"),
        (9, 0, "company_name"): ("x", "selectors"), (9, 0, "city"): ("Rome", "labelled"),
    }
    trace = {(r.page_id, r.rung): (r.asked, r.filled) for r in done.trace.collect()}
    assert [trace[1, r] for r in ("json", "labelled", "selectors", "json_ld") if (1, r) in trace] == [(4, 0), (4, 2), (2, 2)] and trace[3, "json_ld"] == (3, 2) and (4, "json") not in trace
    assert {(r.page_id, r.field) for r in done.open.collect()} == {(i, f) for i in range(1, 10) for f in FIELDS} - {k[::2] for k in found}


def test_a_model_is_asked_about_open_pairs_only(spark):
    asked = []

    def ask(open_):
        asked.append({(r.page_id, r.field): r.text for r in open_.collect()})
        rows = [(2, "city", "Kiel", "q"), (2, "city", "Aachen", "q"), (2, "phone", "666", "q"), (4, "city", " ", ""), (99, "city", "x", "")]
        return spark.createDataFrame(rows, "page_id long, field string, value string, quote string")

    done = X.extract(*tables(spark)[:1], FIELDS, tables(spark)[1], ask)
    assert (2, "phone") not in asked[0] and asked[0][2, "city"].startswith("{") and asked[0][4, "city"] == ""
    assert {(r.page_id, r.field, r.value) for r in done.found.filter("rung = 'model'").collect()} == {(2, "city", "Aachen")}
    assert {(r.page_id, r.asked, r.filled) for r in done.trace.filter("rung = 'model' and page_id in (2, 4)").collect()} == {(2, 2, 1), (4, 4, 0)}
    assert not done.open.filter("page_id = 2 and field = 'city'").count()


def test_staged_equals_all_rungs_and_the_first(monkeypatch):
    rng = random.Random(3)
    parts = ["<p>City: Oslo</p>", "<p>Phone: 12</p>", '<h1 class="n">A</h1>', '<b id="p">9</b>', '<script type="application/ld+json">{"phone": "7", "price": 2}</script>', "<p>Company name: B</p>", "<p>x", "</div>", "City: none"]
    for _ in range(200):
        body = "".join(rng.sample(parts, rng.randint(0, 6)))
        schema = rng.choice([None, {"item": None, "fields": SCHEMAS[0][2]}])
        page = X.Page(body, schema)
        found, trace = X.read_page(page, FIELDS)
        every = [(name, rung(X.Page(body, schema), FIELDS)) for name, rung in X.RUNGS]
        want = {f: next(((x[f][0], name) for name, x in every if f in x and x[f][0].strip()), None) for f in FIELDS}
        assert {x["field"]: (x["value"], x["rung"]) for x in found} == {f: v for f, v in want.items() if v}
        assert page.parses <= 1 and sum(t["filled"] for t in trace) == len(found)


def test_one_parse_in_the_plan(spark):
    done = X.extract(*tables(spark)[:1], FIELDS, tables(spark)[1])
    # what is read is stored, and its three views read the store
    for view in (done.found, done.trace, done.open):
        plan = view._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "ArrowEval" not in plan


def site(n, domain, template):
    return [(i, f"https://w{i}.{domain}/p", template.format(i=i, other=(i * 7) % 5)) for i in n]


def test_selectors_are_proven_on_other_pages(spark):
    good = '<div class="box"><span class="label">Name</span><span class="value">N{i}</span></div><div id="price"><b>${i}</b></div>'
    # the value stands in another place on odd pages
    moving = "<p>first</p><p>V{i}</p>"
    pages = site(range(20), "good.example", good) + [(100 + i, "https://x.moves.example/", (moving if i % 2 else "<p>V{i}</p><p>first</p>").format(i=i)) for i in range(20)] + site(range(200, 202), "tiny.example", good)
    pages += [(300 + i, "https://big.example/", f"<p>{'long ' * (60 if i % 2 else 0)}W{i}</p>") for i in range(10)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    examples = [(i, "name", f" N{i} ") for i in range(20)] + [(i, "price", f"${i}") for i in range(20)] + [(100 + i, "moved", f"V{i}") for i in range(20)] + [(200 + i, "name", f"N{200 + i}") for i in range(2)]
    examples += [(300 + i, "word", f"W{i}") for i in range(10)] + [(5, "none", None), (6, "none", "not on the page")]
    learnt = X.learn_selectors(table, spark.createDataFrame(examples, "page_id long, field string, value string"), F.col("page_id") % 2 == 1).collect()
    best = {(r.domain, r.field): (r.selector, r.seen, r.right) for r in learnt if r.place == 1}
    assert best == {("good.example", "name"): ("span.value", 10, 10), ("good.example", "price"): ("b", 10, 10)}
    reasons = {}
    for r in learnt:
        reasons.setdefault((r.domain, r.field), set()).add(r.reason)
        assert (r.place is None) == (r.reason is not None)
    assert "finds something else on another page" in reasons["moves.example", "moved"] and None not in reasons["moves.example", "moved"]
    assert reasons["tiny.example", "name"] == {"too few pages to prove it", "finds something else on another page"} or None not in reasons["tiny.example", "name"]
    assert reasons["big.example", "word"] == {"finds a container"}
    # by brute force: a proven selector finds the value on every page of its site
    bodies, values = {p[0]: p for p in pages}, {(i, f): (v or "").strip() for i, f, v in examples}
    for r in learnt:
        own = [i for (i, f) in values if f == r.field and i in bodies and X_domain(bodies[i][1]) == r.domain and i % 2 == 1]
        right = sum(X.selected_text(H.parse(bodies[i][2]), [r.selector]) == values[i, r.field] for i in own)
        assert (r.right, r.reason is None) == (right, right == len(own) and right >= 2)
    # and what was learnt reads the pages
    done = X.extract(table, ["name", "price"], X.schemas_of(spark.createDataFrame(learnt)), rungs=(("selectors", X.selector_rung),))
    assert {(r.page_id, r.field, r.value) for r in done.found.collect()} == {(i, "name", f"N{i}") for i in range(20)} | {(i, "price", f"${i}") for i in range(20)}


def X_domain(url):
    return ".".join(url.split("/")[2].split(".")[-2:])


def test_domains(spark):
    rows = [("https://a.b.Example.org:80/x", "example.org"), ("http://user@h.net?q", "h.net"), ("https://localhost/x", "localhost"), (None, ""), ("no address", "")]
    assert spark.createDataFrame(rows, "url string, want string").filter(X.domain_of(F.col("url")) != F.col("want")).collect() == []
