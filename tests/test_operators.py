"""Operators whose rules SQL does not show."""

import pytest
from pyspark.sql import functions as F

from attestra.operators import coverage, crawl, dedupe, pages, records, verify
from attestra.plans import compiler, guarded_sql, maintenance, sectors, tools
from attestra.sources import connectors, sinks
from attestra.streaming import events as stream


def test_guarded_sql(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 1), (None, 2)], "name string, n int")
    assert [tuple(r) for r in guarded_sql.run(rows, "SELECT name, n FROM records ORDER BY n DESC;").collect()] == [("a", 3), ("b", 1), (None, 2)]
    assert [r.n for r in guarded_sql.run(rows, "SELECT n FROM records ORDER BY n DESC", keep_order=True).collect()] == [3, 2, 1]
    assert guarded_sql.run(rows, "SELECT a.n AS x FROM records AS a JOIN records AS b ON a.n = b.n", 2).count() == 2
    assert guarded_sql.run(rows, "SELECT name, row_number() OVER (PARTITION BY name ORDER BY n) AS r FROM records").count() == 3
    for bad in ("", "DROP TABLE records", "SELECT 1; SELECT 2", "SELECT secret FROM records", "SELECT * FROM users", "SELECT pg_sleep(9)", "UPDATE records SET n = 1", "SELECT n INTO x FROM records", r"SELECT '\'' , secret , '\'' FROM records", "SELECT 'a", "SELECT 1 /* a", "SELECT n FROM records -- x\n; SELECT 2", "SELECT n @ 2 FROM records"):
        with pytest.raises(guarded_sql.Refused):
            guarded_sql.run(rows, bad)
    assert guarded_sql.run(rows, "SELECT 'it''s; DROP' AS x, n FROM records /* secret */ WHERE n > 1 -- drop").count() == 2
    spark.createDataFrame([("z", 9)], "name string, n int").createOrReplaceTempView("name")  # a table named like a column
    with pytest.raises(guarded_sql.Refused):
        guarded_sql.run(rows, "SELECT * FROM name")
    assert guarded_sql.extract_sql({"answer": {"sql": "SELECT 1; drop"}}) == "SELECT 1"


def test_fuzzy_leaders_are_not_transitive(spark):
    rows = spark.createDataFrame([(1, "acme technologies"), (2, "acme technologie"), (3, "acme technologi"), (4, "zeta works"), (5, "acme technologies inc"), (6, None)], "id int, name string")
    pairs = dedupe.similar_pairs(rows, ["name"], "id", 95.0)
    found = {tuple(r) for r in pairs.select("a", "b").collect()}
    assert (1, 2) in found and (4, 5) not in found
    lead = {r.node: r.leader for r in dedupe.leaders(rows, spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"), "id").collect()}
    assert lead == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 6)], "a int, b int")
    assert {r.node: r.leader for r in dedupe.leaders(rows, chain, "id").collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
    with pytest.raises(RuntimeError):
        dedupe.leaders(rows, chain, "id", rounds=2)
    with pytest.raises(RuntimeError):
        dedupe.leaders(rows, spark.createDataFrame([(0, 2)], "a int, b int"), "id")
    with pytest.raises(NotImplementedError):
        dedupe.refuse_semantic()


def test_exact_dedupe_keeps_rows_without_identity(spark):
    rows = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, ""), (4, None)], "id int, name string")
    assert sorted((r.id, r.merged) for r in dedupe.exact(rows, ["name"], "id").collect()) == [(1, 2), (3, 1), (4, 1)]


def test_merge_keeps_rivals(spark):
    cells = spark.createDataFrame([(1, "f", "x", "verified"), (2, "f", "y", "unverified"), (2, "g", "z", "verified"), (1, "g", "", "verified")], "id int, field string, value string, verification_status string")
    groups = spark.createDataFrame([(1, 1), (2, 1)], "node int, leader int")
    got = {r.field: (r.value, r.verification_status, r.rivals) for r in dedupe.merged_cells(cells, groups, "id").collect()}
    assert got == {"f": ("x", "conflicting", "y"), "g": ("z", "verified", "")}


def test_verify_ladder(spark):
    rows = [
        ("1", "f", "Acme", "Acme was founded", "Here Acme was  *founded*.", "", ""), ("2", "f", "NA", "q", "q", "", ""), ("3", "f", "Acme", "not there", "page", "", ""),
        ("4", "f", "Acme", "", "page", "", ""), ("5", "f", "7", "seven days", "in seven days", "", ""), ("6", "f", "Acme", "Acme", "Acme", "r9", "r1 r2"),
    ]
    cells = spark.createDataFrame(rows, "record_id string, field string, value string, quote string, text string, reference_id string, references string")
    got = {r.record_id: (r.value, r.verification_status) for r in verify.verify(cells).collect()}
    assert got == {"1": ("Acme", "verified"), "2": (None, "unverified"), "3": (None, "unverified"), "4": ("Acme", "unverified"), "5": ("7", "judgment_unavailable"), "6": (None, "unverified")}
    judged = {r.record_id: r.verification_status for r in verify.verify(cells, judge=lambda v, q, t: F.lit("SUPPORTED"), budget=0).collect()}
    assert judged["5"] == "judgment_unavailable"
    assert {r.record_id: r.verification_status for r in verify.verify(cells, judge=lambda v, q, t: F.lit("SUPPORTED")).collect()}["5"] == "verified"
    settled = {r.record_id: (r.verification_status, r.quote) for r in verify.settle(verify.verify(cells)).collect()}
    assert settled["1"] == ("verified", "Acme was  *founded")


def test_transitions(spark):
    cells = spark.createDataFrame([("1", "f", "a", "judgment_unavailable"), ("2", "f", "b", "verified")], "record_id string, field string, value string, verification_status string")
    verdicts = spark.createDataFrame([("1", "f", "SUPPORTED"), ("2", "f", "NOT_SUPPORTED")], "record_id string, field string, verdict string")
    assert {r.record_id: r.verification_status for r in verify.rejudge(cells, verdicts).collect()} == {"1": "verified", "2": "verified"}
    fresh = spark.createDataFrame([("1", "f", "A ", "verified"), ("2", "f", "c", "verified")], "record_id string, field string, new_value string, new_status string")
    assert {r.record_id: (r.decision, r.value, r.rival) for r in maintenance.refresh(cells, fresh).collect()}["2"] == ("changed", "c", "b")


def test_gap_attempts(spark):
    stored = spark.createDataFrame([("d", "a", "open", 2, 0), ("d", "b", "open", 0, 0), ("d", "c", "open", 1, 1)], "dataset_id string, field string, state string, attempts int, phase int")
    results = spark.createDataFrame([("d", "a", 0, ""), ("d", "b", 3, ""), ("d", "c", 0, "boom")], "dataset_id string, field string, filled int, error string")
    assert {r.field: (r.state, r.attempts) for r in coverage.attempt(stored, results).collect()} == {"a": ("exhausted", 3), "b": ("resolved", 1), "c": ("open", 2)}


def test_records(spark):
    rows = spark.createDataFrame([("d", "1", {"a": "x", "b": "5k"}), ("d", "2", {"a": "NA", "b": "£7"})], "dataset_id string, record_id string, fields map<string,string>")
    assert [r.record_id for r in records.records_where(rows, [("a", "filled", None), ("b", "gt", 1000)]).collect()] == ["1"]
    assert [r.record_id for r in records.search(rows, '"b"').orderBy("record_id").collect()] == ["1", "2"]
    assert tuple(records.unreadable(rows, "a").first()) == (1, "")
    assert records.unreadable(rows, "b").first().other_currencies == "£"
    assert records.update_cell(rows, "d", "2", "a", "new").filter("record_id = '2'").first().fields["a"] == "new"
    assert maintenance.repair_placeholders(rows).filter("record_id = '2'").first().fields == {"b": "£7"}
    with pytest.raises(ValueError):
        records.records_where(rows, [])
    with pytest.raises(ValueError):
        records.add_column([], "1bad")


def test_rungs_and_ladder(spark):
    one = spark.createDataFrame([(1, "f", "", "json"), (1, "g", "2", "json")], "page_id int, field string, value string, rung string")
    two = spark.createDataFrame([(1, "f", "x", "css"), (1, "g", "9", "css")], "page_id int, field string, value string, rung string")
    assert sorted(tuple(r) for r in pages.ladder([one, two]).collect()) == [(1, "f", "x", "css"), (1, "g", "2", "json")]
    found = spark.createDataFrame([(1, "https://h/robots-talk", "nothing"), (2, "https://h/x", "Robots are made"), (3, "https://h/x", "cats")], "page_id int, url string, text string")
    assert [r.keep for r in pages.relevant(found, ["robot"], []).orderBy("page_id").collect()] == [True, True, False]
    urls = spark.createDataFrame([(0, "https://de.a.com/p"), (1, "https://www.a.com/p"), (2, "https://a.com/q")], "pos int, url string")
    assert sorted(tuple(r) for r in pages.collapse_variants(urls, "pos").collect()) == [(0, "https://www.a.com/p"), (2, "https://a.com/q")]


def test_sources_and_sinks(spark, tmp_path):
    connectors.append(spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "log"))
    connectors.append(spark.createDataFrame([(1, "b")], "k int, v string"), str(tmp_path / "log"))
    assert connectors.append_log(spark, str(tmp_path / "log"), "k int, v string").count() == 2
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_text("<p>x")
    got = {r.url: r.status for r in connectors.corpus(spark, str(tmp_path / "pages"), {"u1": "a.html", "u2": "b.html"}).collect()}
    assert got == {"u1": "ok", "u2": "failed"}
    payload = spark.createDataFrame([(1, '{"results":[{"a":1},{"a":[2,3]}]}')], "page_id int, payload string")
    assert [r.record["a"] for r in connectors.payload_records(payload).orderBy("position").collect()] == ["1", "2; 3"]
    with pytest.raises(RuntimeError):
        connectors.refused("search")("q")
    cells = spark.createDataFrame([("1", "a", "=x", "verified", "u", "t"), ("1", "b", None, "unverified", "w", None)], "record_id string, field string, value string, verification_status string, url string, retrieved_at string")
    flat = sinks.flat(cells, ["a", "b"])
    assert sinks.export(flat, "csv") == "record_id,a,b,_verification_status,_url,_retrieved_at\n1,'=x,,verified|unverified,u|w,t|\n"
    assert '"_url": "u|w"' in sinks.export(flat, "jsonl") and sinks.export(flat, "md").startswith("# Dataset")
    with pytest.raises(ValueError):
        sinks.export(flat.limit(0), "json")
    sinks.write(flat, str(tmp_path / "out"), "csv")


def test_plans():
    plan = compiler.compile_plan("AI companies with founder, funding round and website")
    assert plan.entity == "companie" or plan.entity == "company"
    assert [f.name for f in plan.fields][1:] == ["founder", "funding_round", "website"] and plan.dedupe_keys
    with pytest.raises(ValueError):
        compiler.diff(plan, plan)
    assert compiler.classify("How many?") == ("query", 1.0) and compiler.classify("fill missing founders")[0] == "backfill"
    assert compiler.legal("PLANNING", "DISCOVERING") and not compiler.legal("PLANNING", "FETCHING") and not compiler.legal("COMPLETED", "FAILED")
    assert compiler.grounded([{"value": 3}, {"value": 50, "unit": "%"}, {"value": 99}], [3, 6]) == [{"value": 3}, {"value": 50, "unit": "%"}]
    assert compiler.affordable_pages(10, 2) == 2


def test_tools(spark):
    cells = spark.createDataFrame([("d", "1", "a", "x", "verified", "https://h/", None)], "dataset_id string, record_id string, field string, value string, verification_status string, url string, rival string")
    declared = spark.createDataFrame([("d", "a"), ("d", "b")], "dataset_id string, field string")
    out = tools.answer(cells, declared, [{"tool": "coverage"}, {"tool": "nope"}, {"tool": "value_counts", "args": {"field": "a"}}])
    assert list(out) == ["0:facts", "1:coverage", "2:value_counts"] and out["1:coverage"].count() == 2


def test_stream(spark, tmp_path):
    schema = "run_id string, seq long, ts timestamp, type string, value double"
    rows = spark.createDataFrame([("r", 1, "2024-01-01 00:00:00", "view", 1.0), ("r", 2, "2024-01-01 10:00:00", "odd", 2.0), ("r", 3, "2024-01-03 00:00:00", "error", 3.0)], "run_id string, seq long, ts string, type string, value double")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream.audit_sink(stream.guarded(source), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.type for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["error", "stage.progress", "view"]
    done = stream.tumbling(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination(60)
    assert spark.table("windows").count() == 2
    steps = spark.createDataFrame([("r", 1, "A"), ("r", 2, "C")], "run_id string, seq int, stage string")
    assert stream.illegal_steps(steps, ("A", "B", "C")).count() == 1


def test_crawl(spark):
    site = {"https://h/a": '<a href="/list?page=2">next</a><a href="/about">about</a><a href="/robots/x">Robots</a>', "https://h/robots/x": '<a href="/robots/y">robot</a>', "https://h/list?page=2": "", "https://h/robots/y": ""}
    stored = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site.items())], "page_id int, url string, html string")
    got = crawl.crawl(spark.createDataFrame([("https://h/a",)], "url string"), lambda urls: stored.join(urls, "url").select("page_id", "url", "html"), ["robot"], budget=4)
    assert {r.url: r.depth for r in got.collect()} == {"https://h/a": 0, "https://h/list?page=2": 1, "https://h/robots/x": 1, "https://h/robots/y": 2}
    reason = crawl.no_yield_reason(spark.createDataFrame([("timeout", "x"), ("timeout", "y")], "provider string, text string")).first()
    assert reason.reason == "every extraction timed out" and reason.thin == 2
    named = crawl.candidate_pages(spark.createDataFrame([(1, "Acme Corp and Zeta"), (2, "nothing")], "page_id int, text string"), spark.createDataFrame([("acme corp",), ("zeta",)], "needle string"))
    assert [tuple(r) for r in named.collect()] == [(1, 2)]


def test_sectors():
    venture = sectors.sector([{"name": "founder_names"}, {"name": "funding_round"}, {"name": "investor"}])
    assert venture["sector"] == "venture" and venture["matched_fields"]
    assert sectors.sector([{"name": "mood"}])["method"] == "none" and sectors.sector([])["method"] == "none"
    assert sectors.sector([{"name": "ticker_quote"}, {"name": "hiring_role"}])["sector"] is None


def test_crawl_tree_leaves_out_circles_orphans_and_the_deep(spark):
    from attestra.operators import pages

    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(13)]
    rows = chain + [("o", "nowhere"), ("x", "y"), ("y", "x"), ("k", "c0")]
    got = {(r.url, r.root, r.depth) for r in pages.crawl_tree(spark.createDataFrame(rows, "url string, parent_url string"), 10).collect()}
    assert got == {(f"c{i}", "c0", i) for i in range(11)} | {("k", "c0", 1)}
    empty = spark.createDataFrame([], "url string, parent_url string")
    assert pages.crawl_tree(empty, 3).collect() == []


def test_merge_batches_tells_separators_inside_values_apart(spark):
    from attestra.operators import dedupe

    rows = [(1, {"a": "b=c"}, ["q"]), (2, {"a=b": "c"}, ["q"]), (3, {"A": " B=C "}, ["Q"]), (4, {"a": "b=c"}, []), (5, {"a": None}, None), (6, {"a": None}, None)]
    merged = dedupe.merge_batches(spark.createDataFrame(rows, "i long, fields map<string,string>, quotes array<string>"), "i")
    assert sorted(r.i for r in merged.collect()) == [1, 2, 4, 5]


def test_values_of_odd_forms(spark):
    from pyspark.sql import functions as F

    from attestra.functions import fields, html

    texts = ["{}", "[]", '""', "-1.5", "false", "null", "{", "", None]
    kinds = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fields.json_kind(F.col("t"))).collect()]
    assert kinds == ["object", "array", "string", "number", "boolean", "null", None, None, None]
    many = "<script>" + str([f"word{i}" for i in range(1000)]).replace("'", '"') + "</script>"
    assert len(html.script_strings(many)) == 400 and len(html.script_strings(many, most=None)) == 1000 and html.script_strings(None) == []
    assert len(html.css_records("<ul>" + "<li><a>x</a></li>" * 60 + "</ul>", "li", {"w": ["a"]}, most=None)) == 60


def test_pages_stay_where_they_are_for_few_needles_and_travel_once_for_many(spark):
    import re

    texts = [(1, "The acme corp of Zeta"), (1, "zeta"), (1, "zeta"), (2, None), (3, "often theacme corp"), (4, "ACME  corp"), (5, "Acme corp, the and zeta " + "w" * 50), (None, "the Zeta-7 x")]
    names = ["acme corp", "Acme Corp", "zeta", "zeta", "the", "zeta-7", "--", "", None, "of"]
    pages_, needles = spark.createDataFrame(texts, "page_id int, text string"), spark.createDataFrame([(n,) for n in names], "needle string")
    want = {}
    for page, text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        for n in names:
            first = re.search(r"\w+", (n or "").lower())
            if first and first[0] in words and n.lower() in text.lower():
                want.setdefault(page, set()).add(n)
    for most_sent in (10_000, 0):
        got = crawl.candidate_pages(pages_, needles, most_sent=most_sent)
        assert {r.page_id: r.named for r in got.collect()} == {p: len(n) for p, n in want.items()}
        # a text stands beside the words that begin a needle, or beside none; never beside each of its words
        made = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in line]
        assert made and all("array_intersect" in line if most_sent else "text" not in line.split("[_word", 1)[1] for line in made)
