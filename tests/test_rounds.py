"""Gap filling in rounds: what a pass may cost, what it leaves open, and that a second pass goes on where the first stopped."""

import pytest
from pyspark.sql import functions as F

from attestra.operators import rounds
from attestra.operators.rounds import Bounds, Sources

CELLS = "dataset_id string, record_id string, field string, value string, verification_status string"
TRIED = "dataset_id string, field string, state string, phase int, attempts int"


@pytest.fixture(scope="module")
def tables(spark):
    rows = []
    for d in ("d1", "d2"):
        for i in range(20):
            rows.append((d, f"r{i:02}", "name", f"Company {i} of {d}", "verified"))
            # city is missing for most, size for a few, owner for all
            rows.append((d, f"r{i:02}", "city", "Oslo" if i < 4 else None, "verified"))
            rows.append((d, f"r{i:02}", "size", "7" if i < 17 else "", "conflicting"))
            rows.append((d, f"r{i:02}", "owner", None, "unverified"))
    cells = spark.createDataFrame(rows, CELLS)
    declared = spark.createDataFrame([(d, f, i) for d in ("d1", "d2") for i, f in enumerate(("name", "city", "size", "owner"), 1)], "dataset_id string, field string, position int")
    return cells, declared


def sources(broken: tuple[str, ...] = (), wrong: bool = False, seen: list | None = None) -> Sources:
    def stored(frontier):
        # stored pages know the owner in d1 only
        return frontier.filter("field = 'owner' and dataset_id = 'd1'").withColumns({"value": F.lit("Ann"), "page_id": F.lit("p"), "quote": F.lit("owned by Ann"), "text": F.lit("it is owned by Ann.")})

    def search(queries):
        if seen is not None:
            seen.append([tuple(r) for r in queries.collect()])
        url = F.concat(F.lit("https://x.example/"), F.regexp_replace(F.lower("entity"), " ", "-"))
        hits = queries.select(*rounds.CELL, F.when(~F.col("dataset_id").isin(*broken), url).alias("url"), F.lit("").alias("title"), F.lit(0).alias("position"), F.when(F.col("dataset_id").isin(*broken), "too many requests").alias("error"))
        return hits

    def fetch(results):
        return results.select(*rounds.CELL, "url", F.col("url").alias("page_id"))

    def read(pages):
        entity = F.lit("somebody else") if wrong else F.concat(F.lit("COMPANY "), F.regexp_extract("url", "company-([0-9]+)-of", 1), F.lit(" of d"), F.regexp_extract("url", "of-d([0-9])", 1))
        return pages.select("dataset_id", "field", "page_id", F.lit("Rome").alias("value"), F.lit("in Rome").alias("quote"), F.lit("it lies in Rome").alias("text"), entity.alias("name"))

    return Sources(stored, search, fetch, read)


def tried(spark, rows=()):
    return spark.createDataFrame(list(rows), TRIED)


def states(done) -> dict:
    return {(r.dataset_id, r.field): (r.state, r.phase, r.attempts) for r in done.gaps.collect()}


def test_a_pass_fills_within_one_budget(spark, tables):
    cells, declared = tables
    seen = []
    done = rounds.autofill(cells, declared, tried(spark), sources(seen=seen), ["name"], Bounds(searches=8, fields=3, searches_per_field=5))
    log = {(r.dataset_id, r.field, r.phase): (r.searches, r.pages, r.written) for r in done.log.collect()}
    # by work left the order is owner, size, city; city lacks most of its values and is searched for at once, the others are looked for in stored pages first
    assert log == {
        ("d1", "owner", 1): (0, 1, 20), ("d2", "owner", 1): (0, 0, 0), ("d1", "city", 2): (5, 5, 5), ("d2", "city", 2): (5, 5, 5), ("d1", "size", 1): (0, 0, 0), ("d2", "size", 1): (0, 0, 0),
        ("d1", "size", 2): (3, 3, 3), ("d2", "size", 2): (3, 3, 3),
    }
    assert states(done) == {
        ("d1", "owner"): ("resolved", 1, 1), ("d2", "owner"): ("open", 1, 1), ("d1", "city"): ("resolved", 2, 1), ("d2", "city"): ("resolved", 2, 1), ("d1", "size"): ("resolved", 2, 2), ("d2", "size"): ("resolved", 2, 2),
    }
    # the fullest records are searched for first, of equals those with the smallest id
    assert [r[2] for batch in seen for r in sorted(batch) if r[:2] == ("d2", "city")] == ["r04", "r05", "r06", "r07", "r08"]
    fresh = [r for r in done.cells.filter("page_id is not null").collect()]
    assert len(fresh) == 20 + 16 and all(r.verification_status == "verified" and r.value in r.quote for r in fresh)
    assert done.cells.groupBy(*rounds.CELL).count().filter("count > 1").isEmpty() and done.cells.count() == cells.count()


def test_the_budget_is_never_exceeded(spark, tables):
    cells, declared = tables
    for budget in (0, 1, 4, 6):
        done = rounds.autofill(cells, declared, tried(spark), sources(), ["name"], Bounds(searches=budget, fields=3, searches_per_field=5))
        spent = {r.dataset_id: r.n for r in done.log.groupBy("dataset_id").agg(F.sum("searches").alias("n")).collect()}
        assert set(spent.values()) == {min(budget, 8)}, budget
        # a field that the budget does not reach keeps its phase
        assert states(done)["d1", "city"] == (("resolved", 2, 1) if budget > 3 else ("open", 0, 0))


def test_a_failed_search_is_no_finding(spark, tables):
    cells, declared = tables
    done = rounds.autofill(cells, declared, tried(spark), sources(broken=("d1",)), ["name"], Bounds(searches=9, fields=3, searches_per_field=5))
    assert states(done)["d1", "city"] == ("open", 2, 1) and states(done)["d2", "city"][0] == "resolved"
    assert {r.dataset_id: r.error for r in done.log.filter("field = 'city'").collect()} == {"d1": "too many requests", "d2": ""}


def test_what_belongs_to_no_record_is_not_written(spark, tables):
    cells, declared = tables
    done = rounds.autofill(cells, declared, tried(spark), sources(wrong=True), ["name"], Bounds(searches=9, fields=3, searches_per_field=5))
    assert states(done)["d1", "city"] == ("exhausted", 2, 1) and done.log.filter("field = 'city' and written > 0").isEmpty()


def test_a_second_pass_goes_on(spark, tables):
    cells, declared = tables
    before = tried(spark, [("d1", "city", "exhausted", 2, 1), ("d2", "city", "open", 2, 3), ("d1", "owner", "open", 1, 1), ("d2", "owner", "refused", 0, 0)])
    done = rounds.autofill(cells, declared, before, sources(), ["name"], Bounds(fields=9))
    # exhausted, refused and often tried gaps are let be; an owner that no page had is not searched for
    assert states(done) == {("d1", "owner"): ("open", 1, 1), ("d1", "size"): ("resolved", 2, 2), ("d2", "size"): ("resolved", 2, 2)}
    nothing = rounds.autofill(cells.filter("field = 'name'"), declared.filter("field = 'name'"), tried(spark), Sources(), ["name"])
    assert nothing.rounds == 0 and nothing.log.isEmpty()


def test_without_functions_it_refuses(spark, tables):
    with pytest.raises(RuntimeError, match="configured"):
        rounds.autofill(*tables, tried(spark), Sources(), ["name"])


def test_plausible_results(spark):
    rows = [
        ("https://acmecorp.com/", "", "Acme Corp", True), ("https://dir.example/acme-corp", "", "Acme Corp", True), ("https://x.example/1", "Acme Corp - profile", "Acme Corp", True),
        ("https://x.example/1", "", "Acme Corp", False), ("https://x.example/Autolink", "", "Autolink Group AS", True), ("https://x.example/open", "", "Open Group", False), ("https://abc.example/abc", "", "ABC", False),
    ]
    table = spark.createDataFrame(rows, "url string, title string, entity string, want boolean")
    assert table.filter(rounds.plausible(F.col("url"), F.col("title"), F.col("entity")) != F.col("want")).collect() == []


def test_places_and_profiles_are_the_plain_ones(spark, tables):
    rows = spark.range(30000).select(F.lit("d").alias("dataset_id"), F.when(F.col("id") % 50 == 0, "g").otherwise("f").alias("field"), F.format_string("%06d", "id").alias("record_id"), (F.col("id") * 7 % 5).alias("filled"))
    got = {}
    for most in (9000, 20000):
        got[most] = {(r.field, r.place): r.record_id for r in rounds._placed(rows, most).collect()}
    want = {}
    for field in ("f", "g"):
        ids = sorted((i for i in range(30000) if (i % 50 == 0) == (field == "g")), key=lambda i: (-(i * 7 % 5), i))
        want |= {(field, place): f"{i:06}" for place, i in enumerate(ids, 1)}
    assert got == {most: {k: v for k, v in want.items() if k[1] <= most} for most in got}

    cells = spark.createDataFrame([("d", "r1", "name", None), ("d", "r1", "size", "3"), ("d", "r1", "website", " "), ("d", "r2", "name", "B"), ("d", "r2", "title", "T"), ("d", "r3", "size", "")], "dataset_id string, record_id string, field string, value string")
    fresh = spark.createDataFrame([("d", "r1", "website", "https://a"), ("d", "r1", "title", "A"), ("d", "r3", "name", "C")], cells.schema)
    held = cells.join(fresh, rounds.CELL, "left_anti").unionByName(fresh)
    rows_of = lambda p: sorted(tuple(r) for r in p.collect())
    identity = ["title", "name"]
    assert rows_of(rounds.updated_profile(rounds.profile_of(cells, identity), fresh, identity)) == rows_of(rounds.profile_of(held, identity))
