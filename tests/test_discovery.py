"""Discovery over a stored corpus against a plain loop; no bound is ever exceeded."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.operators.discovery import Bounds, decision, discover


def corpus(seed):
    r = random.Random(seed)
    hits = [(f"q{q}", f"https://h{r.randrange(9)}.example/p{r.randrange(40)}", p) for q in range(8) for p in range(12)]
    return {(q, p): u for q, u, p in hits}, {f"h{i}.example": (r.choice([None, 0.2, 0.9]), i == 3) for i in range(9)}


def plain(runs, hits, priors, keep, bounds):
    out, rounds = {}, []
    for run, (queries, requested) in runs.items():
        waiting, seen, accepted = list(dict.fromkeys(queries)), set(), []
        for turn in range(1, bounds.rounds + 1):
            room = min(requested, bounds.sources) - len(accepted)
            now, waiting = waiting[: bounds.queries], waiting[bounds.queries :] if room > 0 else waiting
            if room <= 0 or not now:
                break
            best = {}
            for place, q in enumerate(now):
                for p in range(bounds.results):
                    if (q, p) in hits:
                        u = hits[q, p]
                        best[u] = min(best.get(u, (99, 99)), (queries.index(q), p))
            fresh = {u: b for u, b in best.items() if u not in seen}
            host = lambda u: u.split("/")[2]
            trust = lambda u: priors.get(host(u), (None, False))[0] or 0.0
            able = sorted((u for u in fresh if not priors.get(host(u), (None, False))[1]), key=lambda u: (-trust(u), *fresh[u], u))[: bounds.screened]
            seen |= set(able)
            good = sorted((u for u in able if keep(u)[0]), key=lambda u: (-trust(u), -keep(u)[1], able.index(u)))
            taken = []
            count = {}
            for u in accepted:
                count[host(u)] = count.get(host(u), 0) + 1
            for u in good:
                count[host(u)] = count.get(host(u), 0) + 1
                if count[host(u)] <= bounds.per_host and len(taken) < room:
                    taken.append(u)
            accepted += taken
            rounds.append((run, turn, len(now), len(fresh), len(able), len(taken)))
        out[run] = accepted
    return out, sorted(rounds)


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_a_plain_loop(spark, seed):
    hits, priors = corpus(seed)
    runs = {"r1": ([f"q{i}" for i in range(8)], 30), "r2": (["q5", "q1"], 3), "r3": ([], 5), "r4": (["nothing"], 5)}
    bounds = Bounds(rounds=3, queries=2, results=9, screened=7, sources=8, per_host=2)
    keep = lambda u: (int(u.rsplit("p", 1)[1]) % 3 > 0, int(u.rsplit("p", 1)[1]) / 100)
    found = spark.createDataFrame([(q, u + "#x", p) for (q, p), u in hits.items()], "query string, url string, position int")
    number = F.regexp_extract("url", "p([0-9]+)$", 1).cast("int")
    spent = []

    def search(queries):
        spent.append(queries.groupBy("run_id").count().agg(F.max("count")).first()[0])
        return queries.select("run_id", "query").join(found, "query").withColumn("title", F.lit("t"))

    def screen(rows):
        return rows.select("run_id", "url", (number % 3 > 0).alias("keep"), (number / 100).alias("confidence"))

    queries = spark.createDataFrame([(r, q, i) for r, (qs, _) in runs.items() for i, q in enumerate(qs)], "run_id string, query string, place int")
    wanted = spark.createDataFrame([(r, n) for r, (_, n) in runs.items()], "run_id string, requested int")
    prior = spark.createDataFrame([(h, t, b) for h, (t, b) in priors.items()], "host string, trust double, blocked boolean")
    got, log = discover(queries, wanted, search, screen, prior, bounds=bounds)
    want, rounds = plain(runs, hits, priors, keep, bounds)
    told = {}
    for r in sorted(got.collect(), key=lambda r: (r.run_id, r.round, r.position)):
        told.setdefault(r.run_id, []).append(r.url)
    assert told == {r: u for r, u in want.items() if u} and sorted(tuple(r) for r in log.collect()) == rounds
    assert max(spent) <= bounds.queries and all(len(u) <= bounds.sources for u in told.values()) and not any("h3.example" in u for us in told.values() for u in us)


def test_seeds_and_proposals(spark):
    def search(queries):
        return queries.select("run_id", "query", F.concat(F.lit("https://"), F.regexp_replace("query", " ", ""), F.lit(".example/")).alias("url"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("position"))

    def screen(rows):
        return rows.select("run_id", "url", F.lit(True).alias("keep"), F.lit(0.5).alias("confidence"))

    asked = []

    def propose(rows, turn):
        asked.append((turn, sorted((r.run_id, r.room, r.url) for r in rows.collect())))
        return rows.select("run_id", F.concat(F.lit("more "), F.lit(turn)).alias("query"), F.lit(turn).alias("place")).unionByName(rows.select("run_id", F.lit("one").alias("query"), F.lit(0).alias("place")))

    queries = spark.createDataFrame([("r", "one", 0)], "run_id string, query string, place int")
    wanted = spark.createDataFrame([("r", 4)], "run_id string, requested int")
    seeds = spark.createDataFrame([("r", "https://seed.example/"), ("r", "https://one.example/"), ("r", "")], "run_id string, url string")
    got, log = discover(queries, wanted, search, screen, seeds=seeds, propose=propose, bounds=Bounds(rounds=9))
    assert sorted((r.round, r.url) for r in got.collect()) == [(0, "https://one.example/"), (0, "https://seed.example/"), (2, "https://more2.example/"), (3, "https://more3.example/")]
    assert [t for t, _ in asked] == [2, 3] and asked[0][1][0][1] == 2 and log.count() == 3


def test_decisions_are_bounded():
    assert decision("Continue", ["a", " a ", "b", 5, ""], 0) == ("continue", ["a", "b"]) and decision("continue", ["a", "b", "c"], 6) == ("continue", ["a", "b"])
    assert decision("continue", ["a"], 8) == decision("continue", [], 0) == decision("explode", ["a"], 0) == decision(None, ["a"], 0) == ("stop", [])
