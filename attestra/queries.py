"""Queries over the driver's tables, one for each operator family, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import cells as C
from .functions import dates as D
from .functions import numbers as N
from .functions import scores as S
from .functions import texts as T
from .functions import urls as U
from .operators import coverage, crawl, dedupe, gapfill, hosts, pages, profile, records, verify
from .plans import guarded_sql
from .sources.tables import cells, cells_sql, declared, declared_sql, load, run_events
from .streaming import events as stream
from .streaming import throttle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CELLS, DECLARED = cells_sql(), declared_sql()
NOW = "2024-12-01 00:00:00"
_ABSENT = ", ".join(f"'{w}'" for w in C.ABSENCE_WORDS)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def now():
    return F.lit(NOW).cast("timestamp")


# coverage and what follows from it

_COUNTED = f"""WITH {CELLS}, {DECLARED},
    counted AS (SELECT dataset_id, field, count(*) FILTER (WHERE p) AS present, count(*) FILTER (WHERE p AND s = 'verified') AS verified,
                       count(*) FILTER (WHERE p AND s = 'unverified') AS unverified, count(*) FILTER (WHERE p AND s = 'conflicting') AS conflicting
                FROM (SELECT *, value IS NOT NULL AND trim(value) <> '' AS p,
                             CASE WHEN verification_status IN ('verified', 'conflicting') THEN verification_status ELSE 'unverified' END AS s FROM cells) GROUP BY ALL),
    totals AS (SELECT dataset_id, count(DISTINCT record_id) AS records FROM cells GROUP BY 1),
    coverage AS (SELECT d.dataset_id, d.field, records, coalesce(present, 0) AS present, records - coalesce(present, 0) AS missing, coalesce(verified, 0) AS verified,
                        coalesce(unverified, 0) AS unverified, coalesce(conflicting, 0) AS conflicting, round(100.0 * coalesce(present, 0) / records, 1) AS coverage_pct,
                        round(100.0 * coalesce(verified, 0) / records, 1) AS proven_pct
                 FROM declared d LEFT JOIN counted USING (dataset_id, field) JOIN totals USING (dataset_id))"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.field_coverage(cells(spark, sf_dir), declared(spark))


@query(_COUNTED + " SELECT * FROM coverage")
def coverage_by_field(spark, sf_dir):
    return _coverage(spark, sf_dir)


@query(_COUNTED + """ SELECT dataset_id, max(records) AS records, count(*) AS fields, CAST(sum(present) AS BIGINT) AS present, CAST(sum(verified) AS BIGINT) AS verified,
    CAST(sum(unverified) AS BIGINT) AS unverified, CAST(sum(conflicting) AS BIGINT) AS conflicting, count(*) FILTER (WHERE present = 0) AS empty_fields,
    count(*) FILTER (WHERE present > 0 AND present < records) AS partial_fields FROM coverage GROUP BY dataset_id""")
def verdict_totals(spark, sf_dir):
    return coverage.verdict_totals(_coverage(spark, sf_dir))


@query(_COUNTED + """ SELECT dataset_id, CAST(sum(records) AS BIGINT) AS slots, CAST(sum(present) AS BIGINT) AS present, CAST(sum(verified) AS BIGINT) AS verified,
    CAST(sum(unverified) AS BIGINT) AS unverified, CAST(sum(conflicting) AS BIGINT) AS conflicting, count(*) AS fields,
    round(100.0 * sum(present) / sum(records), 1) AS coverage_pct, round(100.0 * sum(verified) / sum(records), 1) AS proven_pct
    FROM coverage GROUP BY GROUPING SETS ((dataset_id), ())""")
def dashboard_grouping_sets(spark, sf_dir):
    return coverage.dashboard(cells(spark, sf_dir), declared(spark))


@query(f"""WITH {CELLS}, r AS (SELECT dataset_id, record_id, bool_and(verification_status = 'verified') AS whole,
    count(*) FILTER (WHERE verification_status = 'verified') AS verified, count(*) FILTER (WHERE verification_status = 'unverified') AS unverified,
    count(*) FILTER (WHERE verification_status = 'conflicting') AS conflicting, count(*) FILTER (WHERE verification_status = 'judgment_unavailable') AS judgment_unavailable,
    count(*) FILTER (WHERE verification_status = 'rejected') AS rejected FROM cells GROUP BY ALL)
    SELECT dataset_id, count(*) AS records, count(*) FILTER (WHERE whole) AS fully_verified, CAST(sum(verified) AS BIGINT) AS verified, CAST(sum(unverified) AS BIGINT) AS unverified,
    CAST(sum(conflicting) AS BIGINT) AS conflicting, CAST(sum(judgment_unavailable) AS BIGINT) AS judgment_unavailable, CAST(sum(rejected) AS BIGINT) AS rejected FROM r GROUP BY 1""")
def provenance_summary(spark, sf_dir):
    return coverage.provenance_summary(cells(spark, sf_dir))


@query(f"""WITH {CELLS} SELECT dataset_id, record_id, field, value AS incumbent, CASE WHEN rival IS NULL THEN NULL ELSE 0 END AS rival_index, rival
    FROM cells WHERE verification_status = 'conflicting'""")
def conflicts_exploded(spark, sf_dir):
    return coverage.conflicts(cells(spark, sf_dir))


_GAPS = _COUNTED + """, gaps AS (SELECT dataset_id, field, CASE WHEN missing = 0 AND unverified + conflicting > 0 THEN 'evidence_gap' WHEN present = 0 THEN 'schema_gap'
    WHEN missing > 0 THEN 'depth_gap' END AS category, present, missing, unverified, conflicting, missing + unverified + conflicting AS outstanding FROM coverage)"""


@query(_GAPS + " SELECT * FROM gaps WHERE category IS NOT NULL")
def gaps_derived(spark, sf_dir):
    return coverage.gaps(_coverage(spark, sf_dir))


@query(_GAPS + " SELECT dataset_id, category, count(*) AS fields, CAST(sum(outstanding) AS BIGINT) AS outstanding FROM gaps WHERE category IS NOT NULL GROUP BY ALL")
def gap_summary(spark, sf_dir):
    return coverage.gap_summary(coverage.gaps(_coverage(spark, sf_dir)))


@query(_COUNTED + """ SELECT dataset_id, field, reason, outstanding, routable FROM (SELECT dataset_id, field, CASE WHEN present = 0 THEN 'never extracted' WHEN missing > 0 THEN 'partly extracted'
    WHEN conflicting > 0 THEN 'sources disagree' WHEN unverified > 0 THEN 'not verified' END AS reason, missing + unverified + conflicting AS outstanding, missing > 0 AS routable FROM coverage)
    WHERE reason IS NOT NULL""")
def backlog(spark, sf_dir):
    return coverage.backlog(_coverage(spark, sf_dir))


@query(_GAPS + """, stored(dataset_id, field, old_state, old_phase) AS (VALUES ('customers', 'website', 'resolved', 2), ('customers', 'gone', 'open', 1), ('parts', 'size', 'exhausted', 2))
    SELECT dataset_id, field, CASE WHEN category IS NULL THEN 'resolved' WHEN old_state IS NULL OR old_state = 'resolved' THEN 'open' ELSE old_state END AS state,
    CASE WHEN old_state IS NULL OR (old_state = 'resolved' AND category IS NOT NULL) THEN 0 ELSE old_phase END AS phase, coalesce(outstanding, 0) AS outstanding
    FROM (SELECT * FROM gaps WHERE category IS NOT NULL) FULL JOIN stored USING (dataset_id, field)""")
def gap_full_outer(spark, sf_dir):
    stored = spark.createDataFrame([("customers", "website", "resolved", 2), ("customers", "gone", "open", 1), ("parts", "size", "exhausted", 2)], "dataset_id string, field string, state string, phase int")
    return coverage.reconcile(coverage.gaps(_coverage(spark, sf_dir)), stored)


@query(_COUNTED + """, s AS (SELECT dataset_id, sum(records) AS slots, sum(present) AS p, sum(verified) AS v, sum(conflicting) AS c FROM coverage GROUP BY 1),
    n AS (SELECT dataset_id, round(100.0 * p / slots, 1) AS coverage, round(100.0 * v / p, 1) AS evidence, round(100.0 * (p - c) / p, 1) AS consistency FROM s)
    SELECT dataset_id, coverage, CASE WHEN coverage >= 90 THEN 'good' WHEN coverage >= 70 THEN 'fair' ELSE 'poor' END AS coverage_tone, evidence,
    CASE WHEN evidence >= 90 THEN 'good' WHEN evidence >= 60 THEN 'fair' ELSE 'poor' END AS evidence_tone, consistency,
    CASE WHEN consistency >= 95 THEN 'good' WHEN consistency >= 85 THEN 'fair' ELSE 'poor' END AS consistency_tone FROM n""")
def health_signals(spark, sf_dir):
    return coverage.health(_coverage(spark, sf_dir))


@query(_COUNTED + """ SELECT dataset_id, field, CASE WHEN present = 0 THEN 'never_extracted' ELSE 'partial' END AS why FROM coverage WHERE present = 0 OR missing > 0""")
def backfill_targets(spark, sf_dir):
    return coverage.absent_fields(_coverage(spark, sf_dir), include_partial=True)


@query(_COUNTED + """ SELECT dataset_id, 'thinnest_field' AS finding, arg_min(field, (present, field)) AS detail FROM coverage WHERE present > 0 GROUP BY 1
    UNION ALL SELECT dataset_id, 'conflicts', CAST(CAST(sum(conflicting) AS BIGINT) AS VARCHAR) FROM coverage GROUP BY 1 HAVING sum(conflicting) > 0
    UNION ALL SELECT dataset_id, 'never_extracted', string_agg(field, ',' ORDER BY field) FROM coverage WHERE present = 0 GROUP BY 1""")
def findings(spark, sf_dir):
    return profile.findings(_coverage(spark, sf_dir))


# profile

@query(f"""WITH {CELLS}, c AS (SELECT dataset_id, field, trim(value) AS value, count(*) AS n FROM cells WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY ALL)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dataset_id, field ORDER BY n DESC, value) AS INTEGER) AS place FROM c) WHERE place <= 12""")
def value_counts_topk(spark, sf_dir):
    return profile.value_counts(cells(spark, sf_dir))


_FILLED = f"""(trim(value) <> '' AND lower(trim(value)) NOT IN ({_ABSENT}) AND lower(trim(trim(value), '[]()"'' ')) NOT IN ({_ABSENT}) AND regexp_matches(value, '[A-Za-z0-9]'))"""
_NUMBER = r"""(CASE WHEN regexp_full_match(regexp_replace(regexp_replace(trim(value), '\s*(?:%|eur|usd|inr|gbp|million|billion|bn|mn|m|k)$', '', 'i'), '[,$\s]', '', 'g'), '-?[0-9]+(\.[0-9]+)?')
    THEN CAST(regexp_replace(regexp_replace(trim(value), '\s*(?:%|eur|usd|inr|gbp|million|billion|bn|mn|m|k)$', '', 'i'), '[,$\s]', '', 'g') AS DOUBLE) END)"""


@query(f"""WITH {CELLS}, f AS (SELECT *, {_NUMBER} AS number FROM cells WHERE {_FILLED}),
    g AS (SELECT dataset_id, field, count(*) AS filled, count(DISTINCT lower(trim(value))) AS "distinct", count(number) AS numbers, CAST(0 AS BIGINT) AS dates, min(number) AS low, max(number) AS high FROM f GROUP BY ALL)
    SELECT *, CASE WHEN numbers >= 2 AND numbers >= 0.6 * filled THEN 'numeric' WHEN "distinct" < filled THEN 'categorical' ELSE 'scalar' END AS kind FROM g""")
def field_profile(spark, sf_dir):
    return profile.field_profile(cells(spark, sf_dir))


@query("""WITH e AS (SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1),
    b AS (SELECT o_orderpriority, CAST(least(11, floor((o_totalprice - low) / ((high - low) / 12))) AS INTEGER) AS bucket, count(*) AS n FROM orders JOIN e USING (o_orderpriority) GROUP BY ALL),
    f AS (SELECT *, unnest(range(12)) AS bucket FROM e)
    SELECT o_orderpriority, CAST(f.bucket AS INTEGER) AS bucket, round(low + f.bucket * ((high - low) / 12), 4) AS "from", round(low + (f.bucket + 1) * ((high - low) / 12), 4) AS "to", coalesce(n, 0) AS n
    FROM f LEFT JOIN b USING (o_orderpriority, bucket)""")
def histogram_12(spark, sf_dir):
    return profile.histogram(load(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])


@query("""WITH c AS (SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL),
    f AS (SELECT o_orderstatus, CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM c GROUP BY 1 HAVING sum(n) >= 2)
    SELECT o_orderstatus, year, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (o_orderstatus, year)""")
def timeline_zero_fill(spark, sf_dir):
    return profile.timeline(load(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")), "year", ["o_orderstatus"])


@query("""WITH p AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN n_name || ', ' || r_name ELSE n_name END AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT trim(split_part(place, ',', 1)) AS place, count(*) AS n, count(DISTINCT place) AS spellings FROM p GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12""")
def place_consolidation(spark, sf_dir):
    rows = load(spark, sf_dir, "supplier").join(F.broadcast(load(spark, sf_dir, "nation")), F.expr("s_nationkey = n_nationkey")).join(F.broadcast(load(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
    return profile.places(rows.withColumn("place", F.when(F.col("s_suppkey") % 2 == 0, F.concat("n_name", F.lit(", "), "r_name")).otherwise(F.col("n_name"))), "place")


# hosts

_YIELD = """y AS (SELECT dataset_id, regexp_replace(lower(regexp_extract(url, '//([^/]*)', 1)), '^www\\.', '') AS host, count(*) AS cells, count(*) FILTER (WHERE verification_status = 'verified') AS verified,
    count(*) FILTER (WHERE verification_status = 'conflicting') AS conflicting, count(DISTINCT record_id) AS records FROM cells WHERE value IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {CELLS}, {_YIELD} SELECT *, cells - verified - conflicting AS unverified, round(verified / cells, 3) AS verified_share FROM y")
def yield_by_host(spark, sf_dir):
    return hosts.yield_by_host(cells(spark, sf_dir))


def _visits(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("https://www.site"), (F.col("user_id") % 25).cast("string"), F.lit(".example.org/")).alias("url"), (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "error").alias("blocked"), F.col("ts").cast("timestamp").alias("at"))


_COUNTERS = """v AS (SELECT 'site' || user_id % 25 || '.example.org' AS host, count(*) AS visits, count(*) FILTER (WHERE event_type <> 'error') AS successes, count(*) FILTER (WHERE event_type = 'error') AS block_count,
    max(ts) AS last_seen, max(ts) FILTER (WHERE event_type <> 'error') AS last_success_at FROM events GROUP BY 1),
    k AS (SELECT v.*, coalesce(cells, 0) AS cells, coalesce(verified_cells, 0) AS verified_cells FROM v LEFT JOIN (SELECT host, CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(verified) AS BIGINT) AS verified_cells FROM y GROUP BY 1) USING (host))"""


def _counters(spark, sf_dir):
    return hosts.counters(_visits(spark, sf_dir), hosts.yield_by_host(cells(spark, sf_dir)))


@query(f"WITH {CELLS}, {_YIELD}, {_COUNTERS} SELECT host, visits, successes, block_count, last_seen, last_success_at, cells, verified_cells FROM k")
def host_left_join(spark, sf_dir):
    return _counters(spark, sf_dir)


@query(f"""WITH {CELLS}, {_YIELD}, {_COUNTERS}, d AS (SELECT *, pow(0.5, greatest(0, epoch(TIMESTAMP '{NOW}' - coalesce(last_success_at, last_seen)) / 86400.0) / 30.0) AS fresh FROM k),
    s AS (SELECT *, greatest(0.0, least(1.0, 0.7 * CASE WHEN cells > 0 THEN verified_cells / cells ELSE 0 END * fresh + 0.3 * successes / visits * (0.5 + 0.5 * fresh) - least(0.5, block_count * 0.1))) AS score FROM d)
    SELECT host, visits, successes, block_count, last_seen, last_success_at, cells, verified_cells, round(CASE WHEN visits < 3 THEN 0.5 * score + 0.125 ELSE score END, 4) AS trust FROM s""")
def rank_hosts(spark, sf_dir):
    return hosts.ranked(_counters(spark, sf_dir), now())


@query(f"WITH {CELLS}, {_YIELD}, {_COUNTERS} SELECT host, visits, successes, block_count FROM k WHERE block_count >= 3 AND visits >= 4 AND successes <= 0.25 * visits OR host = 'site1.example.org'")
def blocked_hosts(spark, sf_dir):
    found = _counters(spark, sf_dir)
    return hosts.blocked(found).union(found.filter("host = 'site1.example.org'")).select("host", "visits", "successes", "block_count").distinct()


_STALE = f"""f AS (SELECT dataset_id, field, max(retrieved_at) FILTER (WHERE verification_status = 'verified') AS proven FROM cells WHERE value IS NOT NULL GROUP BY ALL),
    s AS (SELECT dataset_id, field, round(greatest(0.0, epoch(TIMESTAMP '{NOW}' - proven) / 86400.0), 3) AS age_days, CASE WHEN regexp_matches(field, '{"|".join(D.FAST_HINTS)}') THEN 14.0
    WHEN regexp_matches(field, '{"|".join(D.STABLE_HINTS)}') THEN 365.0 ELSE 45.0 END AS stale_after FROM f)"""


@query(f"WITH {CELLS}, {_STALE} SELECT dataset_id, field, age_days, CAST(stale_after AS DOUBLE) AS stale_after, coalesce(age_days > stale_after, true) AS stale FROM s")
def refresh_order(spark, sf_dir):
    return hosts.refresh_order(hosts.staleness(hosts.freshness(cells(spark, sf_dir)), now()))


@query(f"""WITH {CELLS}, {_STALE}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY age_days) AS r, count(*) OVER (PARTITION BY dataset_id) AS n FROM s)
    SELECT dataset_id, round(100.0 * count(*) FILTER (WHERE age_days > stale_after) / count(*), 1) AS stale_pct, max(age_days) AS max_age_days, max(age_days) FILTER (WHERE r = n // 2 + 1) AS median_age_days FROM o GROUP BY 1""")
def staleness_median_upper(spark, sf_dir):
    return hosts.dataset_staleness(hosts.staleness(hosts.freshness(cells(spark, sf_dir)), now()))


@query("""WITH r AS (SELECT event_type AS rung, value AS ms, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS age FROM events),
    o AS (SELECT rung, ms, row_number() OVER (PARTITION BY rung ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY rung) AS n FROM r WHERE age <= 200)
    SELECT rung, max(n) AS n, max(n) AS ok, max(ms) FILTER (WHERE i = n // 2) AS p50, max(ms) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.9) AS BIGINT))) AS p90 FROM o GROUP BY 1""")
def timing_percentiles(spark, sf_dir):
    return hosts.timing(load(spark, sf_dir, "events").select(F.col("event_type").alias("rung"), F.col("value").alias("ms"), F.col("event_id").alias("seq"), F.lit(True).alias("ok")))


_HOST = "lower(regexp_extract(url, '//([^/]*)', 1))"


@query(f"""SELECT host, page_id, place FROM (SELECT {_HOST} AS host, page_id, CAST(row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS INTEGER) AS place FROM pages) WHERE place <= 3""")
def per_domain_cap(spark, sf_dir):
    rows = load(spark, sf_dir, "pages").select("page_id", U.authority_host(F.col("url")).alias("host"))
    return hosts.cap_per_host(rows, 3, [F.col("page_id")]).select("host", "page_id", "place")


@query(f"""SELECT host, page_id FROM (SELECT {_HOST} AS host, page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS p FROM pages) WHERE p = 1""")
def diversity_one_per_host(spark, sf_dir):
    rows = load(spark, sf_dir, "pages").select("page_id", U.authority_host(F.col("url")).alias("host"))
    return hosts.cap_per_host(rows, 1, [F.col("page_id")]).select("host", "page_id")


@query("""SELECT regexp_replace(lower(regexp_extract(url, '//([^/]*)', 1)), '^www\\.', '') AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars, max(page_id) AS newest FROM pages GROUP BY 1""")
def list_sources(spark, sf_dir):
    return load(spark, sf_dir, "pages").groupBy(U.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"), F.max("page_id").alias("newest"))


@query("""WITH RECURSIVE s AS (SELECT CAST(user_id % 25 AS VARCHAR) AS host, event_type <> 'error' AS ok, greatest(0, least(60, coalesce(value, 0) / 10)) AS target, greatest(0, coalesce(value, 0) / 10) AS heard,
        CASE WHEN event_id % 97 = 0 THEN 15.0 ELSE 0.0 END AS retry, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) AS n FROM events),
    f AS (SELECT host, n, greatest(target, retry, CASE WHEN ok THEN target / 2 ELSE 0 END) AS delay, heard AS latency FROM s WHERE n = 1
          UNION ALL SELECT s.host, s.n, greatest(target, retry, CASE WHEN ok THEN (f.delay + target) / 2 ELSE f.delay END), (f.latency + heard) / 2 FROM f JOIN s ON s.host = f.host AND s.n = f.n + 1)
    SELECT host, round(CAST(max_by(delay, n) AS DOUBLE), 6) AS delay, round(CAST(max_by(latency, n) AS DOUBLE), 6) AS latency, max(n) AS samples FROM f GROUP BY 1""")
def throttle_delay(spark, sf_dir):
    found = throttle.delays(throttle_samples(spark, sf_dir))
    return found.select("host", F.round("delay", 6).alias("delay"), F.round("latency", 6).alias("latency"), "samples")


def throttle_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers of 25 hosts; a value is ten times a latency, and some ask to wait 15 s."""
    retry = F.when(F.col("event_id") % 97 == 0, 15.0)
    return load(spark, sf_dir, "events").select((F.col("user_id") % 25).cast("string").alias("host"), F.col("event_id").alias("seq"), (F.col("value") / 10).alias("latency"), (F.col("event_type") != "error").alias("ok"), retry.alias("retry_after"))


# records, filters, joins

@query(f"""WITH {CELLS}, r AS (SELECT dataset_id, record_id, '{{' || string_agg('"' || field || '":"' || value || '"', ',' ORDER BY field) FILTER (WHERE value IS NOT NULL) || '}}' AS j FROM cells GROUP BY ALL)
    SELECT dataset_id, record_id FROM r WHERE contains(lower(j), 'building') ORDER BY 1, 2 LIMIT 20 OFFSET 5""")
def scan_records_paged(spark, sf_dir):
    return records.search(records.documents_of(cells(spark, sf_dir)), "BUILDING", 20, 5).select("dataset_id", "record_id")


@query(f"""WITH {CELLS} SELECT dataset_id, record_id, max(CASE WHEN field = 'balance' THEN value END) AS balance, max(CASE WHEN field = 'segment' THEN value END) AS segment FROM cells GROUP BY ALL
    HAVING try_cast(replace(max(CASE WHEN field = 'balance' THEN value END), '$', '') AS DOUBLE) > 5000 AND contains(lower(max(CASE WHEN field = 'segment' THEN value END)), 'auto')""")
def records_where_gt_currency(spark, sf_dir):
    found = records.records_where(records.documents_of(cells(spark, sf_dir)), [("balance", "gt", 5000), ("segment", "contains", "AUTO")])
    return found.select("dataset_id", "record_id", F.try_element_at("fields", F.lit("balance")).alias("balance"), F.try_element_at("fields", F.lit("segment")).alias("segment"))


@query(f"WITH {CELLS} SELECT dataset_id, field, count(*) FILTER (WHERE {_FILLED}) AS filled, count(*) FILTER (WHERE NOT coalesce({_FILLED}, false)) AS not_filled FROM cells GROUP BY ALL")
def filled_predicate(spark, sf_dir):
    filled = C.is_filled(F.col("value"))
    return cells(spark, sf_dir).groupBy("dataset_id", "field").agg(F.count_if(filled).alias("filled"), F.count_if(~filled).alias("not_filled"))


@query(f"""WITH {CELLS} SELECT dataset_id, field, count(*) AS n, count(*) FILTER (WHERE value IS NULL OR trim(value) = '' OR lower(trim(value)) IN ({_ABSENT}) OR NOT regexp_matches(value, '[\\p{{L}}\\p{{N}}]')) AS placeholders FROM cells GROUP BY ALL""")
def placeholder_predicate(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("dataset_id", "field").agg(F.count("*").alias("n"), F.count_if(C.is_placeholder(F.col("value"))).alias("placeholders"))


_MONEY = "CASE c_custkey % 6 WHEN 0 THEN '$' || c_custkey || '.5m' WHEN 1 THEN '£' || c_custkey || ',000' WHEN 2 THEN c_custkey || ' billion' WHEN 3 THEN 'about ' || c_custkey WHEN 4 THEN 'Series B' ELSE c_custkey || 'k' END"
_MONEY_SQL = f"m AS (SELECT c_custkey, {_MONEY} AS money FROM customer)"


def _money(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", F.expr(_MONEY).alias("money"))


@query(f"""WITH {_MONEY_SQL} SELECT c_custkey, CASE WHEN regexp_matches(money, '^[$£€¥₹A-Z]?[0-9][0-9,]*(\\.[0-9]+)?\\s*(bn|b|million|mn|thousand|m|k|billion)?\\s*$')
    THEN CAST(regexp_replace(money, '[^0-9.]', '', 'g') AS DOUBLE) * CASE WHEN regexp_matches(money, '(billion|bn|b)', 'i') THEN 1e9 WHEN regexp_matches(money, '(million|mn|m)', 'i') THEN 1e6
    WHEN regexp_matches(money, '(thousand|k)', 'i') THEN 1e3 ELSE 1 END END AS number FROM m""")
def numeric_companion(spark, sf_dir):
    return _money(spark, sf_dir).select("c_custkey", N.gate_number(F.col("money")).alias("number"))


@query(f"""WITH {_MONEY_SQL}, l AS (SELECT c_custkey, money, regexp_replace(lower(trim(money)), 'usd|gbp|eur', '', 'g') AS low FROM m),
    f AS (SELECT *, CASE {" ".join(f"WHEN contains(low, '{w}') THEN '{w}'" for w, _ in N.MAGNITUDES)} ELSE '' END AS word FROM l),
    d AS (SELECT *, regexp_replace(CASE WHEN word = '' THEN low ELSE replace(low, word, ' ') END, '[^0-9.\\-]', '', 'g') AS digits FROM f)
    SELECT c_custkey, CASE WHEN regexp_full_match(digits, '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN CAST(digits AS DOUBLE) * CASE word {" ".join(f"WHEN '{w}' THEN {v:.0f}" for w, v in N.MAGNITUDES)} ELSE 1 END END AS number,
    CASE WHEN contains(money, '£') THEN '£' WHEN contains(money, '$') OR contains(lower(money), 'usd') THEN '$' ELSE '' END AS sign FROM d""")
def money_parse(spark, sf_dir):
    return _money(spark, sf_dir).select("c_custkey", N.agent_number(F.col("money")).alias("number"), N.currency_sign(F.col("money")).alias("sign"))


@query("SELECT c_custkey, c_name, position FROM customer JOIN (VALUES (0, 30), (1, 4), (2, 17), (3, 4)) AS w(position, k) ON c_custkey = k")
def in_list_ordered(spark, sf_dir):
    return records.in_order_of(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", [30, 4, 17, 4]).select("c_custkey", "c_name", F.col("position").cast("int").alias("position"))


# joins over whole tables: unmatched rows are those that the tables have

_NUMBER = "CAST(regexp_extract({}, '[0-9]+', 0) AS BIGINT)"


def _names_of_orders(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Cüstomer-"), F.col("o_custkey").cast("string")).alias("name"))


def _names_of_customers(spark, sf_dir):
    number = F.regexp_extract("c_name", "[0-9]+", 0).cast("long").cast("string")
    return load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("CUSTOMER #"), number, F.lit(" (stored)")).alias("name"))


@query(f"WITH n AS (SELECT {_NUMBER.format('c_name')} AS number, min(c_custkey) AS matched_id FROM customer GROUP BY 1) SELECT o_orderkey, matched_id FROM orders JOIN n ON o_custkey = number")
def identity_join(spark, sf_dir):
    return dedupe.identity_join(_names_of_orders(spark, sf_dir), _names_of_customers(spark, sf_dir), ["name"], "c_custkey")[0].select("o_orderkey", "matched_id")


@query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = {_NUMBER.format('c_name')})")
def identity_anti_unmatched(spark, sf_dir):
    return dedupe.identity_join(_names_of_customers(spark, sf_dir), _names_of_orders(spark, sf_dir), ["name"], "o_orderkey")[1].select("c_custkey")


@query(f"""SELECT 'customers' AS dataset_id, count(*) AS n, string_agg('c' || c_custkey, ',' ORDER BY 'c' || c_custkey) FILTER (WHERE r <= 3) AS examples FROM
    (SELECT c_custkey, row_number() OVER (ORDER BY 'c' || c_custkey) AS r FROM customer WHERE {_NUMBER.format('c_name')} IN (SELECT {_NUMBER.format('s_name')} FROM supplier)) HAVING count(*) > 0""")
def cross_dataset_semi(spark, sf_dir):
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("long").cast("string")
    own = load(spark, sf_dir, "supplier").select(number("s_name").alias("name"))
    others = load(spark, sf_dir, "customer").select(F.lit("customers").alias("dataset_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"), number("c_name").alias("name"))
    return dedupe.duplicates_across(own, others, ["name"])


@query("SELECT page_id FROM pages WHERE page_id IN (SELECT event_id FROM events)")
def reuse_semi(spark, sf_dir):
    seen = load(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"))
    return load(spark, sf_dir, "pages").select("page_id").join(seen, "page_id", "left_semi")


@query("(SELECT n_nationkey FROM nation INTERSECT SELECT c_nationkey FROM customer) EXCEPT SELECT r_regionkey FROM region")
def intersect_except(spark, sf_dir):
    nations, customers, regions = load(spark, sf_dir, "nation"), load(spark, sf_dir, "customer"), load(spark, sf_dir, "region")
    return nations.select("n_nationkey").intersect(customers.select("c_nationkey")).exceptAll(regions.select("r_regionkey"))


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey) GROUP BY 1""")
def insert_or_ignore(spark, sf_dir):
    stored = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_custkey"))
    fresh = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus").withColumn("seq", F.col("o_orderkey"))
    return records.first_per_key(records.insert_new(stored, fresh, ["o_custkey"]), ["o_custkey"], "seq").drop("seq")


def _folded(c: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_replace({c}, '[*_`]', '', 'g'), '\\s+', ' ', 'g'), '^ ', ''))"


@query(f"SELECT item_id AS quote_id, doc_id AS page_id FROM benchmark b JOIN documents d ON contains({_folded('d.text')}, rtrim({_folded('b.text')}))")
def quote_containment(spark, sf_dir):
    return verify.quote_matches(load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text"))


@query("""WITH RECURSIVE p AS (SELECT 'u' || page_id AS url, CASE WHEN page_id % 16 = 0 THEN NULL ELSE 'u' || CASE WHEN page_id % 2 = 1 THEN page_id - 1 ELSE page_id - 2 END END AS parent_url FROM pages),
    tree(url, root, depth) AS (SELECT url, url, 0 FROM p WHERE parent_url IS NULL UNION ALL SELECT p.url, t.root, t.depth + 1 FROM p JOIN tree t ON p.parent_url = t.url WHERE t.depth < 10)
    SELECT url, root, CAST(depth AS INTEGER) AS depth FROM tree""")
def recursive_crawl_tree(spark, sf_dir):
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    key = F.col("page_id")
    parent = F.when(key % 16 == 0, None).when(key % 2 == 1, name(key - 1)).otherwise(name(key - 2))
    return pages.crawl_tree(load(spark, sf_dir, "pages").select(name(key).alias("url"), parent.alias("parent_url")))


# windows, latest rows, sets

@query("""SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS place, CAST(rank() OVER w AS INTEGER) AS ranked, CAST(dense_rank() OVER w AS INTEGER) AS dense FROM orders
    WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)""")
def rank_family(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("place"), F.rank().over(w).alias("ranked"), F.dense_rank().over(w).alias("dense"))


_WRITES = "w AS (SELECT user_id, event_id, event_type AS digest, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), v AS (SELECT user_id, event_id, digest, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS revision FROM w WHERE r = 1 OR digest IS DISTINCT FROM before)"


def _revisions(spark, sf_dir):
    return records.revisions(load(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("digest")), ["user_id"], "event_id", "digest")


@query(f"WITH {_WRITES} SELECT * FROM v")
def revision_numbering(spark, sf_dir):
    return _revisions(spark, sf_dir)


@query(f"WITH {_WRITES} SELECT user_id, max(event_id) AS event_id, arg_max(digest, revision) AS digest, max(revision) AS revision FROM v GROUP BY 1")
def latest_revision(spark, sf_dir):
    return records.latest_revision(_revisions(spark, sf_dir), ["user_id"])


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_per_key(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return records.latest_per_key(rows.withColumn("seq", F.col("event_id")), ["user_id"], "seq").select("user_id", "event_id", "event_type")


@query("""SELECT run_id, seq, dropped FROM (SELECT 'run' || user_id AS run_id, event_id AS seq, greatest(0, count(*) OVER (PARTITION BY user_id) - 20) AS dropped,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20""")
def ring_last_n(spark, sf_dir):
    return records.last_events(run_events(spark, sf_dir), 20).select("run_id", "seq", "dropped")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 1 NULLS LAST LIMIT 3")
def capped_query(spark, sf_dir):
    return guarded_sql.run(load(spark, sf_dir, "customer"), "SELECT c_mktsegment, count(*) AS n FROM records GROUP BY c_mktsegment ORDER BY n DESC", 3)


# scalars

@query("""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || regexp_extract(url, '^[a-zA-Z]+://([^?#]*)', 1) || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical,
    regexp_replace(lower(regexp_extract(url, '//([^/?#:]*)', 1)), '^www\\.', '') AS host FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
    lambda p: p <> '' AND NOT list_contains([""" + ", ".join(f"'{k}'" for k in U.TRACKING_KEYS) + """], lower(split_part(p, '=', 1)))), '&') AS kept FROM pages)""")
def canonical_url(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"), U.host_of(F.col("url")).alias("host"))


@query("""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '//([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages),
    l AS (SELECT *, string_split(host, '.') AS parts FROM h)
    SELECT page_id, CASE WHEN len(parts) >= 3 AND regexp_matches(host, '^[a-z]{2}(-[a-z]{2})?\\.') AND NOT (len(parts) = 3 AND list_contains(['co','com','org','net','gov','ac','edu','ne','or'], parts[2]))
    THEN regexp_replace(host, '^[^.]*\\.', '') ELSE host END AS site FROM l""")
def site_host(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", U.site_host(U.authority_host(F.col("url"))).alias("site"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(pdf|docx|pptx|xlsx)$') THEN 'document:docling' WHEN contains(lower(url), '/api') OR lower(url) LIKE '%.json' THEN 'structured:api'
    WHEN page_id % 5 = 0 THEN 'web:crawl4ai' ELSE 'web:http' END AS route FROM pages WHERE regexp_matches(url, '^https?://[^/]')""")
def triage_route(spark, sf_dir):
    hint = F.when(F.col("page_id") % 5 == 0, "js-heavy")
    return load(spark, sf_dir, "pages").select("page_id", U.route(F.col("url"), None, hint).alias("route")).filter("route is not null")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""")
def date_parse(spark, sf_dir):
    day = F.col("o_orderdate")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "d MMM yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "MMM d, yyyy")).otherwise(F.date_format(day, "yyyy-M-d"))
    return load(spark, sf_dir, "orders").select("o_orderkey", D.iso_date(shown).alias("iso"))


@query("SELECT c_custkey, CASE WHEN c_custkey < 1000 THEN '(0) ' || c_custkey ELSE '+555' || c_custkey END AS phone FROM customer")
def phone_norm(spark, sf_dir):
    shown = F.when(F.col("c_custkey") < 1000, F.concat(F.lit("(0) "), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("555-"), F.col("c_custkey").cast("string")))
    return load(spark, sf_dir, "customer").select("c_custkey", T.phone(shown).alias("phone"))


@query(r"SELECT s_suppkey, regexp_replace(trim(regexp_replace(lower(s_name || ' Ltd. Co'), '\b(ltd|inc|llc|pvt|private|limited|corp|co)\b\.?', '', 'g')), '\s+', ' ', 'g') AS company FROM supplier")
def company_norm(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", T.company(F.concat("s_name", F.lit(" Ltd. Co"))).alias("company"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '''' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS safe FROM customer")
def csv_guard(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", C.csv_safe(F.floor("c_acctbal").cast("string")).alias("safe"))


@query(f"""WITH {CELLS} SELECT dataset_id, record_id, field, CASE WHEN record_key % 9 = 8 THEN 'search' ELSE m END AS read_method, confidence, CASE WHEN confidence >= 0.9 THEN 'sure' WHEN confidence >= 0.75 THEN 'likely' ELSE 'check' END AS certainty
    FROM (SELECT *, CASE WHEN verification_status <> 'verified' THEN 0.0 WHEN record_key % 9 = 8 THEN 0.7 ELSE list_extract([{", ".join(str(v) for v in S.METHOD_PRIOR.values())}], CAST(record_key % 9 + 1 AS INTEGER)) END AS confidence,
    list_extract([{", ".join(f"'{k}'" for k in S.METHOD_PRIOR)}], CAST(record_key % 9 + 1 AS INTEGER)) AS m FROM cells)""")
def confidence_receipt(spark, sf_dir):
    names = F.array(*map(F.lit, [*S.METHOD_PRIOR, "guess"]))
    receipt = S.receipt(F.get(names, (F.col("record_key") % 9).cast("int")), F.col("verification_status") == "verified")
    return cells(spark, sf_dir).select("dataset_id", "record_id", "field", receipt.alias("r")).select("dataset_id", "record_id", "field", "r.*")


@query(f"SELECT event_id, round(pow(0.5, greatest(0, epoch(TIMESTAMP '{NOW}' - ts) / 86400.0) / 30.0), 6) AS decay FROM events")
def decay_trust(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(D.decay(F.col("ts").cast("timestamp"), now()), 6).alias("decay"))


_STEM = " ".join(f"WHEN word LIKE '%{s}' AND length(word) - {len(s)} > 3 THEN left(word, length(word) - {len(s)}) || '{p}'" for s, p in T.STEM_SUFFIXES)


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) SELECT word, CASE {_STEM} ELSE word END AS stem FROM w")
def relevance_stem(spark, sf_dir):
    words = load(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'question' WHEN c_custkey % 5 = 1 THEN 'headline prefix' WHEN c_custkey % 5 = 2 THEN 'headline marker' WHEN c_custkey % 5 = 3 THEN 'top n' END AS reason FROM customer""")
def entity_gate(spark, sf_dir):
    extra = F.get(F.array(F.lit("?"), F.lit("Exclusive: "), F.lit(" raises round"), F.lit(" top 7"), F.lit("")), (F.col("c_custkey") % 5).cast("int"))
    name = F.when(F.col("c_custkey") % 5 == 1, F.concat(extra, "c_name")).otherwise(F.concat("c_name", extra))
    return load(spark, sf_dir, "customer").select("c_custkey", C.entity_rejection(name).alias("reason"))


# pages

@query("""SELECT page_id, CAST(position - 1 AS INTEGER) AS position, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS position FROM pages)""")
def links(spark, sf_dir):
    return pages.hrefs(load(spark, sf_dir, "pages"))


@query(f"""SELECT doc_id AS page_id, nullif(regexp_extract(text, '{pages.FIELD_PATTERNS["email"]}', 0), '') AS email FROM documents""")
def regex_fields(spark, sf_dir):
    return pages.regex_fields(load(spark, sf_dir, "documents").withColumnRenamed("doc_id", "page_id"), ["email"])


@query(r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script[^>]*>.*?</script>', '', 'gs'), '<head>.*?</head>', '', 'gs'), '<nav>.*?</nav>', '', 'gs'), '<footer>.*?</footer>', '', 'gs') AS h FROM pages),
    p AS (SELECT page_id, string_split(replace(replace(replace(replace(regexp_replace(regexp_replace(h, '</?(p|div|li|tr|br|h[1-6]|article|section|ul|ol|table|pre|blockquote)(\s[^>]*)?/?>', chr(10), 'g'), '<[!/]?[a-zA-Z][^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(10)) AS lines FROM t),
    l AS (SELECT page_id, array_to_string(list_filter(list_transform(lines, lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM p)
    SELECT page_id, sha256(text) AS sha256, length(text) AS n_chars FROM l""")
def html_text(spark, sf_dir):
    return pages.evidence_text(load(spark, sf_dir, "pages"), 1 << 30).select("page_id", F.sha2("text", 256).alias("sha256"), F.length("text").alias("n_chars"))


#: The links of the tables' pages: all are root-relative and quoted; an address counts once, where it stands first.
_LINKS = r"""WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS site, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*"[^>]*>([^<]*)</a>', 1)) AS anchor,
        unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>[^<]*</a>', 1)))) AS n FROM pages),
    f AS (SELECT page_id, site || replace(regexp_extract(href, '^[^#]*'), '&amp;', '&') AS url, min(n) AS n, arg_min(trim(regexp_replace(replace(anchor, '&amp;', '&'), '\s+', ' ', 'g')), n) AS anchor FROM a GROUP BY ALL),
    links AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS position, url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, anchor FROM f)"""


@query(_LINKS + r""" SELECT *, url AS canonical FROM links""")
def page_links_resolved(spark, sf_dir):
    return pages.links(load(spark, sf_dir, "pages"), limit=None, longest=None)


def _chunk_end(start: str) -> str:
    """Where a chunk from ``start`` ends: at the last blank line, else the last space, of its last 600 characters."""
    end = f"least(length(text), {start} + 6000)"
    zone = f"greatest({start} + 1, {end} - 600)"
    tail = f"substr(text, {zone} + 1, {end} - {zone})"
    before = lambda mark: f"{zone} + length(regexp_extract({tail}, '^(.*){mark}', 1, 's'))"
    return f"CASE WHEN {end} = length(text) THEN {end} WHEN contains({tail}, chr(10) || chr(10)) THEN {before('[' + chr(92) + 'n][' + chr(92) + 'n]')} WHEN contains({tail}, ' ') THEN {before(' ')} ELSE {end} END"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS position, CAST(0 AS BIGINT) AS start, CAST({_chunk_end("0")} AS BIGINT) AS stop FROM documents WHERE text <> ''
    UNION ALL SELECT doc_id, text, position + 1, greatest(stop - 600, start + 1), {_chunk_end("greatest(stop - 600, start + 1)")} FROM c WHERE stop < length(text))
    SELECT doc_id, position, substr(text, start + 1, stop - start) AS chunk FROM c""")
def chunks(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks("text", most=None)).alias("position", "chunk"))


# entity resolution

@query("""SELECT min(s_suppkey) AS s_suppkey, count(*) AS merged FROM supplier GROUP BY CAST(regexp_extract(s_name, '[0-9]+', 0) AS BIGINT) % 40""")
def exact_signature_dedupe(spark, sf_dir):
    number = F.regexp_extract("s_name", "[0-9]+", 0).cast("long") % 40
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Süpplier #"), number.cast("string"), F.lit(" (S)")).alias("name"))
    return dedupe.exact(rows, ["name"], "s_suppkey").select("s_suppkey", "merged")


def _names(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("Ltd")).alias("p_name"))


#: The longest common subsequence row by row; ``row`` is the table's row for the letters of a so far.
_LCS = """list_reduce(list_transform(range(1, length(a) + 1), lambda i: [i]), lambda row, e: list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]),
    lambda acc, f: list_append(acc, CASE WHEN a[e[1]] = b[f[1]] THEN row[f[1]] + 1 ELSE greatest(row[f[1] + 1], acc[f[1]]) END), [CAST(0 AS BIGINT)]), list_resize([CAST(0 AS BIGINT)], length(b) + 1, 0))[length(b) + 1]"""


@query(f"""WITH n AS (SELECT trim(regexp_replace(lower(concat_ws(' ', p_name, p_type, 'Ltd')), '[^a-z0-9]+', ' ', 'g')) AS identity, min(p_partkey) AS id FROM part GROUP BY 1),
    s AS (SELECT id, list_filter(string_split(identity, ' '), lambda w: NOT list_contains({[w for w in T.LEGAL_FORMS]!r}, w)) AS words FROM n WHERE identity <> ''),
    j AS (SELECT id, array_to_string(words, ' ') AS stem, len(words) AS n FROM s WHERE len(words) > 0),
    k AS (SELECT id, 'p' || left(stem, 3) AS block FROM j UNION SELECT id, 's' || right(stem, 4) FROM j WHERE length(stem) > 1),
    m AS (SELECT DISTINCT x.id AS a_id, y.id AS b_id FROM k x JOIN k y ON x.block = y.block AND x.id < y.id),
    c AS (SELECT a_id, b_id, x.stem AS a, y.stem AS b FROM m JOIN j x ON x.id = a_id JOIN j y ON y.id = b_id
          WHERE x.n = y.n AND least(length(x.stem), length(y.stem)) >= 0.55 * greatest(length(x.stem), length(y.stem)) AND levenshtein(x.stem, y.stem) <= 0.12 * (length(x.stem) + length(y.stem)) + 1e-6)
    SELECT * FROM (SELECT a_id AS a, b_id AS b, 200.0 * {_LCS} / (length(a) + length(b)) AS similarity FROM c) WHERE similarity >= 88""")
def fuzzy_pairs(spark, sf_dir):
    return dedupe.similar_pairs(_names(spark, sf_dir), ["p_name"], "p_partkey")


# streams, run over files

@query("""SELECT 'run' || user_id AS run_id, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id) AS last_value, count(*) AS events, max(event_type IN ('purchase', 'error')) AS done, max(event_id) AS last_seq FROM events GROUP BY 1""")
def event_fold(spark, sf_dir):
    return stream.fold(stream.guarded(run_events(spark, sf_dir)))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    return stream.tumbling(run_events(spark, sf_dir)).select(F.col("window.start").alias("start"), "type", "n", F.round("total", 4).alias("total"))


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(back AS INTEGER)) AS start, event_type AS type, count(*) AS n FROM events, (VALUES (0), (1)) AS b(back) GROUP BY ALL""")
def sliding_window(spark, sf_dir):
    return stream.sliding(run_events(spark, sf_dir)).select(F.col("window.start").alias("start"), "type", "n")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o) SELECT 'run' || user_id AS run_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_window(spark, sf_dir):
    return stream.sessions(run_events(spark, sf_dir)).select("run_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT job_id, CAST(sum(credits) AS BIGINT) AS credits, count(*) AS charges FROM (SELECT DISTINCT user_id AS job_id, event_type, 1 + user_id % 3 AS credits FROM events) GROUP BY 1")
def dedup_ledger(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    charges = e.select(F.col("user_id").alias("job_id"), F.concat_ws(":", "user_id", "event_type").alias("charge_id"), (1 + F.col("user_id") % 3).alias("credits"))
    return stream.totals(stream.ledger(charges))


@query("""SELECT event_id, running, running <= 60 AS accepted FROM (SELECT event_id, CAST(sum(1 + user_id % 3) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events)""")
def metered_budget(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    charges = e.select("event_id", F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), (1 + F.col("user_id") % 3).alias("credits"))
    return stream.within_budget(charges, 60).select("event_id", "running", "accepted")


# crawling

@query("""SELECT event_type, count(*) AS requests, CAST(sum(event_id) AS BIGINT) AS bytes, count(*) FILTER (WHERE user_id % 7 = 0) AS errors, bool_or(user_id % 7 = 0) AS blocked FROM events GROUP BY 1""")
def politeness_stats(spark, sf_dir):
    status = F.when(F.col("user_id") % 7 == 0, 403).otherwise(200)
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("host"), status.alias("status"), F.col("event_id").alias("bytes"))
    return crawl.politeness(rows).withColumnRenamed("host", "event_type")


@query("""SELECT CASE user_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'fatal' WHEN 2 THEN 'retry' WHEN 3 THEN 'timeout' ELSE 'unknown' END AS outcome, count(*) AS n FROM events GROUP BY 1""")
def fetch_outcomes(spark, sf_dir):
    turn = F.col("user_id") % 5
    status = F.when(turn == 0, 204).when(turn == 1, 403).when(turn == 2, 503)
    error = F.when(turn == 3, "Read timed out").when(turn == 4, "odd")
    return load(spark, sf_dir, "events").groupBy(crawl.outcome(status, error).alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, s_suppkey % 3 <> 2 AS plausible FROM supplier""")
def search_plausibility(spark, sf_dir):
    name = F.lit("Acme Works, Inc.").substr(1, 10)
    url = F.when(F.col("s_suppkey") % 3 == 0, "https://www.acmeworks.com/").otherwise("https://news.example.org/a")
    title = F.when(F.col("s_suppkey") % 3 == 1, F.concat(name, F.lit(" names a chair"))).otherwise("Ten best firms")
    return load(spark, sf_dir, "supplier").select("s_suppkey", crawl.plausible(url, name, title).alias("plausible"))


@query(_LINKS + r""", w AS (SELECT *, regexp_extract_all(lower(regexp_replace(url, '^[a-z]+://[^/]*/?', '')), '[^/]+') AS parts, list_distinct(regexp_extract_all(lower(anchor), '[\p{L}\p{N}]{3,}')) AS words FROM links),
    h AS (SELECT *, len(list_distinct(list_transform(list_filter(words, lambda x: regexp_full_match(x, 'and|thing(s|es|ing|ings|ship)?')), lambda x: left(x, 3)))) AS hits,
          len(list_filter(regexp_extract_all(coalesce(parts[-1], ''), '[\p{L}\p{N}]{3,}'), lambda x: regexp_full_match(x, 'and|thing(s|es|ing|ings|ship)?'))) > 0 AS in_path FROM w)
    SELECT page_id, position, CAST(CASE WHEN len(parts) = 0 THEN -2.0 ELSE 0.0 END + CASE WHEN hits > 0 THEN 2.0 + 0.5 * (hits - 1) ELSE 0.0 END + CASE WHEN in_path THEN 1.0 ELSE 0.0 END + CASE WHEN anchor <> '' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM h""")
def link_scores(spark, sf_dir):
    found = pages.links(load(spark, sf_dir, "pages"), limit=None, longest=None)
    return found.select("page_id", "position", crawl.link_score(F.col("url"), F.col("anchor"), ["thing", "and"]).alias("score"))


# filling gaps

_HELD = "coalesce(value, '') <> ''"


@query(f"""WITH {CELLS} SELECT dataset_id, field, filled FROM (SELECT dataset_id, field, count(*) FILTER (WHERE trim(coalesce(value, '')) <> '') AS filled,
    row_number() OVER (PARTITION BY dataset_id ORDER BY count(*) FILTER (WHERE trim(coalesce(value, '')) <> '') DESC, min(position)) AS r FROM cells GROUP BY 1, 2) WHERE r = 1 AND filled > 0""")
def most_populated_field(spark, sf_dir):
    return gapfill.most_populated(cells(spark, sf_dir))


@query(f"""WITH {CELLS}, k AS (SELECT dataset_id, record_id, count(*) FILTER (WHERE trim(coalesce(value, '')) <> '') AS filled, count(*) FILTER (WHERE trim(coalesce(value, '')) <> '' AND field LIKE '%_name') AS named FROM cells GROUP BY 1, 2)
    SELECT dataset_id, record_id, filled, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY filled DESC, record_id) AS INTEGER) AS place FROM k WHERE named > 0) WHERE place <= 50""")
def searched_records(spark, sf_dir):
    return gapfill.searched_records(cells(spark, sf_dir), ["customer_name", "supplier_name", "part_name"], 50)


@query(f"""WITH {CELLS}, required(dataset_id, field) AS (VALUES ('customers', 'segment'), ('customers', 'balance'), ('suppliers', 'website'), ('parts', 'part_name')),
    r AS (SELECT c.dataset_id, record_id, (SELECT count(*) FROM required q WHERE q.dataset_id = c.dataset_id) - count(DISTINCT q.field) FILTER (WHERE {_HELD}) AS missing
          FROM cells c LEFT JOIN required q ON q.dataset_id = c.dataset_id AND q.field = c.field GROUP BY 1, 2)
    SELECT dataset_id, record_id, missing, CASE WHEN missing = 0 THEN 'kept' WHEN min(missing) OVER (PARTITION BY dataset_id) > 0 THEN 'rescued' ELSE 'dropped' END AS outcome FROM r""")
def required_fields(spark, sf_dir):
    required = [("customers", "segment"), ("customers", "balance"), ("suppliers", "website"), ("parts", "part_name")]
    return gapfill.required_gate(cells(spark, sf_dir), spark.createDataFrame(required, "dataset_id string, field string"))


@query(f"""WITH {CELLS} SELECT dataset_id, record_id, field, verification_status = 'judgment_unavailable' AND row_number() OVER (PARTITION BY dataset_id, verification_status = 'judgment_unavailable' ORDER BY record_id, field) <= 25 AS asked FROM cells""")
def judge_budget(spark, sf_dir):
    return gapfill.judged_within(cells(spark, sf_dir), 25).select("dataset_id", "record_id", "field", "asked")


@query(f"WITH {CELLS} SELECT dataset_id, verification_status AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY dataset_id), 6) AS share FROM cells WHERE {_HELD} GROUP BY 1, 2")
def verify_summary(spark, sf_dir):
    return gapfill.verify_summary(cells(spark, sf_dir))


@query(f"""WITH {CELLS} SELECT dataset_id, field, round(count(*) FILTER (WHERE regexp_matches(regexp_replace(value, '[,$%\\s]', '', 'g'), '^([-+]?([0-9]+[.]?[0-9]*|[.][0-9]+))?$')) / count(*), 6) AS share FROM cells WHERE {_HELD} GROUP BY 1, 2""")
def numeric_share(spark, sf_dir):
    return gapfill.numeric_share(cells(spark, sf_dir))


@query(f"""WITH {CELLS}, n AS (SELECT dataset_id, field, value, count(*) AS n, count(*) OVER (PARTITION BY dataset_id, field) AS distinct_values, row_number() OVER (PARTITION BY dataset_id, field ORDER BY count(*) DESC, value) AS r
    FROM cells WHERE {_HELD} GROUP BY 1, 2, 3) SELECT dataset_id, field, value, n FROM n WHERE distinct_values >= 2 AND r <= 8""")
def top_categories(spark, sf_dir):
    return gapfill.top_categories(cells(spark, sf_dir))


@query(f"""WITH {CELLS}, a AS (SELECT dataset_id, epoch(TIMESTAMP '{NOW}' - retrieved_at) / 86400.0 AS days FROM cells WHERE retrieved_at IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY days) - 1 AS i, count(*) OVER (PARTITION BY dataset_id) AS n FROM a)
    SELECT dataset_id, count(*) AS dated, count(*) FILTER (WHERE days <= 1) AS recent, max(CASE WHEN i = n // 2 THEN days END) AS median_days, max(days) AS oldest_days, round(count(*) FILTER (WHERE days <= 1) / count(*), 6) AS share FROM r GROUP BY 1""")
def fresh_share(spark, sf_dir):
    return gapfill.fresh_share(cells(spark, sf_dir), now())


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' Co., Pvt. Ltd'), '\b(ltd|inc|llc|pvt|private|limited|corp|co)\b', '', 'g'), '[^a-z0-9]+', '', 'g') AS key FROM part")
def document_key(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", gapfill.document_key(F.concat("p_name", F.lit(" Co., Pvt. Ltd"))).alias("key"))


_HOST = "regexp_replace(lower(regexp_extract({}, '//([^/?#:]*)', 1)), '^www\\.', '')"


@query(f"""WITH l AS (SELECT page_id, url AS website, 'https://' || CASE n WHEN 0 THEN 'www.linkedin.com/x' WHEN 1 THEN 'news.example.net/a' WHEN 2 THEN {_HOST.format('url')} || '/about' ELSE 'm.facebook.com/y' END AS url, n AS position FROM pages, range(4) AS t(n))
    SELECT page_id AS record_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE position WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END, position) AS INTEGER) AS place FROM l""")
def ranked_results(spark, sf_dir):
    shown = F.array(F.lit("www.linkedin.com/x"), F.lit("news.example.net/a"), F.concat(U.host_of(F.col("url")), F.lit("/about")), F.lit("m.facebook.com/y"))
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), F.col("url").alias("website"), F.posexplode(shown).alias("position", "at"))
    return gapfill.ranked_results(rows.withColumn("url", F.concat(F.lit("https://"), "at"))).select("record_id", "url", "place")


@query("""WITH runs AS (SELECT user_id AS run_id, bool_or(event_type = 'error') AS partial, max(event_type) AS status FROM events GROUP BY 1)
    SELECT c_custkey AS dataset_id, coalesce(partial OR status = 'PARTIAL', false) AS partial FROM customer LEFT JOIN runs ON run_id = c_custkey""")
def partial_runs(spark, sf_dir):
    runs = load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), (F.col("event_type") == "error").alias("partial"), F.col("event_type").alias("status"))
    datasets = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_custkey").alias("run_id"))
    return gapfill.partial_runs(datasets, runs).select("dataset_id", "partial")


@query("""WITH fields(field, position) AS (VALUES ('view', 1), ('click', 2), ('never', 3)), raw AS (SELECT user_id AS record_id, event_type AS field, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY 1, 2),
    e AS (SELECT user_id AS record_id, event_type AS field, arg_min(props, event_id) AS quote FROM events GROUP BY 1, 2)
    SELECT r.record_id, f.field, f.position, raw.value, coalesce(e.quote, '') AS quote, CASE WHEN e.quote IS NULL THEN 'llm' ELSE 'json' END AS read_method
    FROM (SELECT DISTINCT record_id FROM raw) r CROSS JOIN fields f LEFT JOIN raw USING (record_id, field) LEFT JOIN e USING (record_id, field)""")
def wrapped_records(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("field"), "event_id", "props")
    raw = e.groupBy("record_id", "field").agg(F.max("event_id").cast("string").alias("value"))
    evidence = e.select("record_id", "field", F.col("event_id").alias("ordinal"), F.col("props").alias("quote"), F.lit("json").alias("read_method"))
    return gapfill.wrapped(spark.createDataFrame([("view", 1), ("click", 2), ("never", 3)], "field string, position int"), raw, evidence)


# verdicts

@query(f"""WITH {CELLS} SELECT dataset_id, record_id, field, CASE WHEN verification_status <> 'verified' THEN 'unverifiable' WHEN NOT ({_HELD}) OR (lower(value) = 'na' AND position % 3 < 2) THEN 'empty'
    WHEN position % 3 < 2 THEN 'unchanged' ELSE 'changed' END AS decision FROM cells""")
def refresh_decisions(spark, sf_dir):
    # read again in capitals, with emphasis and more space, or with more said
    said = F.when(F.col("position") % 3 == 0, F.upper("value")).when(F.col("position") % 3 == 1, F.concat(F.lit("*"), F.replace("value", F.lit(" "), F.lit("  ")), F.lit("*"))).otherwise(F.concat("value", F.lit(" new")))
    said = F.when(F.lower("value") == "na", F.when(F.col("position") % 3 < 2, F.col("value")).otherwise(F.concat("value", F.lit(" new")))).otherwise(said)
    return cells(spark, sf_dir).select("dataset_id", "record_id", "field", verify.refresh_decision(F.col("value"), said, F.col("verification_status")).alias("decision"))


@query(f"""WITH {CELLS} SELECT dataset_id, record_id, field, CASE verdict WHEN 'B' THEN rival WHEN 'INSUFFICIENT' THEN NULL ELSE value END AS value, CASE verdict WHEN 'B' THEN 'adopted' WHEN 'INSUFFICIENT' THEN 'withdrawn' ELSE 'kept' END AS resolved
    FROM (SELECT *, list_extract(['A', 'B', 'INSUFFICIENT'], CAST(length(field) % 3 + 1 AS INTEGER)) AS verdict FROM cells WHERE rival IS NOT NULL)""")
def adjudicated(spark, sf_dir):
    verdict = F.get(F.array(F.lit("A"), F.lit("B"), F.lit("INSUFFICIENT")), F.length("field") % 3)
    return verify.adjudicate(cells(spark, sf_dir).filter("rival is not null").withColumn("verdict", verdict)).select("dataset_id", "record_id", "field", "value", "resolved")


@query(f"""WITH {CELLS} SELECT dataset_id, record_id, field, CASE WHEN verification_status <> 'judgment_unavailable' THEN verification_status WHEN length(field) > 8 THEN 'verified' WHEN length(field) > 6 THEN 'unverified' ELSE verification_status END AS verification_status FROM cells""")
def rejudged(spark, sf_dir):
    rows = cells(spark, sf_dir)
    verdict = F.when(F.length("field") > 8, "SUPPORTED").when(F.length("field") > 6, "NOT_SUPPORTED")
    verdicts = rows.filter("verification_status = 'judgment_unavailable'").select("record_id", "field", verdict.alias("verdict"))
    return verify.rejudge(rows, verdicts).select("dataset_id", "record_id", "field", "verification_status")


@query("""WITH g AS (SELECT user_id AS question, event_type, count(*) AS n FROM events GROUP BY 1, 2), q AS (SELECT question, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS models, max(n) AS largest FROM g GROUP BY 1)
    SELECT *, round(largest / models, 3) AS ratio, CASE WHEN models = 1 THEN 'single-model' WHEN clusters = 1 THEN 'unanimous' WHEN largest / models >= 0.6 THEN 'majority' WHEN largest / models >= 0.4 THEN 'split' ELSE 'polarised' END AS label FROM q""")
def answer_consensus(spark, sf_dir):
    return verify.consensus(load(spark, sf_dir, "events").select(F.col("user_id").alias("question"), F.upper("event_type").alias("answer")), most=None)


from . import process_queries, stored_queries  # noqa: E402, F401  they register their queries
