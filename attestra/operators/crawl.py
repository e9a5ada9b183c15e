"""Which links and results are worth a page: scores, caps, outcomes, and a crawl over stored pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.texts import stem

#: Path segments that navigate and hold no records.
NAVIGATION = tuple("""
about about-us contact contact-us login signin sign-in signup sign-up register
privacy privacy-policy terms terms-of-service legal cookies cookie-policy
careers jobs employment blog news tag tags category categories search
cart checkout account my-account help faq support subscribe newsletter press
media events sitemap feed rss share print wishlist returns shipping
""".split())
#: Statuses that end a fetch, and what an error text stands for, in order.
FATAL_STATUSES = (401, 402, 403, 451)
ERROR_CLASSES = (("timeout", "timeout|timed out"), ("dns", "name or service|getaddrinfo|dns"), ("tls", "ssl|certificate|tls"), ("refused", "refused|reset"), ("blocked", "captcha|forbidden|403|429"))


def _terms(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))
    return F.array_distinct(F.transform(words, stem))


def link_score(url: Column, anchor: Column, terms: list[str]) -> Column:
    """How likely a link is to hold records; below 0 it is not followed."""
    segments = F.filter(F.split(F.regexp_extract(F.lower(url), r"^[a-z]+://[^/?#]*/?([^?#]*)", 1), "/"), lambda s: s != "")
    keys = F.transform(F.split(F.regexp_extract(F.lower(url), r"\?([^#]*)", 1), "&"), lambda p: F.substring_index(p, "=", 1))
    tracking = F.size(F.array_intersect(keys, F.array(*map(F.lit, U.TRACKING_KEYS))))
    wanted = F.transform(F.array(*map(F.lit, terms)), stem) if terms else F.array().cast("array<string>")
    hits = F.size(F.array_intersect(_terms(anchor), wanted))
    last = F.coalesce(F.get(segments, F.size(segments) - 1), F.lit(""))
    score = (
        F.when(F.size(segments) == 0, -2.0).otherwise(0.0)
        + F.when(F.exists(F.slice(segments, 1, 2), lambda s: s.isin(*NAVIGATION)), -5.0).otherwise(0.0)
        + F.when(tracking > 0, -F.least(F.lit(4.0), 2.0 + 0.5 * tracking)).otherwise(0.0)
        + F.when(U.is_pagination(url, anchor), 3.0).otherwise(0.0)
        + F.when(hits > 0, 2.0 + 0.5 * (hits - 1)).otherwise(0.0)
        + F.when(F.size(F.array_intersect(_terms(last), wanted)) > 0, 1.0).otherwise(0.0)
        + F.when(F.btrim(F.coalesce(anchor, F.lit(""))) != "", 0.5).otherwise(0.0)
    )
    return F.when(U.authority_host(url) == "", -50.0).when(~F.lower(url).rlike("^https?:"), -50.0).otherwise(score)


def children(links: DataFrame, terms: list[str], per_parent: int = 8) -> DataFrame:
    """The best links of each page, one place kept for the best pagination link."""
    scored = links.withColumn("score", link_score(F.col("url"), F.col("anchor"), terms)).filter("score >= 0")
    page = U.is_pagination(F.col("url"), F.col("anchor"))
    best = Window.partitionBy("page_id").orderBy(F.desc("score"), "url")
    paged = Window.partitionBy("page_id", page).orderBy(F.desc("score"), "url")
    ranked = scored.withColumns({"place": F.row_number().over(best), "reserved": page & (F.row_number().over(paged) == 1)})
    return ranked.filter((F.col("place") <= per_parent - 1) | F.col("reserved")).drop("place", "reserved")


def plausible(url: Column, entity: Column, title: Column) -> Column:
    """Whether a search result can be about an entity: its own host, or its name in address or title."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    slug, host = plain(entity), plain(U.host_of(url))
    first = F.regexp_extract(F.lower(entity), "^[^a-z0-9]*([a-z0-9]+)", 1)
    named = F.contains(plain(url), F.left(slug, F.lit(10))) | F.contains(plain(title), F.left(slug, F.lit(10)))
    word = (F.length(first) >= 6) & (F.contains(plain(url), first) | F.contains(plain(title), first))
    return url.rlike("^https?://") & (F.length(slug) >= 4) & (host.startswith(F.left(slug, F.lit(12))) | named | word)


def candidate_pages(pages: DataFrame, needles: DataFrame, limit: int = 40, most_sent: int = 10_000) -> DataFrame:
    """Pages by how many identities they name. Needles (one column ``needle``) and page words meet by equality of the first word.

    Up to ``most_sent`` needles go to every task, and no page is shuffled. More of them meet the words of pages by shuffle, without the texts,
    and each text travels once to the needles that share a word with it.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    first = F.regexp_extract(F.lower("needle"), r"[\p{L}\p{N}]+", 0)
    named, rows = needles.distinct().withColumn("_word", first).filter("_word <> ''"), pages.select("page_id", "text")
    if named.limit(most_sent + 1).count() <= most_sent:
        listed = F.broadcast(named.agg(F.collect_set("_word").alias("_firsts")))
        # of a page's words only those that begin a needle make a row
        met = rows.crossJoin(listed).select("page_id", "text", F.explode(F.array_intersect(words, "_firsts")).alias("_word")).join(F.broadcast(named), "_word")
    else:
        rows = rows.withColumn("_digest", F.md5(F.coalesce("text", F.lit(""))))
        begun = rows.select(F.col("page_id").alias("_page"), F.col("_digest").alias("_key"), F.explode(F.array_distinct(words)).alias("_word")).join(named, "_word").select("_page", "_key", "needle").distinct()
        met = rows.join(begun, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_digest") == F.col("_key")))
    met = met.filter(F.contains(F.lower("text"), F.lower("needle")))
    return met.groupBy("page_id").agg(F.countDistinct("needle").alias("named")).orderBy(F.desc("named"), "page_id").limit(limit)


def outcome(status: Column, error: Column) -> Column:
    """ok, fatal, retry, or the class of an error text."""
    kind = reduce(lambda out, c: F.when(F.lower(error).rlike(c[1]), c[0]).otherwise(out), reversed(ERROR_CLASSES), F.lit("unknown"))
    return F.when(status.between(200, 299), "ok").when(status.isin(*FATAL_STATUSES), "fatal").when((status == 429) | (status >= 500), "retry").when(error.isNotNull(), kind).otherwise("unknown")


def politeness(fetches: DataFrame) -> DataFrame:
    """Per host: requests, bytes, errors, and whether it refused."""
    return fetches.groupBy("host").agg(
        F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.count_if(F.col("status") >= 400).alias("errors"), F.coalesce(F.bool_or(F.col("status").isin(401, 403, 429)), F.lit(False)).alias("blocked")
    )


def no_yield_reason(pages: DataFrame) -> DataFrame:
    """Why pages (provider, text) gave no records."""
    n = F.count("*")
    thin = F.count_if(F.length(F.coalesce("text", F.lit(""))) < 2000)
    every = lambda p: F.bool_and(F.col("provider") == p)
    reason = (
        F.when(n == 0, "no page was fetched").when(every("timeout"), "every extraction timed out").when(every("none"), "no model was available")
        .when(every("error"), "every extraction failed").otherwise("no matching records")
    )
    return pages.agg(reason.alias("reason"), n.alias("pages"), thin.alias("thin"))


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], terms: list[str], most_depth: int = 2, budget: int = 30, per_host: int = 8) -> DataFrame:
    """Breadth first over an injected ``fetch`` (urls to page_id, url, html): each round the best unseen links, capped by host and budget.

    The frontier of a round is at most ``budget`` rows.
    """
    from .pages import links

    frontier, done, depth = seeds.select("url").distinct(), None, 0
    while depth <= most_depth:
        got = fetch(frontier.limit(budget)).withColumn("depth", F.lit(depth)).cache()
        done = got if done is None else done.unionByName(got)
        left = budget - done.count()
        if left <= 0 or got.isEmpty():
            break
        found = children(links(got), terms).select(F.col("canonical").alias("url"), "score", F.col("host"))
        fresh = found.groupBy("url", "host").agg(F.max("score").alias("score")).join(done.select("url"), "url", "left_anti")
        place = Window.partitionBy("host").orderBy(F.desc("score"), "url")
        frontier = fresh.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= per_host).orderBy("_place", F.desc("score"), "url").limit(left).select("url")
        depth += 1
    return done
