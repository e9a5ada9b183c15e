"""Pages to records: evidence text, links, rungs in order, crawl trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.texts import stem
from ..functions.urls import canonical_url, host_of, site_host, site_key
from ..session import checkpoint_folder

REDUCER_VERSION = 1
#: Patterns of the regex rung.
FIELD_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9][0-9 ().-]{6,}[0-9]",
    "price": r"[$€£]\s?[0-9][0-9,]*(?:\.[0-9]+)?",
    "url": r"https?://[^\s\"'<>)]+",
}


def evidence_text(pages: DataFrame, most: int = 30000) -> DataFrame:
    """Pages with the text that offsets refer to: stored markdown first, then the visible text of the HTML."""
    text = F.coalesce(F.when(F.btrim("markdown") != "", F.col("markdown")), H.page_text("html")) if "markdown" in pages.columns else H.page_text("html")
    return pages.withColumn("text", F.left(text, F.lit(most))).withColumn("reducer_version", F.lit(REDUCER_VERSION))


def stale_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(~F.col("reducer_version").eqNullSafe(F.lit(REDUCER_VERSION)))


def links(pages: DataFrame, limit: int | None = 200, longest: int | None = 2000) -> DataFrame:
    """page_id, position, url, host, anchor, canonical of each link; None for no limit of their number or length."""
    return pages.select("page_id", F.explode(H.page_links("html", "url", limit, longest)).alias("l")).select("page_id", "l.*", canonical_url(F.col("l.url")).alias("canonical"))


def hrefs(pages: DataFrame) -> DataFrame:
    """page_id, position, href of anchors as written, by a pattern alone."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("position", "href"))


def same_site(found: DataFrame, pages: DataFrame) -> DataFrame:
    base = pages.select("page_id", site_host(host_of(F.col("url"))).alias("site"))
    inside = (F.col("link_site") == F.col("site")) | F.col("link_site").endswith(F.concat(F.lit("."), F.col("site")))
    return found.withColumn("link_site", site_host(F.col("host"))).join(base, "page_id").filter(inside).drop("site", "link_site")


def collapse_variants(urls: DataFrame, order: str) -> DataFrame:
    """One URL for each document of a site, the canonical host's if there is one, at the place of the first."""
    from ..functions.urls import authority_host, is_locale_host

    rows = urls.withColumn("site_key", site_key(F.col("url")))
    best = F.min(F.struct(is_locale_host(authority_host(F.col("url"))).alias("locale"), F.col(order), F.col("url")))
    return rows.groupBy("site_key").agg(F.min(order).alias(order), best.alias("best")).select(order, F.col("best.url").alias("url"))


def regex_fields(pages: DataFrame, kinds: list[str]) -> DataFrame:
    """The first match of each pattern in a page's text; null without one."""
    found = {k: F.nullif(F.regexp_extract("text", FIELD_PATTERNS[k], 0), F.lit("")) for k in kinds}
    return pages.select("page_id", *[c.alias(k) for k, c in found.items()])


def ladder(rungs: list[DataFrame]) -> DataFrame:
    """(page_id, field, value, rung) of several rungs in order: the first that fills a field keeps it."""
    ranked = [r.withColumn("_rank", F.lit(i)) for i, r in enumerate(rungs)]
    rows = reduce(DataFrame.unionByName, ranked).filter(F.col("value").isNotNull() & (F.btrim("value") != ""))
    return rows.groupBy("page_id", "field").agg(F.min_by(F.struct("value", "rung"), F.col("_rank")).alias("x")).select("page_id", "field", "x.*")


def ladder_summary(filled: DataFrame) -> DataFrame:
    return filled.groupBy("rung").agg(F.count("*").alias("fills"))


def relevant(pages: DataFrame, subject: list[str], entity: list[str]) -> DataFrame:
    """Pages with ``keep`` and ``matched``: an entity term in the address or the beginning, else a subject term anywhere."""
    fold = lambda words: F.array_distinct(F.transform(words, stem))
    body = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    head = F.regexp_extract_all(F.lower(F.left(F.coalesce("text", F.lit("")), F.lit(1500))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    slug = F.regexp_extract_all(F.lower("url"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    terms = lambda ws: fold(F.array(*map(F.lit, ws))) if ws else F.array().cast("array<string>")
    wanted = terms(entity) if entity else terms(subject)
    matched = F.array_intersect(wanted, fold(F.concat(slug, head if entity else body)))
    keep = (F.size(matched) > 0) | (F.size(wanted) == 0) | (F.btrim(F.coalesce("text", F.lit(""))) == "")
    return pages.withColumn("matched", F.array_join(F.array_sort(matched), ",")).withColumn("keep", keep)


def tripwire(text: Column, expected: list[str]) -> Column:
    """struct(matched, missing): which expected terms a text holds."""
    terms = F.array(*[F.lit(t.lower()) for t in expected])
    held = lambda t: F.contains(F.lower(text), t)
    return F.struct(F.array_join(F.filter(terms, held), ",").alias("matched"), F.array_join(F.filter(terms, lambda t: ~held(t)), ",").alias("missing"))


def crawl_tree(pages: DataFrame, most_depth: int | None = 10) -> DataFrame:
    """(url, root, depth) of every page below a page without parent, at most ``most_depth`` below it if given, by pointer jumping.

    Each round doubles the distance that a page sees, until all see a root or as far as is asked. Pages below an unknown parent and pages in a circle have no root and are left
    out; a circle is known by a distance that the number of pages does not allow.
    """
    checkpoint_folder(pages.sparkSession)
    parent, depth = F.col("parent_url"), F.col("depth")
    seen, reach = pages.select("url", F.coalesce(parent, "url").alias("root"), parent.isNotNull().cast("long").alias("depth")), 1
    roots = pages.filter(parent.isNull()).select(F.col("url").alias("root")).distinct().checkpoint()
    most = pages.count() if most_depth is None else most_depth
    while reach < most and not seen.join(roots, "root", "left_anti").isEmpty():
        up = seen.select(F.col("url").alias("root"), F.col("root").alias("_next"), depth.alias("_more"))
        seen = seen.join(up, "root").select("url", F.col("_next").alias("root"), (depth + F.col("_more")).alias("depth")).filter(depth <= most).checkpoint()
        reach *= 2
    return seen.filter(depth <= most).join(roots, "root", "left_semi").select("url", "root", depth.cast("int").alias("depth"))


def looks_like_shell(html: Column, text: Column, least: int = 200) -> Column:
    """Pages that scripts fill in: little text, or a large document with hardly any."""
    return ((F.length(text) < least) & F.contains(F.lower(html), F.lit("<script"))) | ((F.length(html) > 20000) & (F.length(text) < 0.05 * F.length(html)))


def fetch_outcome(pages: DataFrame) -> DataFrame:
    """Crawl counts by status and cause."""
    return pages.groupBy("status").agg(F.count("*").alias("pages"), F.count_if(F.col("error_code").isNotNull()).alias("with_cause"))


def source_events(fetches: DataFrame) -> DataFrame:
    """An event for each fetch (url, status ok, failed or skipped, reason, error_code, fallback_used), those that failed among them.

    What a fallback served is kept but degraded: it is not what was asked for.
    """
    back = F.coalesce("fallback_used", F.lit(False))
    status = F.when(back, "degraded").otherwise(F.coalesce("status", F.lit("failed")))
    good = status == "ok"
    label = F.when(good, "Fetched").when(status == "degraded", "Degraded").when(status == "skipped", "Skipped").otherwise("Failed")
    reason = F.coalesce("reason", F.lit(""))
    head = F.concat(label, F.lit(" "), F.left(F.coalesce("url", F.lit("")), F.lit(80)))
    message = F.when(good, head).otherwise(F.concat(head, F.lit(": "), F.left(reason, F.lit(120))))
    return fetches.select(
        "url", F.when(good, "source.fetched").otherwise("source.failed").alias("type"), message.alias("message"), good.alias("ok"), status.alias("status"),
        F.when(good, "").otherwise(F.left(reason, F.lit(300))).alias("reason"), F.coalesce("error_code", F.lit("")).alias("error_code"),
    )
