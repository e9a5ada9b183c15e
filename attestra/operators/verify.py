"""Verdicts on cells: what a quote proves, what each status may become."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import is_placeholder, type_accepts
from ..functions.texts import for_match, locate_quote, quote_occurs


def deterministic(value: Column, quote: Column, text: Column) -> Column:
    """NOT_SUPPORTED if the page lacks the quote, SUPPORTED if the quote holds the value, else null."""
    on_page = F.coalesce(quote_occurs(quote, text), F.lit(False))
    return F.when(~on_page, "NOT_SUPPORTED").when(F.contains(for_match(quote), F.rtrim(for_match(value))), "SUPPORTED")


def verify(cells: DataFrame, kind: str = "string", judge: Callable[[Column, Column, Column], Column] | None = None, budget: int | None = None) -> DataFrame:
    """``value`` and ``verification_status`` after the ladder over (value, quote, text, reference_id, references).

    Placeholders and values of the wrong type go; without a quote a value is unverified; a quote that the page
    lacks takes the value with it, and so does an unknown reference; what the quote does not decide goes to
    ``judge`` (a column of verdicts), for the first ``budget`` cells by record and field, which name a cell.
    """
    value, quote = F.col("value"), F.col("quote")
    verdict = deterministic(value, quote, F.col("text"))
    known = (F.coalesce("reference_id", F.lit("")) == "") | (F.coalesce("references", F.lit("")) == "") | F.contains(F.col("references"), F.col("reference_id"))
    rows = cells.withColumn("_verdict", verdict)
    open_ = F.col("_verdict").isNull()
    if budget is None:
        rows = rows.withColumn("_asked", open_)
    else:
        # the first of all cells are the first of each task's first; they are as many as the budget says
        first = rows.filter(open_).select("record_id", "field").orderBy("record_id", "field").limit(budget).distinct().withColumn("_asked", F.lit(True))
        rows = rows.join(first, ["record_id", "field"], "left").withColumn("_asked", open_ & F.coalesce("_asked", F.lit(False)))
    judged = judge(value, quote, F.col("text")) if judge else F.lit(None).cast("string")
    rows = rows.withColumn("_judged", F.when(F.col("_asked"), judged))
    gone = is_placeholder(value) | ~type_accepts(value, kind)
    absent = (F.coalesce(quote, F.lit("")) != "") & (F.col("_verdict") == "NOT_SUPPORTED")
    status = (
        F.when(gone, "unverified").when(F.coalesce(quote, F.lit("")) == "", "unverified").when(F.coalesce(absent, F.lit(False)) | ~known, "unverified")
        .when(F.col("_verdict") == "SUPPORTED", "verified").when(F.col("_judged") == "SUPPORTED", "verified").when(F.col("_judged").isNotNull(), "unverified")
        .otherwise("judgment_unavailable")
    )
    kept = F.when(gone | F.coalesce(absent, F.lit(False)) | ((F.coalesce(quote, F.lit("")) != "") & ~known), None).otherwise(value)
    return rows.withColumn("verification_status", status).withColumn("value", kept).drop("_verdict", "_judged", "_asked").select(*cells.columns, *[c for c in ("value", "verification_status") if c not in cells.columns])


def settle(cells: DataFrame) -> DataFrame:
    """The only way to ``verified``: the quote must stand on the page; its original slice and offsets are stored, else the cell is demoted."""
    rows = cells.withColumn("_at", locate_quote("quote", "text"))
    found = F.col("_at.start").isNotNull()
    claimed = F.col("verification_status") == "verified"
    return rows.withColumns({
        "start": F.col("_at.start"), "end": F.col("_at.end"),
        "quote": F.when(found, F.expr("substring(text, _at.start + 1, _at.end - _at.start)")).otherwise(F.col("quote")),
        "not_verified_because": F.when(claimed & ~found, "no locator"),
        "verification_status": F.when(claimed & ~found, "unverified").otherwise(F.col("verification_status")),
    }).drop("_at")


def refresh_decision(old_value: Column, new_value: Column, new_status: Column) -> Column:
    """What a second reading of a cell means, the first that holds."""
    same = for_match(old_value).eqNullSafe(for_match(new_value))
    return (
        F.when(F.coalesce(new_status, F.lit("")) != "verified", "unverifiable").when(is_placeholder(new_value), "empty").when(same, "unchanged").otherwise("changed")
    )


def adjudicate(cells: DataFrame) -> DataFrame:
    """Conflicts after a verdict on the first rival: B adopts it, INSUFFICIENT empties the cell, else the incumbent stays."""
    took = F.col("verdict") == "B"
    return cells.withColumns({
        "value": F.when(took, F.col("rival")).when(F.col("verdict") == "INSUFFICIENT", None).otherwise(F.col("value")),
        "resolved": F.when(took, "adopted").when(F.col("verdict") == "INSUFFICIENT", "withdrawn").otherwise("kept"),
    })


def resolve(cells: DataFrame, choices: DataFrame) -> DataFrame:
    """Human choices (record_id, field, choice keep or adopt, rival_index) applied; statuses are not upgraded; unknown choices are errors."""
    both = cells.join(choices, ["record_id", "field"])
    rival = F.get("rivals", F.col("rival_index"))
    valid = (F.col("choice") == "keep") | ((F.col("choice") == "adopt") & rival.isNotNull())
    return both.withColumns({
        "error": F.when(~valid, "no such choice"), "value": F.when(valid & (F.col("choice") == "adopt"), rival).otherwise(F.col("value")),
        "verification_status": F.when(valid, "unverified").otherwise(F.col("verification_status")),
    })


def rejudge(cells: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cells without a judgment after one: supported ones are settled, refuted ones unverified with their value kept, others unchanged."""
    rows = cells.join(verdicts, ["record_id", "field"], "left")
    waiting = F.col("verification_status") == "judgment_unavailable"
    new = F.when(waiting & (F.col("verdict") == "SUPPORTED"), "verified").when(waiting & (F.col("verdict") == "NOT_SUPPORTED"), "unverified").otherwise(F.col("verification_status"))
    return rows.withColumn("verification_status", new).drop("verdict")


def consensus(answers: DataFrame, most: int | None = 400) -> DataFrame:
    """Per question: clusters of equal answers, the share of the largest and what it is called. ``most`` characters are compared, all without it."""
    shown = F.col("answer") if most is None else F.left("answer", F.lit(most))
    key = F.lower(F.regexp_replace(F.btrim(shown), r"\s+", " "))
    groups = answers.groupBy("question", key.alias("cluster")).agg(F.count("*").alias("n"))
    out = groups.groupBy("question").agg(F.count("*").alias("clusters"), F.sum("n").alias("models"), F.max("n").alias("largest"))
    share = F.col("largest") / F.col("models")
    label = F.when(F.col("models") == 1, "single-model").when(F.col("clusters") == 1, "unanimous").when(share >= 0.6, "majority").when(share >= 0.4, "split").otherwise("polarised")
    return out.withColumn("ratio", F.round(share, 3)).withColumn("label", label)


def quote_matches(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, page_id) of every page that holds a quote, without comparing each quote with each page.

    A quote may begin and end within words, so a quote of three words or more and a page meet on the digest of up to eight whole words after the quote's first;
    then the whole quote is looked for. Shorter ones have no whole word: the distinct ones, all of which are bounded in length by two words, meet the pages on three
    letters that both hold (one or two letters: on those). Null quotes and those without letters are on no page.
    """
    words = lambda c: F.split(F.btrim(for_match(c)), " ")
    said = quotes.filter(F.col("quote").isNotNull() & (F.btrim(for_match(F.col("quote"))) != "")).select("quote_id", "quote").withColumn("_words", words(F.col("quote")))
    q = said.filter(F.size("_words") >= 3).withColumn("_n", F.least(F.size("_words") - 2, F.lit(8)))
    q = q.withColumn("_key", F.xxhash64(F.array_join(F.slice("_words", F.lit(2), F.col("_n")), " ")))
    sizes = sorted(r[0] for r in q.select("_n").distinct().collect())  # eight at most
    starts = lambda n: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_words") - n + 1))
    digest = lambda n: lambda i: F.xxhash64(F.array_join(F.slice("_words", i, F.lit(n)), " "))
    grams = [F.transform(starts(n), digest(n)) for n in sizes] or [F.array().cast("array<long>")]
    # only keys and ids are exploded; the texts of the pages that meet a quote are joined again
    p = pages.withColumn("_words", words(F.col("text"))).select("page_id", F.explode(F.array_distinct(F.concat(*grams))).alias("_key"))
    met = q.select("quote_id", "quote", "_key").join(p, "_key").select("quote_id", "quote", "page_id").distinct()
    short = said.filter(F.size("_words") < 3).withColumn("_plain", F.rtrim(for_match(F.col("quote"))))
    if not short.isEmpty():
        letters = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1))), lambda i: F.xxhash64(F.substr(c, i, F.lit(n))))
        plain = F.concat(F.lit(" "), for_match(F.col("text")))
        held = pages.withColumn("_plain", plain).select("page_id", F.explode(F.array_distinct(F.concat(*[letters(F.col("_plain"), n) for n in (1, 2, 3)]))).alias("_key"))
        # the letters in the middle are likelier to be rare than those at the edges
        at = F.greatest(F.lit(1), F.floor(F.length("_plain") / 2).cast("int"))
        key = F.xxhash64(F.substr(F.col("_plain"), F.least(at, F.greatest(F.lit(1), F.length("_plain") - 2)), F.lit(3)))
        met = met.unionByName(short.withColumn("_key", key).join(held, "_key").select("quote_id", "quote", "page_id").distinct())
    held = met.join(pages.select("page_id", "text"), "page_id").filter(quote_occurs(F.col("quote"), F.col("text")))
    return held.select("quote_id", "page_id").distinct()
