"""Mixing sources to target weights by temperature (DataFrame operations only).

The token share of each source is raised to an exponent between 0 (uniform) and 1 (as found) and
normalised. The exponent is bisected: among those that keep every source at or below ``most_repeats``
passes the smallest is taken, or, with ``target_entropy``, the one that meets this entropy within the
repetition limit. Each round evaluates many exponents in one aggregation over the sources, so a round
narrows the interval by that factor; sources never have to fit on the driver.

The weights are realised as budgeted block permutations: every source is shuffled by a seeded hash, cut
into blocks, the blocks are permuted anew in each pass, and passes repeat until the source's share of the
budget is used up. Positions are prefix sums over blocks and within a block, so a source that holds
a third of all rows is spread over all tasks. The default budget is the smallest in which every source
gets at least one whole pass: no document is lost.

Tokens are counted as words. Defined results: null text is empty and, like any text without words, counts
one token so that it keeps a place; null sources form a source of their own; repeated rows are separate
documents; an empty table gives no rows; extra columns pass through in ``mixed_rows``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import flag_blank, materialize, unused

#: Rows of a block on average.
BLOCK = 4096
#: Exponents tried in one round of the bisection.
GRID = 32


def tokens(text: Column) -> Column:
    """Words of a text, at least 1, counted by the gaps that end them."""
    padded = F.concat(flag_blank(text), F.lit(" "))
    return F.greatest(F.lit(1), F.regexp_count(padded, F.lit(r"[^ \t\n\x0B\f\r][ \t\n\x0B\f\r]"))).cast("long")


def source_totals(sized: DataFrame) -> DataFrame:
    """source, n_tokens, n_docs of rows with columns source and n_tokens."""
    return sized.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))


def _curve(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest ratio of passes between sources) for each exponent."""
    all_tokens = F.broadcast(totals.agg(F.sum("n_tokens").alias("all_tokens")))
    shares = totals.crossJoin(all_tokens).select((F.col("n_tokens") / F.col("all_tokens")).alias("p"))
    raised = shares.withColumn("x", F.explode(F.array(*map(F.lit, exponents)))).withColumn("w", F.pow("p", "x"))
    found = raised.groupBy("x").agg(
        F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") / F.col("p")).alias("most"), F.min(F.col("w") / F.col("p")).alias("least")
    )
    return sorted((r["x"], math.log(r["z"]) - r["wl"] / r["z"], r["most"] / r["least"]) for r in found.collect())


def exponent(totals: DataFrame, most_repeats: float, target_entropy: float | None = None, rounds: int = 5) -> float:
    """The smallest exponent in [0, 1] with at most ``most_repeats`` passes (and no more entropy than the target).

    With exponent 1 every source has one pass, so an answer exists if most_repeats >= 1.
    """
    low, high = 0.0, 1.0
    fits = lambda entropy, ratio: ratio <= most_repeats * (1 + 1e-12) and (target_entropy is None or entropy <= target_entropy)
    for _ in range(rounds):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        seen = _curve(totals, grid)
        good = next((i for i, (_, entropy, ratio) in enumerate(seen) if fits(entropy, ratio)), len(seen) - 1 if seen else 0)
        if not seen or good == 0:
            return low
        low, high = seen[good - 1][0], seen[good][0]
    return high


def mix(documents: DataFrame, most_repeats: float = 2.0, target_entropy: float | None = None, budget: float | None = None, seed: int = 17) -> DataFrame:
    """source, doc_id, n_tokens, pass, block, position (in tokens, within the source), weight of every row of the mixture.

    ``position`` is where a row starts in its source's stream; a row belongs to the mixture when it
    starts before the source's share of the budget.
    """
    sized = documents.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"))
    return realise(materialize(sized.withColumn("row_key", F.monotonically_increasing_id()), "sized"), most_repeats, target_entropy, budget, seed)


def realise(sized: DataFrame, most_repeats: float, target_entropy: float | None, budget: float | None, seed: int) -> DataFrame:
    totals = materialize(source_totals(sized), "totals")
    power = exponent(totals, most_repeats, target_entropy)
    all_tokens = totals.agg(F.sum("n_tokens")).first()[0] or 0
    raised = totals.withColumn("raised", F.pow(F.col("n_tokens") / F.lit(float(max(all_tokens, 1))), F.lit(power)))
    z = raised.agg(F.sum("raised")).first()[0] or 1.0
    weighted = raised.withColumn("weight", F.col("raised") / F.lit(z))
    if budget is None:
        budget = weighted.agg(F.max(F.col("n_tokens") / F.col("weight"))).first()[0] or 0.0
    quota = F.greatest(F.round(F.col("weight") * F.lit(float(budget))).cast("long"), F.lit(0))
    plan = weighted.select(
        "source", "weight", F.col("n_tokens").alias("source_tokens"), quota.alias("quota"),
        F.ceil(F.col("n_docs") / BLOCK).alias("n_blocks"),
    )
    plan = plan.withColumn("n_passes", F.ceil(F.col("quota") / F.col("source_tokens")).cast("long"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    # one row for each document and pass; the sources' plans are joined by a key salted evenly
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_key", F.lit(seed)), F.lit(256)))
    spread = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(255)).cast("array<long>")))
    rows = salted.join(spread, same(salted, spread) & (salted["salt"] == spread["salt"])).select(salted["*"], *[spread[c] for c in plan.columns if c != "source"])
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_passes") - 1))).filter("n_passes > 0")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "row_key", F.lit(seed), F.lit("block")), F.col("n_blocks")))
    rows = rows.withColumn("order", F.xxhash64("doc_id", "row_key", "pass", F.lit(seed)))

    # only the last pass can be cut by the quota; earlier ones are whole
    blocks = rows.groupBy("source", "block", "pass", "source_tokens").agg(F.sum("n_tokens").alias("block_tokens"))
    in_order = Window.partitionBy("source", "pass").orderBy(F.xxhash64("block", "pass", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("block_start", F.col("pass") * F.col("source_tokens") + F.coalesce(F.sum("block_tokens").over(in_order), F.lit(0)))
    starts = starts.select("source", "block", "pass", "block_start")
    within = Window.partitionBy("source", "block", "pass").orderBy("order", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    on = same(inside, starts) & (inside["block"] == starts["block"]) & (inside["pass"] == starts["pass"])
    placed = inside.join(starts, on).select(inside["*"], starts["block_start"]).withColumn("position", F.col("block_start") + F.col("ahead"))
    return placed.filter("position < quota").select("source", "doc_id", "row_key", "n_tokens", "pass", "block", "position", "weight")


def mixed_rows(documents: DataFrame, most_repeats: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixture as rows of ``documents``: every document at least once, those of small sources again."""
    key, times = unused("_row_key", documents.columns), unused("_times", documents.columns)
    keyed = materialize(documents.withColumn(key, F.monotonically_increasing_id()), "keyed")
    sized = keyed.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), F.col(key).alias("row_key"))
    chosen = realise(materialize(sized, "sized"), most_repeats, None, None, seed)
    counted = chosen.groupBy(F.col("row_key").alias(key)).agg(F.count("*").cast("int").alias(times))
    # the last column repeats a row as often as the mixture holds it
    return keyed.join(counted, key).select(*documents.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(key)).drop(key)
