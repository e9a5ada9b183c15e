"""Host trust, yield bonus and the receipt of a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import decay

#: How far each way of reading is believed.
METHOD_PRIOR = {
    "api": 0.99,
    "json_ld": 0.95,
    "dom": 0.92,
    "labelled": 0.90,
    "derived": 0.85,
    "regex": 0.80,
    "llm": 0.75,
    "search": 0.70,
}
SURE, LIKELY = 0.90, 0.75
#: Of the trust score.
BLOCK_PENALTY, MOST_PENALTY, NEUTRAL, FEW_VISITS = 0.10, 0.5, 0.25, 3


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), part / whole))).otherwise(0.0)


def trust(visits: Column, successes: Column, cells: Column, verified: Column, blocks: Column, last: Column, now: Column) -> Column:
    """Between 0 and 1 from a host's counters: decayed proof, reachability, less what blocks cost; few visits pull to the middle."""
    fresh = decay(last, now)
    proof, reach = _ratio(verified, cells) * fresh, _ratio(successes, visits) * (0.5 + 0.5 * fresh)
    score = 0.7 * proof + 0.3 * reach - F.least(F.lit(MOST_PENALTY), blocks * BLOCK_PENALTY)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    score = F.when(visits < FEW_VISITS, 0.5 * score + 0.5 * NEUTRAL).otherwise(score)
    return F.when(visits > 0, F.round(score, 4)).otherwise(0.0)


def yield_bonus(verified_share: Column) -> Column:
    """What a proven host adds to a candidate's rank: saturating, 3 at most."""
    return F.round(F.least(F.lit(3.0), 3.0 * verified_share / (verified_share + 2.0)), 3)


def method(raw: Column) -> Column:
    plain = F.lower(F.btrim(F.coalesce(raw, F.lit(""))))
    return F.when(plain.isin(*METHOD_PRIOR), plain).when(plain == "", "llm").otherwise("search")


def confidence(raw_method: Column, verified: Column) -> Column:
    prior = F.lit(METHOD_PRIOR["search"])
    for name, value in METHOD_PRIOR.items():
        prior = F.when(method(raw_method) == name, value).otherwise(prior)
    return F.when(verified, prior).otherwise(0.0)


def certainty(score: Column) -> Column:
    return F.when(score >= SURE, "sure").when(score >= LIKELY, "likely").otherwise("check")


def receipt(raw_method: Column, verified: Column) -> Column:
    score = confidence(raw_method, verified)
    return F.struct(method(raw_method).alias("read_method"), score.alias("confidence"), certainty(score).alias("certainty"))
