"""Personal data found by weak supervision (DataFrame operations only).

Candidates come from four strict patterns and one for assigned secrets. Five labelers vote +1, 0 or -1
on each: the pattern's own rule, a checksum or range check, a gazetteer of words that precede such
data, the characters around the span, and a gazetteer of known beginnings or endings. Expectation
maximisation estimates from the counts of vote patterns how reliable each labeler is in each class;
its posteriors train a logistic span classifier. Candidates that obey a strict rule are always kept;
the classifier decides about the others (mistyped cards, addresses out of range, secrets).

The text is read once; candidates go to a small table. What reaches the driver is one count for each
pattern of kind, votes and length class, at most 5 * 3**5 * 4 rows.

Defined results: null text is empty and has no spans; repeated rows give equal rows; an empty table gives
no rows; other columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import flag_blank, materialize

#: The patterns of the four kinds, in their order. They match what the plain forms match;
#: possessive quantifiers and starts at a run's beginning keep them linear on very long texts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?:token|password|passwd|secret|api_key|apikey)\x20?[=:]\x20?\"?[A-Za-z0-9]{12,}+",
}
KINDS = list(PATTERNS)
BASE = KINDS[:4]
#: Which texts can hold a kind at all.
MAY = {"email": "[@]", "ip": "[0-9][.][0-9]", "card": "[0-9][0-9 -][0-9]", "phone": "[+][0-9]", "secret": "[=:]"}
#: Words that announce a kind.
BEFORE = {
    "email": "mail|contact|write|from|to",
    "ip": "ip|host|server|address|from",
    "card": "card|visa|credit|pay|account",
    "phone": "tel|phone|call|mobile|fax|contact",
    "secret": "key|login|user|auth|credential",
}
#: Words that announce something else.
NOT_BEFORE = "version|isbn|order|page|section|figure|total|price"
#: How known values of a kind begin or end.
KNOWN = {
    "email": r"\.(com|org|net|edu|gov|io|de|fr|es|uk|info)$",
    "ip": r"^(?!0|127\.|255\.)[0-9]{1,3}\.",
    "card": r"^[3-6]",
    "phone": r"^\+[1-9]",
    "secret": r"[0-9].*[a-f]|[a-f].*[0-9]",
}
SPAN = "array<struct<s:int,rank:int,kind:string,e:int,base:boolean,v1:int,v2:int,v3:int,v4:int,v5:int,size:int>>"
#: Hits of a kind that are walked at a time.
STRETCH = 256
VOTES = ("v1", "v2", "v3", "v4", "v5")


def _hits(text: Column, kind: str) -> tuple[Column, Column]:
    """(what lies between the matches, the matches); no matches where the text cannot hold any."""
    may = text.rlike(MAY[kind])
    none = F.expr("cast(array() as array<string>)")
    pattern = F.lit(PATTERNS[kind])
    return F.when(may, F.split(text, PATTERNS[kind], -1)).otherwise(none), F.when(may, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none)


def _valid(kind: str, t: Column) -> Column:
    digits = F.regexp_replace(t, "[^0-9]", "")
    if kind == "ip":
        short = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(t, "[.]"), lambda x: (F.length(short(x)) <= 3) & (F.lpad(short(x), 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True) if kind == "email" else F.lit(False)


def _check(kind: str, t: Column) -> Column:
    """The second labeler: what a checksum or a range says without the whole rule."""
    digits = F.regexp_replace(t, "[^0-9]", "")
    if kind == "card":
        return F.when(F.call_function("luhn_check", digits), 1).otherwise(-1)
    if kind == "secret":
        return F.when(F.length(t) >= 24, 1).otherwise(-1)
    return F.when(_valid(kind, t), 1).otherwise(-1)


def _spans(kind: str) -> Column:
    """The candidates of one kind from columns ``gaps`` and ``hits``.

    A running offset over all hits would copy the spans found so far at every hit. So hits are taken in
    stretches of 256: each stretch's length, then where stretches start, then the hits within each.
    """
    n = F.size("hits")
    long = F.zip_with(F.slice("gaps", F.lit(1), n), "hits", lambda gap, hit: F.length(gap) + F.length(hit))
    stretches = F.sequence(F.lit(0), F.floor((n - 1) / STRETCH).cast("int"))

    def step(acc: Column, i: Column) -> Column:
        gap, hit = F.col("gaps")[i], F.col("hits")[i]
        start = acc["at"] + F.length(gap)
        end = start + F.length(hit)
        left, right = F.lower(F.substring(gap, -24, 24)), F.substring(F.col("gaps")[i + 1], 1, 1)
        valid = _valid(kind, hit)
        announced = F.when(left.rlike(f"(^|[^a-z])({BEFORE[kind]})[^a-z]{{0,4}}$"), 1).when(left.rlike(f"(^|[^a-z])({NOT_BEFORE})[^a-z]{{0,4}}$"), -1).otherwise(0)
        apart = F.when(~left.rlike(r"[\p{L}\p{N}_]$") & ~right.rlike(r"[\p{L}\p{N}_]"), 1).otherwise(-1)
        known = F.when(hit.rlike(KNOWN[kind]), 1).otherwise(-1)
        size = F.least(F.lit(3), F.floor(F.length(hit) / 12)).cast("int")
        span = F.struct(
            start.alias("s"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("e"), valid.alias("base"),
            F.when(valid, 1).when(F.lit(kind == "secret"), 0).otherwise(-1).alias("v1"), _check(kind, hit).alias("v2"), announced.alias("v3"),
            apart.alias("v4"), known.alias("v5"), size.alias("size"),
        )
        return F.struct(end.alias("at"), F.array_append(acc["out"], span.cast(SPAN[6:-1])).alias("out"))

    none = F.expr(f"cast(array() as {SPAN})")
    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))

    def within(starts: Column) -> Callable[[Column], Column]:
        return lambda k: F.aggregate(
            F.sequence(k * STRETCH, F.least(n, (k + 1) * STRETCH) - 1), F.struct(starts[k].alias("at"), none.alias("out")), step, lambda acc: acc["out"]
        )

    def walked(long: Column) -> Column:
        sums = F.transform(stretches, lambda k: F.aggregate(F.slice(long, k * STRETCH + 1, F.lit(STRETCH)), F.lit(0), lambda x, y: x + y))
        starts = F.aggregate(sums, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")), lambda acc: acc["starts"])
        return _let(starts, lambda t: F.flatten(F.transform(stretches, within(t))))

    return F.when(n > 0, _let(long, walked)).otherwise(none)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a column of its own would be put into the lambda again by the optimiser."""
    return F.transform(F.array(value), body)[0]


def _below(ordered: Column, value: Column) -> Column:
    """How many of the ordered numbers are below a value, by halving."""
    halvings = F.sequence(F.lit(0), F.floor(F.log2(F.size(ordered) + 1)).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        low, high = acc["low"], acc["high"]
        middle = F.floor((low + high) / 2).cast("int")
        right = (low < high) & (F.get(ordered, middle) < value)
        return F.struct(F.when(right, middle + 1).otherwise(low).alias("low"), F.when(right | (low >= high), high).otherwise(middle).alias("high"))

    return F.aggregate(halvings, F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high")), halve, lambda acc: acc["low"])


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id and ``found``: every candidate with its votes. Candidates that break a strict rule stay if they are plausible and apart from strict ones."""
    rows = documents.select("doc_id", flag_blank(F.col("text")).alias("text"))
    for kind in KINDS:
        gaps, hits = _hits(F.col("text"), kind)
        rows = rows.withColumns({f"gaps_{kind}": gaps, f"hits_{kind}": hits})
    rows = rows.drop("text")
    for kind in KINDS:
        spans = _spans(kind)
        rows = rows.withColumns({"gaps": F.col(f"gaps_{kind}"), "hits": F.col(f"hits_{kind}")}).withColumn(f"spans_{kind}", spans).drop("gaps", "hits", f"gaps_{kind}", f"hits_{kind}")
    rows = rows.select("doc_id", F.concat(*[f"spans_{k}" for k in KINDS]).alias("spans"))
    strict = F.filter("spans", lambda x: x["base"])
    loose = F.filter("spans", lambda x: ~x["base"] & ((x["e"] - x["s"] >= 9) | (x["kind"] == "ip")))
    rows = rows.select("doc_id", strict.alias("strict"), loose.alias("loose"))
    edges = F.struct(F.sort_array(F.col("strict")["s"]).alias("s"), F.sort_array(F.col("strict")["e"]).alias("e"))
    # no strict span meets x if as many end before it as start before its end
    apart = _let(edges, lambda t: F.filter("loose", lambda x: _below(t["s"], x["e"]) == _below(t["e"], x["s"] + 1)))
    return rows.select("doc_id", F.concat("strict", apart).alias("found"))


def estimate(counts: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each vote pattern, P(vote | class) by labeler, prior) by expectation maximisation."""
    votes = np.array([v for v, _ in counts], int) + 1
    weight = np.array([n for _, n in counts], float)
    # labelers are better than chance to begin with
    post = np.clip(0.5 + 0.12 * (votes - 1).sum(1), 0.05, 0.95)
    tables = np.zeros((votes.shape[1], 2, 3))
    prior = 0.5
    for _ in range(rounds):
        for c, share in enumerate((1 - post, post)):
            for j in range(votes.shape[1]):
                seen = np.bincount(votes[:, j], weight * share, 3) + 1
                tables[j, c] = seen / seen.sum()
        prior = float(np.clip((weight * post).sum() / weight.sum(), 0.01, 0.99))
        logs = [np.log(p) + sum(np.log(tables[j, c, votes[:, j]]) for j in range(votes.shape[1])) for c, p in enumerate((1 - prior, prior))]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return post, tables, prior


def fit(counts: list[tuple[str, int, tuple[int, ...], float]], steps: int = 300) -> dict[tuple[str, object], float]:
    """Weights of the span classifier by (column, value): a logistic regression on the posteriors of ``estimate``."""
    if not counts:
        return {}
    post, _, _ = estimate([(v, n) for _, _, v, n in counts])
    keys = [[("kind", k), ("size", s), *((c, x) for c, x in zip(VOTES, v, strict=True))] for k, s, v, _ in counts]
    names = sorted({k for row in keys for k in row}, key=str)
    at = {k: i for i, k in enumerate(names)}
    x = np.zeros((len(keys), len(names)))
    for i, row in enumerate(keys):
        x[i, [at[k] for k in row]] = 1
    n = np.array([c[3] for c in counts], float)
    n /= n.sum()
    w = np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.lstsq((x.T * (n * p * (1 - p) + 1e-6)) @ x + 1e-3 * np.eye(len(w)), x.T @ (n * (p - post)) + 1e-3 * w, rcond=None)[0]
    return {k: float(w[i]) for k, i in at.items()}


def _margin(x: Column, weights: dict[tuple[str, object], float]) -> Column:
    total = F.lit(0.0)
    for column in ("kind", "size", *VOTES):
        own = [(v, w) for (c, v), w in weights.items() if c == column]
        part = F.lit(0.0)
        for v, w in own:
            part = F.when(x[column] == v, w).otherwise(part)
        total = total + part
    return total


def find(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans."""
    found = materialize(candidates(documents), "candidates")
    each = found.select(F.explode("found").alias("x"))
    counted = each.groupBy("x.kind", "x.size", *[F.col(f"x.{v}").alias(v) for v in VOTES]).count().collect()
    weights = fit(sorted((r["kind"], r["size"], tuple(r[v] for v in VOTES), r["count"]) for r in counted))
    kept = F.array_sort(F.filter("found", lambda x: x["base"] | (_margin(x, weights) >= 0)))
    rows = found.select("doc_id", kept.alias("kept"))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    base = F.filter("kept", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("kept", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("kept")).alias("spans"),
        F.size(F.filter("kept", lambda x: ~x["base"])).cast("long").alias("n_added"), F.size("kept").cast("long").alias("n_spans"),
    )
