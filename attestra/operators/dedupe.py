"""Entity resolution: identity signatures, exact and fuzzy merging with rivals kept, identity joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import arrow_function
from ..functions.texts import identity, indel_ratio, split_form
from ..session import checkpoint_folder

PREFIX, SUFFIX = 3, 4
#: Names of fields that carry identity.
IDENTITY_HINTS = (
    "name", "title", "company", "organization", "organisation",
    "entity", "person", "event", "product", "school",
    "hospital", "startup", "website", "url", "link",
)


def fallback_keys(fields: list[str]) -> list[str]:
    """Fields that look like identity, or all of them."""
    good = [f for f in fields if f.lower() in (*IDENTITY_HINTS, "id", "slug", "handle") or f.lower().endswith(("_name", "_title", "_url", "_website", "_link"))]
    return sorted(good) or sorted(fields)


def signature(keys: list[str]) -> Column:
    """The identity of a record from columns ``keys``; null if all are empty."""
    parts = [identity(F.col(k)) for k in keys]
    joined = F.concat_ws("|", *parts)
    return F.when(F.length(F.replace(joined, F.lit("|"), F.lit(""))) > 0, joined)


def with_signature(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("signature", signature(keys))


def exact(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each signature and how many it stands for; rows without identity never merge."""
    signed = with_signature(rows, keys)
    key = F.coalesce("signature", F.concat(F.lit("\x00"), F.col(ordinal).cast("string")))
    rest = [c for c in signed.columns]
    firsts = signed.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("row"), F.count("*").alias("merged"))
    return firsts.select(*[F.col("row")[c].alias(c) for c in rest], "merged")


def block_keys(signed: DataFrame) -> DataFrame:
    """One row for each blocking key of a signature: how its stems begin, and how the last one ends."""
    stems = F.transform(F.split("signature", r"\|"), lambda v: split_form(v))
    joined = F.array_join(F.transform(stems, lambda s: s["stem"]), "|")
    last = F.get(stems, F.size(stems) - 1)
    filled = F.filter(stems, lambda s: s["stem"] != "")
    tail = F.when((last["form"] != "") & (F.size(filled) > 0), F.get(filled, F.size(filled) - 1)["stem"]).otherwise(joined)
    rows = signed.filter("signature is not null").withColumns({"stems": stems, "joined": joined}).filter(F.length(F.replace(F.col("joined"), F.lit("|"), F.lit(""))) > 0)
    keys = F.array_distinct(F.array_compact(F.array(F.concat(F.lit("p"), F.left("joined", F.lit(PREFIX))), F.when(F.length(tail) > 1, F.concat(F.lit("s"), F.right(tail, F.lit(SUFFIX)))))))
    return rows.withColumn("block", F.explode(keys))


@arrow_function("double")
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The least ratio over the keys of two identities; 0 for missing stems, different forms or numbers of words."""

    def one(x: list, y: list) -> float:
        best = 100.0
        for p, q in zip(x, y, strict=True):
            s, t, f, g = p["stem"], q["stem"], p["form"], q["form"]
            if not s or not t or (f and g and f != g) or len(s.split()) != len(t.split()):
                return 0.0
            best = min(best, indel_ratio(s, t))
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], index=a.index, dtype=float)


def similar_pairs(rows: DataFrame, keys: list[str], ordinal: str, threshold: float = 88.0, most_in_block: int = 500) -> DataFrame:
    """Pairs (a < b by ordinal) that share a block and are alike; cheap tests precede the ratio.

    Rows of one signature are represented by the first of them, so copies make no pairs. In blocks of at most ``most_in_block`` rows all
    pairs are looked at. In larger ones two rows meet only on a segment: who is alike differs in at most t = (1 - threshold / 100) (m + n) letters, so
    of t + 1 segments of the shorter text one stands unchanged in the longer, little shifted. What share no segment there is never compared.
    """
    checkpoint_folder(rows.sparkSession)
    blocks = block_keys(exact(rows, keys, ordinal)).select(F.col(ordinal).alias("id"), "block", "stems", "joined").checkpoint()
    sizes = blocks.groupBy("block").agg(F.count("*").alias("size"))
    large = sizes.filter(F.col("size") > most_in_block)
    # sizes are summed in tasks first; there are at most as many large blocks as the rows hold bounds
    small = blocks.join(large, "block", "left_anti")
    met = small.select("block", F.col("id").alias("a")).join(small.select("block", F.col("id").alias("b")), "block").filter("a < b").select("a", "b")
    crowded = blocks.join(large.select("block"), "block", "left_semi").select("id", "block", "joined", F.length("joined").alias("m"))
    met = met.unionByName(_meeting_on_segments(crowded, 1 - threshold / 100)).distinct()
    once = blocks.groupBy("id").agg(F.first("stems").alias("stems"), F.first("joined").alias("joined"))
    side = lambda c: once.select(F.col("id").alias(c), F.col("stems").alias(f"stems_{c}"), F.col("joined").alias(f"joined_{c}"))
    pairs = met.join(side("a"), "a").join(side("b"), "b")
    m, n = F.length("joined_a"), F.length("joined_b")
    letters = lambda c: F.array_distinct(F.split(c, ""))
    pairs = pairs.filter(F.least(m, n) >= 0.55 * F.greatest(m, n)).filter(F.size(F.array_intersect(letters(F.col("joined_a")), letters(F.col("joined_b")))) >= 3)
    # replacing a letter counts once here and twice in the ratio, so this never discards a pair that is alike
    pairs = pairs.filter(F.levenshtein("joined_a", "joined_b") <= (1 - threshold / 100) * (m + n) + 1e-6)
    return pairs.withColumn("similarity", similarity("stems_a", "stems_b")).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


def _meeting_on_segments(rows: DataFrame, share: float) -> DataFrame:
    """(a, b) of rows (id, block, joined, m) of one block that have a segment of the shorter one in common.

    For the longest partner a text of n letters may differ from it in t = share (n + n (1 + share) / (1 - share)) letters; it is cut into t + 1 segments. If i of these
    come before the one that is unchanged, it is shifted by at most i letters, and what follows it by at most t - i (the multi-match-aware rule of pass-join).
    """
    reach = 2 * share / (1 - share)
    parts = lambda n: F.floor(n * F.lit(reach) + 1e-6).cast("int") + 1
    starts = lambda i, n: F.floor(i * n / parts(n)).cast("int")
    held = rows.withColumn("n", F.col("m")).withColumn("i", F.explode(F.sequence(F.lit(0), parts(F.col("n")) - 1)))
    held = held.withColumns({"at": starts(F.col("i"), F.col("n")), "end": starts(F.col("i") + 1, F.col("n"))})
    held = held.select(F.col("id").alias("b"), F.xxhash64("block", "n", "i", F.expr("substring(joined, at + 1, end - at)")).alias("key"))
    sought = rows.withColumn("n", F.explode(F.sequence(F.ceil(F.col("m") * F.lit((1 - share) / (1 + share)) - 1e-6).cast("int"), F.col("m"))))
    sought = sought.withColumn("i", F.explode(F.sequence(F.lit(0), parts(F.col("n")) - 1)))
    more, behind = F.col("m") - F.col("n"), parts(F.col("n")) - 1 - F.col("i")
    low, high = F.greatest(-F.col("i"), more - behind), F.least(F.col("i"), more + behind)
    sought = sought.filter(low <= high).withColumn("shift", F.explode(F.sequence(low, high)))
    sought = sought.withColumns({"at": starts(F.col("i"), F.col("n")) + F.col("shift"), "long": starts(F.col("i") + 1, F.col("n")) - starts(F.col("i"), F.col("n"))})
    sought = sought.filter((F.col("at") >= 0) & (F.col("at") + F.col("long") <= F.col("m")))
    sought = sought.select(F.col("id").alias("a"), F.xxhash64("block", "n", "i", F.expr("substring(joined, at + 1, long)")).alias("key")).distinct()
    return sought.join(held, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def leaders(rows: DataFrame, pairs: DataFrame, ordinal: str, rounds: int | None = None) -> DataFrame:
    """(ordinal, leader): each row joins the earliest leader it is alike, in order; leaders join none.

    A row whose earlier partners have all joined others leads itself. Rounds settle the rows whose partners are settled,
    until none waits; more than ``rounds`` of them, if given, or a partner that is no row raise an error.
    """
    checkpoint_folder(rows.sparkSession)
    nodes = rows.select(F.col(ordinal).alias("node"))
    first = pairs.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"))
    settled = nodes.join(first, "node", "left_anti").select("node", F.col("node").alias("leader"))
    waiting = first.select("node")
    left, done = waiting.count(), 0
    while left:
        if done == rounds:
            raise RuntimeError(f"{left} rows wait after {rounds} rounds")
        open_pairs = pairs.join(waiting, pairs["b"] == waiting["node"], "left_semi")
        known = open_pairs.join(settled.withColumnRenamed("node", "a"), "a", "left")
        # a partner that leads itself decides if no earlier partner is open
        state = known.groupBy("b").agg(
            F.min(F.when(F.col("leader") == F.col("a"), F.col("a"))).alias("lead"), F.min(F.when(F.col("leader").isNull(), F.col("a"))).alias("open")
        )
        ready = state.filter("open is null or lead < open").select(F.col("b").alias("node"), F.coalesce("lead", "b").alias("leader"))
        settled = settled.union(ready).checkpoint()
        waiting = waiting.join(settled, "node", "left_anti").checkpoint()
        before, left, done = left, waiting.count(), done + 1
        if left == before:
            raise RuntimeError(f"{left} rows have a partner that is no row")
    return settled


def merged_cells(cells: DataFrame, groups: DataFrame, ordinal: str) -> DataFrame:
    """Cells of each leader: the first filled value stays, later different ones make it conflicting and are kept as rivals."""
    rows = cells.join(groups.withColumnRenamed("node", ordinal), ordinal).filter(F.col("value").isNotNull() & (F.btrim("value") != ""))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ordinal), "value", "verification_status")))
    out = rows.groupBy("leader", "field").agg(ordered.alias("seen"))
    incumbent = F.col("seen")[0]
    rivals = F.array_distinct(F.transform(F.filter("seen", lambda x: x["value"] != incumbent["value"]), lambda x: x["value"]))
    status = F.when(F.size(rivals) > 0, "conflicting").otherwise(incumbent["verification_status"])
    return out.select("leader", "field", incumbent["value"].alias("value"), status.alias("verification_status"), F.array_join(rivals, "|").alias("rivals"))


def identity_join(extracted: DataFrame, stored: DataFrame, keys: list[str], stored_id: str) -> tuple[DataFrame, DataFrame]:
    """(extracted rows with the stored record of the same identity, those without one); the first stored record wins."""
    known = with_signature(stored, keys).filter("signature is not null").groupBy("signature").agg(F.min(stored_id).alias("matched_id"))
    fresh = with_signature(extracted, keys)
    return fresh.join(known, "signature"), fresh.join(known, "signature", "left_anti")


def duplicates_across(own: DataFrame, others: DataFrame, keys: list[str], most_examples: int = 3) -> DataFrame:
    """Per other dataset: how many of its records have an identity of ours, with examples."""
    if not keys:
        raise ValueError("identity keys are needed")
    mine = with_signature(own, keys).filter("signature is not null").select("signature").distinct()
    found = with_signature(others, keys).join(mine, "signature", "left_semi")
    place = Window.partitionBy("dataset_id").orderBy("record_id")
    rows = found.withColumn("place", F.row_number().over(place))
    return rows.groupBy("dataset_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= most_examples, F.col("record_id")))), ",").alias("examples"))


def merge_batches(batches: DataFrame, ordinal: str) -> DataFrame:
    """Records of overlapping chunks: equal fields and quotes, in any order, are one record; the first stays."""
    plain = lambda e: F.struct(F.lower(e["key"]).alias("name"), F.lower(F.btrim(e["value"])).alias("value"))
    fields = F.array_sort(F.transform(F.map_entries("fields"), plain))
    quotes = F.array_sort(F.transform("quotes", lambda q: F.lower(F.regexp_replace(F.btrim(q), r"\s+", " "))))
    rows = batches.withColumn("_key", F.struct(fields.alias("fields"), quotes.alias("quotes")))
    rest = [c for c in batches.columns]
    return rows.groupBy("_key").agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("row")).select(*[F.col("row")[c].alias(c) for c in rest])


def request_fingerprint(method: Column, url: Column, body: Column) -> Column:
    """The digest under which a request is known: sorted keys, Python's separators."""
    escaped = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    hexed = F.lower(F.hex(F.coalesce(body, F.lit(""))))
    return F.sha1(F.concat(F.lit('{"body": '), escaped(hexed), F.lit(', "headers": {}, "method": '), escaped(F.upper(method)), F.lit(', "url": '), escaped(url), F.lit("}")))


def refuse_semantic() -> None:
    raise NotImplementedError("semantic deduplication needs an explicit embedding provider and is refused")
