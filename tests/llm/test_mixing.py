"""Mixing against a plain version: weights, quotas, and every source's stream as whole passes of permuted blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from attestra.llm import mixing

SIZES = {"web": 300, "books": 40, "code": 7, None: 15}


def plain_exponent(tokens, most_repeats, target=None):
    """The least exponent on a fine grid that keeps to the limit (and the entropy), by trying all."""
    total = sum(tokens.values())
    p = [n / total for n in tokens.values()]

    def fits(x):
        w = [q**x for q in p]
        z = sum(w)
        ratios = [(v / z) / q for v, q in zip(w, p, strict=True)]
        entropy = -sum(v / z * math.log(v / z) for v in w)
        return max(ratios) / min(ratios) <= most_repeats * (1 + 1e-12) and (target is None or entropy <= target)

    low, high = 0.0, 1.0
    if fits(0.0):
        return 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


@pytest.mark.parametrize("repeats,target,budget", [(2.0, None, None), (1.0, None, None), (50.0, 0.9, None), (4.0, None, 3000.0)])
def test_the_mixture_is_what_the_rule_says(spark, monkeypatch, repeats, target, budget):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(i, s, " ".join("w" for _ in range(rng.randint(1, 9)))) for i, s in enumerate(x for s, n in SIZES.items() for x in [s] * n)]
    rows += [(10**6, "web", None), (10**6, "web", None), (10**6 + 1, "code", "  ")]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    length = lambda t: max(1, len((t or "").split()))
    tokens, docs = {}, {}
    for i, s, t in rows:
        tokens[s] = tokens.get(s, 0) + length(t)
        docs.setdefault(s, []).append((i, length(t)))
    found = mixing.mix(table, repeats, target, budget)
    found = found.withColumn("block_order", F.xxhash64("block", "pass", F.lit(17))).withColumn("own_order", F.xxhash64("doc_id", "row_key", "pass", F.lit(17))).collect()
    x = plain_exponent(tokens, repeats, target)
    total = sum(tokens.values())
    raised = {s: (n / total) ** x for s, n in tokens.items()}
    weight = {s: r / sum(raised.values()) for s, r in raised.items()}
    spent = budget if budget is not None else max(tokens[s] / weight[s] for s in tokens)
    for s in SIZES:
        own = sorted((r for r in found if r.source == s), key=lambda r: r.position)
        assert all(r.weight == pytest.approx(weight[s], rel=1e-5) for r in own)
        quota = weight[s] * spent
        # one row after another, from the start until the quota is reached
        at = 0
        for r in own:
            assert r.position == at
            at += r.n_tokens
        assert at >= quota * (1 - 1e-4) - 1 and own[-1].position < quota * (1 + 1e-4) + 1
        passes = {}
        for r in own:
            passes.setdefault(r["pass"], []).append(r)
        for k, rows_of in passes.items():
            # a whole pass holds every row of the source once, a cut one the first of them
            if k < max(passes):
                assert sorted((r.doc_id, r.n_tokens) for r in rows_of) == sorted(docs[s])
            else:
                assert len({(r.doc_id, r.row_key) for r in rows_of}) == len(rows_of)
            # blocks stand whole, in the order of their hashes, and rows within a block in the order of theirs
            keys = [(r.block_order, r.block, r.own_order, r.doc_id, r.row_key) for r in rows_of]
            assert keys == sorted(keys)
    if len({r["pass"] for r in found if r.source == "code"}) > 1:
        first, second = ([r.doc_id for r in sorted(found, key=lambda r: r.position) if r.source == "code" and r["pass"] == k] for k in (0, 1))
        assert first[: len(second)] != second[: len(first)]
