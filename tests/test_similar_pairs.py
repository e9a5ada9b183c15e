"""Blocked similarity against comparing every two rows that share a block."""

import random

import pytest

from attestra.functions.texts import LEGAL_FORMS, _identity, indel_ratio
from attestra.operators import dedupe


def stems(value):
    words = _identity(value).split()
    forms = [LEGAL_FORMS[w] for w in words if LEGAL_FORMS.get(w)]
    return " ".join(w for w in words if w not in LEGAL_FORMS), forms[0] if forms else ""


def plain_pairs(rows, threshold):
    """The rule as it is said: rows of one signature are one, who shares a block and is alike in every key is a pair."""
    seen = {}
    for i, *values in sorted(rows):
        identity = tuple(_identity(v) for v in values)
        if any(identity):
            seen.setdefault(identity, (i, [stems(v) for v in values]))
    blocks = {}
    for i, parts in seen.values():
        joined = "|".join(s for s, _ in parts)
        if not joined.replace("|", ""):
            continue
        filled = [s for s, _ in parts if s]
        tail = filled[-1] if parts[-1][1] and filled else joined
        for key in {"p" + joined[:3]} | ({"s" + tail[-4:]} if len(tail) > 1 else set()):
            blocks.setdefault(key, []).append((i, parts, joined))
    out = {}
    for members in blocks.values():
        for x in range(len(members)):
            for y in range(x + 1, len(members)):
                (i, p, s), (j, q, t) = sorted((members[x], members[y]), key=lambda m: m[0])
                if min(len(s), len(t)) < 0.55 * max(len(s), len(t)) or len(set(s) & set(t)) < 3:
                    continue
                least = 100.0
                for (u, f), (v, g) in zip(p, q, strict=True):
                    if not u or not v or (f and g and f != g) or len(u.split()) != len(v.split()):
                        least = 0.0
                        break
                    least = min(least, indel_ratio(u, v))
                if least >= threshold:
                    out[i, j] = round(least, 6)
    return out


def names(seed, n):
    r = random.Random(seed)
    words = ["acme", "global", "technologies", "solutions", "international", "berg", "müller", "systems", "data", "north", "works"]
    base = [" ".join(r.sample(words, r.randint(1, 4))) for _ in range(12)]
    out = []
    for i in range(n):
        text = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            at = r.randrange(len(text) + 1)
            kind = r.random()
            if kind < 0.4 and text:
                del text[min(at, len(text) - 1)]
            elif kind < 0.8:
                text.insert(at, r.choice("abcdest "))
            elif text:
                text[min(at, len(text) - 1)] = r.choice("abcdest")
        out.append((i, "".join(text) + r.choice(["", "", " Inc", " Ltd.", " GmbH"]), r.choice(["Oslo", "Oslo", "Osl", "Bergen", None])))
    return [*out, (n, None, None), (n + 1, "  ", ""), (n + 2, "ab", "Oslo"), (n + 3, "Ltd", None)]


@pytest.mark.parametrize("most,threshold,two", [(10**6, 88.0, False), (3, 88.0, False), (3, 75.0, False), (3, 96.0, True)])
def test_pairs_equal_comparing_all(spark, most, threshold, two):
    rows = names(7, 220)
    table = spark.createDataFrame(rows, "id int, name string, city string")
    keys = ["name", "city"] if two else ["name"]
    got = {(r.a, r.b): round(r.similarity, 6) for r in dedupe.similar_pairs(table, keys, "id", threshold, most).collect()}
    want = plain_pairs([r if two else r[:2] for r in rows], threshold)
    assert got == want and len(want) > 30


def test_a_crowded_block_is_not_all_pairs(spark):
    r = random.Random(2)
    rows = [(i, "the " + "".join(r.choice("abcdefghijklmnop") for _ in range(24))) for i in range(400)] + [(1000, "the " + "q" * 24)]
    rows = [(i, n.replace("the ", "abc")) for i, n in rows]
    table = spark.createDataFrame(rows, "id int, name string")
    from pyspark.sql import functions as F

    blocks = dedupe.block_keys(dedupe.exact(table, ["name"], "id")).filter("block = 'pabc'")
    crowded = blocks.select("id", "block", "joined", F.length("joined").alias("m"))
    assert dedupe._meeting_on_segments(crowded, 0.12).distinct().count() < 0.2 * 400 * 399 / 2
