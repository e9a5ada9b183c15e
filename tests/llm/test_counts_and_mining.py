"""Token counts, importance resampling and hard negatives against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import hard_negatives, importance, token_counts
from attestra.llm.packing import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
#: Documents with columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, n string, hashes long, at string, rank string, bucket string"


def texts(seed: int, n: int) -> list[str | None]:
    r = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", " ", "　", "a", "Be", "é", "'s", "'", "1", "22", ".", ",", "-", "<|endoftext|>", "\x1c", "\x85", "'ll", "_", "中", "word", "Word"]
    odd = [None, "", " ", "<|endoftext|>", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|>", "x" * 3000, "ab " * 4000, "\n\n\na", "don't 5's    x"]
    return odd + ["".join(r.choice(bits) for _ in range(r.randint(1, 80))) for _ in range(n - len(odd))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "w") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_token_counts(spark, library, most):
    rows = [(None if i == 7 else i // 2, t) for i, t in enumerate(texts(1, 300))]
    got = token_counts.count(frame(spark, rows), limit=40, most=most).collect()
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 40) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t  \x1c\x85'sdlvetrmA1é.,-中́")), max_size=60))
def test_pre_tokens_add_up(text):
    counter = token_counts._counter(PATH)
    if not text:
        return
    start, end, _, joined = token_counts.pre_tokens([text.encode()])
    assert start[0] == 0 and end[-1] == len(joined) and (start[1:] == end[:-1]).all()
    assert counter.lengths([joined[a:b] for a, b in zip(start, end, strict=True)]).sum() == counter.lengths([text.encode()])[0]


def test_long_texts_are_cut_between_pre_tokens(monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 50)
    counter = token_counts._counter(PATH)
    text = ("some Words 12 and\n more. don't " * 40).encode()
    parts = list(token_counts.stretches(text))
    assert len(parts) > 10 and b"".join(parts) == text and counter.lengths(parts).sum() == counter.lengths([text])[0]
    blocks = list(token_counts.blocks(parts, list(range(len(parts)))))
    assert [p for own, _ in blocks for p in own] == parts and [i for _, of in blocks for i in of] == list(range(len(parts)))


def test_table_of_lengths():
    r = np.random.RandomState(1)
    hashes = np.unique(r.randint(0, 1 << 62, 5000).astype(np.uint64) << np.uint64(2))
    # hashes whose first slots are the same follow one another
    hashes = np.unique(np.concatenate([hashes, np.arange(100, dtype=np.uint64)]))
    lengths = r.randint(1, 9, len(hashes)).astype(np.uint32)
    table = token_counts.Table(hashes, lengths)
    assert (table.find(hashes) == lengths).all() and not table.find(hashes + np.uint64(1 << 20)).any()
    assert not token_counts.Table(hashes[:0], lengths[:0]).find(hashes).any()


def test_summaries_keep_what_is_frequent():
    r = np.random.RandomState(2)
    seen = np.concatenate([np.repeat(np.arange(5), 300), r.randint(100, 10**6, 1500)]).astype(np.uint64)
    r.shuffle(seen)
    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for part in np.array_split(seen, 30):
        both, sums, _ = token_counts.added_up(np.concatenate([held[0], part]), np.concatenate([held[1], np.ones(len(part), np.int64)]))
        kept, sums = token_counts.heaviest(both, sums, 40)
        held = both[kept], sums
    assert set(range(5)) <= set(held[0].tolist()) and len(held[0]) <= 40
    # a count is never too high, and too low by at most all counts over the number of counters
    true = Counter(seen.tolist())
    assert all(true[h] - len(seen) / 41 <= c <= true[h] for h, c in zip(held[0].tolist(), held[1].tolist(), strict=True))


def test_worker_cache_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 20)
    counter = token_counts.Counter(PATH)
    words = [f"w{i}x".encode() for i in range(200)]
    want = counter.lengths(words)
    for _ in range(3):
        for a in range(0, 200, 15):
            hashes = np.arange(a, min(200, a + 15), dtype=np.uint64)
            assert (counter.remembered(hashes, lambda i, a=a: words[a + i]) == want[a : a + 15]).all()
    assert len(counter.young[0]) <= 20 + 15 and len(counter.old[0]) <= 20 + 15


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain_features(text: str | None, longest: int) -> tuple[list[bytes], int]:
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))
    return [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)], len(words)


def plain_resample(rows, target, longest, buckets, percent, least_words):
    found = [(i, *plain_features(t, longest)) for i, t in rows]
    counts = Counter(zlib.crc32(f) % buckets for _, fs, _ in found for f in fs)
    wanted = Counter(zlib.crc32(f) % buckets for _, t in target for f in plain_features(t, longest)[0])
    a, b = sum(counts.values()) + buckets, sum(wanted.values()) + buckets
    out = []
    for i, fs, n in found:
        weight = sum(math.floor(1000 * math.log((wanted[x] + 1) * a / ((counts[x] + 1) * b))) for f in fs for x in [zlib.crc32(f) % buckets])
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((x for x in out if x[4] >= least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = {id(x): k for k, x in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*x[:4], drawn.get(id(x))) for x in out]


@pytest.mark.parametrize("longest", [1, 3])
def test_importance(spark, longest):
    rows = [(None if i == 30 else i, t) for i, t in enumerate(texts(5, 200))] + [(500, "Same words here " * 9), (500, "Same words here " * 9)]
    target = [(1, "a word é 22"), (2, None), (3, "word Word word")]
    got = importance.resample(frame(spark, rows), frame(spark, target), percent=40, longest=longest, buckets=97, least_words=4, target_id="doc_id").collect()
    want = plain_resample(rows, target, longest, 97, 40, 4)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(r.rank is not None for r in got) > 20


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_runs_of_suffixes_are_all_occurrences(monkeypatch, longest):
    monkeypatch.setattr(importance, "CHUNK", 40)
    for text in texts(9, 80):
        raw = (text or "").encode().translate(LOWER)
        parts = list(importance.stretches(raw, longest - 1))
        found, counts, words = importance.block_buckets(parts, np.zeros(len(parts), int), longest, 1000)
        features, n = plain_features(text, longest)
        assert sorted(found.tolist()) == sorted(zlib.crc32(f) % 1000 for f in features) and words.sum() == n and counts.sum() == len(features)


def test_suffix_order_and_shared_words():
    r = random.Random(4)
    words = np.array([r.randint(0, 2) for _ in range(60)])
    room = np.concatenate([np.arange(25, 0, -1), np.arange(35, 0, -1)])
    order, shared = importance.suffix_order(words, room, 5)
    keys = [tuple(words[i : i + min(5, room[i])].tolist()) for i in order.tolist()]
    assert keys == sorted(keys)
    for i in range(1, 60):
        a, b = keys[i - 1], keys[i]
        assert shared[i] == next((k for k in range(5) if k >= len(a) or k >= len(b) or a[k] != b[k]), 5)


VECTORS = "vec_id long, embedding array<double>, label int, v string, bucket long, score string"


def plain_mine(rows, every=50):
    able = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or abs(x) > 1 << 18 for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        row = (label, [math.floor(256 * x) for x in v])
        able[i] = min(able.get(i, row), row)
    out = []
    for a in sorted(i for i in able if i % every == 0):
        score = {i: sum(x * y for x, y in zip(able[a][1], v, strict=False)) for i, (_, v) in able.items()}
        ranked = sorted((i for i in able if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in ranked if able[i][0] == able[a][0]][:5]:
            near = [i for i in ranked if able[i][0] != able[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(near[:3], 1)]
    return out


def mined(spark, rows):
    table = spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], VECTORS).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(table).collect())


@pytest.mark.parametrize("seed,dims,scale", [(1, 8, 0.3), (2, 5, 40.0), (3, 1, 0.01)])
def test_hard_negatives(spark, monkeypatch, seed, dims, scale):
    monkeypatch.setattr(hard_negatives, "ROWS", 150)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    r = random.Random(seed)
    centres = [[r.gauss(0, scale) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, scale / 2) for x in centres[i % 4]], r.choice([i % 4, i % 4, 0])) for i in range(600)]
    # many copies of one vector, ties, and rows that take no part
    rows += [(i, list(rows[3][1]), i % 3) for i in range(600, 900)]
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * dims, 1), (903, [float("inf")] * dims, 2), (950, rows[0][1], None), (None, rows[1][1], 1), (904, [1e300] * dims, 1)]
    rows += [(1000, [], 1), (1001, [0.5], 1), (1050, [*rows[2][1], 0.7, -0.2], 2), (3, rows[9][1], 1), (3, rows[3][1], rows[3][2])]
    got = mined(spark, rows)
    assert got == sorted(plain_mine(rows)) and len(got) > 20


def test_bounds_hold_every_score():
    r = np.random.RandomState(6)
    exact = r.randint(-500, 500, (300, 12)).astype("<i4")
    low = exact.min(0).astype(np.int64)
    width = -(-(exact.max(0) - low + 1) // hard_negatives.CELLS)
    block = hard_negatives.Approximated(np.arange(300).astype("<i8").tobytes(), np.zeros(300, "<i8").tobytes(), exact.tobytes(), low, width)
    for i in range(20):
        anchor = exact[i].astype(np.int64)
        lower, gap = block.lower(anchor, 10, 290)
        score = exact[10:290].astype(np.int64) @ anchor
        assert (lower <= score).all() and (score <= lower + gap).all() and gap > 0


def test_empty_tables_of_the_three(spark):
    none = frame(spark, [])
    assert token_counts.count(none).collect() == [] and importance.resample(none, none, target_id="doc_id").collect() == []
    assert mined(spark, []) == [] and mined(spark, [(50, [1.0], 1)]) == []
    some = importance.resample(frame(spark, [(1, "a b"), (2, None)]), none, least_words=1, percent=100, target_id="doc_id").collect()
    assert sorted((r.doc_id, r.n_features, r.rank) for r in some) == [(1, 2, 1), (2, 0, None)]
