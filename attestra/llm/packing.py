"""Packing by the cutting-stock method.

Every document is tokenised and cut into pieces of at most ``size`` ids. The histogram of piece
lengths (in units of ``unit`` ids, at most size / unit bins whatever the corpus) defines a
cutting-stock problem: a linear program over patterns, where a pattern says how many pieces of each
length one sequence holds. Column generation solves it: the restricted program's prices go to an
unbounded knapsack, solved by dynamic programming, which finds the pattern to add. Pattern counts
are rounded down, what they leave is filled first-fit in decreasing length, and the pieces, ranked
within their length, take the slots of the patterns in order. Ranks and offsets are distributed
prefix sums; only the histogram and the patterns pass through the driver.

Defined results: null text is empty; an empty text is one piece holding the end id; a repeated row is
packed as a document of its own; null ids are packed too; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, materialize, span_hashes, text_chunks

#: Words, and ids of words, that a worker remembers; beyond either it keeps the half most used.
MOST_WORDS = 400_000
MOST_IDS = 4_000_000
#: Bytes of text read, and words encoded, at a time.
CHUNK = 1 << 20
ENCODED = 8192
PIECES = "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long, level int"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """The ids of words, known by 64-bit hashes, in flat arrays; no word's bytes are kept.

    Encoding words one by one equals encoding the text: this tokenizer's normaliser and splitter
    never look across ASCII white space, which it drops. It also lower-cases and separates
    punctuation from letters, so both are done first to have fewer different words. Only texts
    that may spell a special token are left as they are.
    """

    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    space = np.isin(np.arange(256), list(SPACES))
    letter = np.isin(np.arange(256), range(97, 123))
    stop = np.isin(np.arange(256), list(b".,"))
    gap = np.isin(np.arange(256), list(b" \n"))

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Hashes in order, and the word's number for each; by number where its ids begin, how many they are, and how often it came.
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.size, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.keys)

    def trim(self) -> None:
        """Keep the words most used that fill at most half of either bound; their uses count half from now on."""
        order = np.argsort(-self.uses, kind="stable")[: MOST_WORDS // 2]
        kept = np.sort(order[np.cumsum(self.size[order]) <= MOST_IDS // 2])
        place = np.full(len(self.uses), -1, np.int32)
        place[kept] = np.arange(len(kept), dtype=np.int32)
        here = place[self.numbers] >= 0
        self.keys, self.numbers = self.keys[here], place[self.numbers[here]]
        self.ids = self._flat(kept)
        self.size, self.uses = self.size[kept], self.uses[kept] // 2
        self.first = np.cumsum(self.size) - self.size

    def _flat(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of some words, one after another."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.first[numbers] - (ends - sizes), sizes)]

    def words(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(joined texts, where words start and end, words of each text)."""
        special = [i for i, t in enumerate(texts) if b"<|" in t]
        held = set(special)
        joined = b" ".join(t if i in held else t.translate(self.lower) for i, t in enumerate(texts)) + b" "
        data = np.frombuffer(joined, np.uint8)
        space = self.space[data]
        # a full stop or comma after a letter and before a gap is a word of its own
        cut = np.zeros(len(data), bool)
        cut[1:-1] = self.stop[data[1:-1]] & self.letter[data[:-2]] & self.gap[data[2:]]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        for i in special:
            cut[ends[i] - len(texts[i]) - 1 : ends[i]] = False
        begins = ~space
        begins[1:] &= space[:-1] | cut[1:]
        stops = ~space
        stops[:-1] &= space[1:] | cut[1:]
        start = np.flatnonzero(begins)
        return joined, start, np.flatnonzero(stops) + 1, np.bincount(np.searchsorted(ends, start, "right"), minlength=len(texts))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.uses) > MOST_WORDS or len(self.ids) > MOST_IDS:
            self.trim()
        joined, start, end, counts = self.words(texts)
        hashes = span_hashes(np.frombuffer(joined, np.uint8), start, end)
        order = np.argsort(hashes)
        fresh = np.ones(len(order), bool)
        fresh[1:] = hashes[order][1:] != hashes[order][:-1]
        places = order[fresh]
        distinct = hashes[places]
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        numbers = np.empty(len(distinct), np.int64)
        numbers[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            numbers[new] = len(self.uses) + np.arange(len(new))
            self._learn([joined[a:b] for a, b in zip(start[places[new]].tolist(), end[places[new]].tolist(), strict=True)], distinct[new])
        runs = np.flatnonzero(fresh)
        self.uses[numbers] += np.diff(np.append(runs, len(order)))
        of = np.empty(len(order), np.int64)
        of[order] = numbers[np.cumsum(fresh) - 1]
        bounds = np.concatenate([[0], np.cumsum(self.size[of])])[np.concatenate([[0], np.cumsum(counts)])]
        return self._flat(of), np.diff(bounds)

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        parts, sizes = [self.ids], []
        for a in range(0, len(words), ENCODED):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[a : a + ENCODED]], add_special_tokens=False)]
            sizes += map(len, lists)
            parts.append(np.fromiter((i for x in lists for i in x), np.uint32))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, np.array(sizes, np.int64)])
        self.ids = np.concatenate(parts)
        keys, numbers = np.concatenate([self.keys, hashes]), np.concatenate([self.numbers, (len(self.uses) + np.arange(len(hashes))).astype(np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(hashes), np.int64)])
        # both halves are in order
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], numbers[order]


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _cutter(path: str, end_id: int, size: int, unit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for rows, texts in text_chunks(batches, CHUNK):
            ids, counts = words.encode(texts)
            ids = ids.astype("<u4")
            out: list[tuple] = []
            at = 0
            for doc, key, n in zip(rows.column("doc_id").to_pylist(), rows.column("row_key").to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for start in range(0, n + 1, size):
                    piece = own[start : start + size]
                    out.append((doc, key, start, len(piece), zlib.crc32(piece.tobytes()), n + 1, -(-len(piece) // unit)))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 6 + [pa.int32()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return cut


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items 1..len(prices) (their own sizes) within ``capacity``, by dynamic programming."""
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, np.int64)
    items = np.flatnonzero(prices > 1e-12) + 1
    worth = prices[items - 1]
    for room in range(1, capacity + 1):
        fits = items <= room
        best[room], taken[room] = best[room - 1], 0
        if fits.any():
            value = best[room - items[fits]] + worth[fits]
            top = int(np.argmax(value))
            if value[top] > best[room]:
                best[room], taken[room] = value[top], items[fits][top]
    pattern = np.zeros(len(prices), np.int64)
    room = capacity
    while room > 0:
        if taken[room]:
            pattern[taken[room] - 1] += 1
            room -= int(taken[room])
        else:
            room -= 1
    return float(best[capacity]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots. Threads of a linear algebra library can wait for ever in a driver that has started a JVM; this has none."""
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], 1)
    for i in range(n):
        j = i + int(np.argmax(np.abs(both[i:, i])))
        both[[i, j]] = both[[j, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, n:]


def product(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector)


def cutting_stock(demand: np.ndarray, capacity: int, most_columns: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each so that every piece of ``demand`` (by length, from 1) has one slot.

    Revised simplex on min sum(x) with A x = demand; a column enters while the knapsack finds one of
    reduced cost below zero. Stopping early leaves a valid, merely less tight, packing.
    """
    levels = np.flatnonzero(demand) + 1
    if not len(levels):
        return []
    m = len(levels)
    wanted = demand[levels - 1].astype(float)
    fill = capacity // levels
    basis = [np.where(np.arange(m) == i, fill[i], 0).astype(np.int64) for i in range(m)]
    inverse = np.diag(1.0 / fill)
    x = wanted / fill
    for step in range(most_columns):
        if step and step % 100 == 0:
            inverse = inverted(np.array(basis, float).T)
            x = np.maximum(product(inverse, wanted), 0)
        prices = inverse.sum(0)
        offered = np.zeros(capacity)
        offered[levels - 1] = prices
        value, pattern = knapsack(offered, capacity)
        if value <= 1 + 1e-4:
            break
        column = pattern[levels - 1]
        moved = product(inverse, column.astype(float))
        limits = np.where(moved > 1e-9, x / np.where(moved > 1e-9, moved, 1), np.inf)
        out = int(np.argmin(limits))
        if not np.isfinite(limits[out]):
            break
        x = np.maximum(x - limits[out] * moved, 0)
        x[out] = limits[out]
        row = inverse[out] / moved[out]
        inverse = inverse - np.outer(moved, row)
        inverse[out] = row
        basis[out] = column
    left = demand.copy()
    plan: list[tuple[np.ndarray, int]] = []
    for column, times in sorted(zip(basis, np.floor(x + 1e-6).astype(np.int64), strict=True), key=lambda p: -p[1]):
        full = np.zeros(capacity, np.int64)
        full[levels - 1] = column
        held = full > 0
        times = int(min(times, *(left[held] // full[held]))) if held.any() else 0
        if times:
            plan.append((full, times))
            left = left - times * full
    return plan + first_fit(left, capacity)


def first_fit(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Fill one pattern after another with the longest pieces that fit, repeating a pattern while its pieces last."""
    left, plan = left.copy(), []
    while left.any():
        pattern, room = np.zeros(len(left), np.int64), capacity
        while room > 0:
            held = np.flatnonzero(left[:room] > pattern[:room])
            if not len(held):
                break
            level = int(held[-1]) + 1
            take = min(int(left[level - 1] - pattern[level - 1]), room // level)
            pattern[level - 1] += take
            room -= take * level
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def pack(
    documents: DataFrame, path: str | None = None, size: int = 4096, unit: int = 16, end_id: int = 2, salts: int = 64
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    if size % unit:
        raise ValueError("size must be a multiple of unit")
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text").withColumn("row_key", F.monotonically_increasing_id())
    pieces = materialize(rows.mapInArrow(_cutter(path or tokenizer_path(), end_id, size, unit), PIECES), "pieces")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_key", "start"), F.lit(salts)))

    # at most size / unit levels times salts rows
    cells = pieces.groupBy("level", "salt").count().collect()
    capacity = size // unit
    demand = np.zeros(capacity, np.int64)
    for c in cells:
        demand[c["level"] - 1] += c["count"]
    ahead: dict[int, int] = {}
    ranks = []
    for c in sorted(cells, key=lambda c: (c["level"], c["salt"])):
        ranks.append((c["level"], c["salt"], ahead.get(c["level"], 0)))
        ahead[c["level"]] = ahead.get(c["level"], 0) + c["count"]
    slots, base, before = [], 0, np.zeros(capacity, np.int64)
    for number, (pattern, times) in enumerate(cutting_stock(demand, capacity)):
        for level in (np.flatnonzero(pattern) + 1).tolist():
            each = int(pattern[level - 1])
            slots.append((level, int(before[level - 1]), int(before[level - 1]) + each * times, each, base))
        before += pattern * times
        base += times
    ranks_table = F.broadcast(spark.createDataFrame(ranks, "level int, salt long, ahead long"))
    slots_table = F.broadcast(spark.createDataFrame(slots, "level int, lo long, hi long, each long, base long"))

    within = Window.partitionBy("level", "salt").orderBy("doc_id", "start", "row_key")
    ranked = pieces.withColumn("own", F.row_number().over(within) - 1).join(ranks_table, ["level", "salt"])
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("own")).alias("r")
    slotted = ranked.join(slots_table.alias("s"), F.expr("r.level = s.level and r.rank >= s.lo and r.rank < s.hi"))
    placed = slotted.select("r.*", (F.col("s.base") + F.expr("(r.rank - s.lo) div s.each")).alias("sequence_id"))
    so_far = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(so_far), F.lit(0)).alias("offset"),
    )


def plan_of(histogram: dict[int, int], size: int = 4096, unit: int = 16) -> str:
    """The patterns for a histogram of piece lengths, as JSON: [[{length: pieces}, sequences], ...]."""
    demand = np.zeros(size // unit, np.int64)
    for length, count in histogram.items():
        demand[-(-length // unit) - 1] += count
    plan = cutting_stock(demand, size // unit)
    return json.dumps([[{int(k + 1) * unit: int(p[k]) for k in np.flatnonzero(p)}, t] for p, t in plan])
