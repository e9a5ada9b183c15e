"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens at places where the tokenizer's own splitter cuts too, whatever stands
around them: before white space that follows something else, and between ASCII letters, digits and
punctuation. So the tokens of a text are the sum of its pre-tokens' tokens.

1. Every task summarises the pre-tokens it reads (Misra-Gries: at most ``IN_TASK`` counters) and encodes those
   that remain. Summaries, one blob of bounded size a task, are merged in a tree; pre-tokens are never shuffled.
2. The ``most`` frequent ones become a hash table of open addressing (12 bytes a slot: 64-bit hash and length) that is
   broadcast; its size is bounded by that parameter.
3. A second pass looks every pre-token up in the table. What it misses goes to the worker's cache, which keeps
   hashes and lengths in two generations of bounded size, and only what that lacks is encoded.

The summary only decides what is fast; counts are right whatever the table holds. Two different pre-tokens with
one 64-bit hash would get one length (for m distinct ones the chance is m**2 / 2**65).

Special tokens written in a text count as the library counts them: one token each, and what stands
around them is encoded apart.

Defined results: null text is empty and has 0 bytes and tokens; a repeated row is counted again; null
ids stay; a very long text is taken in stretches of about ``CHUNK`` bytes that end between pre-tokens, so that
memory is bounded unless one pre-token is longer; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packing import tokenizer_path
from .shared import materialize, span_hashes, text_chunks

#: Bytes of text that are cut at a time.
CHUNK = 1 << 20
#: Counters of a task's summary, and entries of a generation of a worker's cache.
IN_TASK = 1 << 14
REMEMBERED = 1 << 19
#: Summaries merged by one task; pre-tokens of more bytes are not summarised.
FAN = 32
LONGEST = 64
SUMMARY = "hashes binary, counts binary, lengths binary"
COUNTED = "doc_id long, n_bytes long, n_tokens long"

_OTHER, _SPACE, _LETTER, _DIGIT, _MARK = range(5)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
#: After these a blank belongs to what is before it: white space, and what some tables call so.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
#: First bytes of white space beyond ASCII in UTF-8, and all its forms.
_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: A place where a long text may be cut.
_CUT = re.compile(rb"[A-Za-z0-9](?=[ \t\n])")


def pre_tokens(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(starts, ends, piece of each, joined bytes) of the pre-tokens of non-empty pieces of text."""
    joined = b"".join(pieces)
    data = np.frombuffer(joined, np.uint8)
    kind = _KIND[data]
    blank = _BLANK[data]
    if _LEADS[data].any():
        blank[[m.end() - 1 for m in _WIDE.finditer(joined)]] = True
    first = np.zeros(len(data), bool)
    before, now = kind[:-1], kind[1:]
    first[1:] = (now == _SPACE) & ~blank[:-1]
    first[1:] |= (before == _LETTER) & ((now == _DIGIT) | (now == _MARK))
    first[1:] |= (before == _DIGIT) & ((now == _LETTER) | (now == _MARK))
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    at = np.cumsum(sizes) - sizes
    first[at] = True
    start = np.flatnonzero(first)
    return start, np.append(start[1:], len(data)), np.searchsorted(at, start, "right") - 1, joined


class Counter:
    """A tokenizer with the second tier: lengths of pre-tokens by hash, in two generations."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("an added token of this tokenizer takes in what stands around it")
        words = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, words))) if words else None
        self.young = self.old = (np.zeros(0, np.uint64), np.zeros(0, np.uint32))

    def lengths(self, units: list[bytes]) -> np.ndarray:
        out: list[int] = []
        for a in range(0, len(units), 8192):
            found = self.tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in units[a : a + 8192]], add_special_tokens=False)
            out += [len(e.ids) for e in found]
        return np.array(out, np.uint32)

    def pieces(self, texts: list[bytes]) -> tuple[list[bytes], list[int], np.ndarray]:
        """(non-empty pieces without special tokens, the text of each, special tokens of each text)."""
        parts, owner, special = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            whole = self.special.split(text) if self.special else [text]
            special[i] = len(whole) - 1
            for piece in whole:
                for part in stretches(piece):
                    parts.append(part)
                    owner.append(i)
        return parts, owner, special

    def remembered(self, hashes: np.ndarray, unit: Callable[[int], bytes]) -> np.ndarray:
        """Lengths of distinct hashes in order; ``unit`` gives the bytes of the one at a place."""
        found = np.zeros(len(hashes), np.uint32)
        lacks = np.ones(len(hashes), bool)
        for keys, values in (self.young, self.old):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                here = lacks & (keys[at] == hashes)
                found[here] = values[at[here]]
                lacks &= ~here
        new = np.flatnonzero(lacks)
        if len(new):
            found[new] = self.lengths([unit(i) for i in new.tolist()])
            keys, values = np.concatenate([self.young[0], hashes[new]]), np.concatenate([self.young[1], found[new]])
            order = np.argsort(keys)
            self.young = keys[order], values[order]
            if len(keys) > REMEMBERED:
                self.old, self.young = self.young, (keys[:0], values[:0])
        return found


def stretches(text: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes that end between pre-tokens; nothing of an empty one."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + CHUNK) if len(text) - at > CHUNK else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def blocks(parts: list[bytes], owner: list[int]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(pieces, their texts) of about CHUNK bytes."""
    start, size = 0, 0
    for i, part in enumerate(parts):
        size += len(part)
        if size >= CHUNK or i + 1 == len(parts):
            yield parts[start : i + 1], np.array(owner[start : i + 1])
            start, size = i + 1, 0


@cache
def _counter(path: str) -> Counter:
    return Counter(path)


def heaviest(hashes: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places kept, their counts less the largest count that goes): the Misra-Gries rule for many counters at once."""
    if len(hashes) <= most:
        return np.arange(len(hashes)), counts
    cut = np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
    kept = np.flatnonzero(counts > cut)
    return kept, counts[kept] - cut


def added_up(hashes: np.ndarray, counts: np.ndarray, kind: str = "stable") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, sums of their counts, a place of each: the first if ``kind`` is stable)."""
    order = np.argsort(hashes, kind=kind)
    first = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order[:1]] ^ np.uint64(1))) if len(order) else np.zeros(0, int)
    return hashes[order][first], np.add.reduceat(counts[order], first) if len(first) else counts[:0], order[first]


def _summary(hashes: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    columns = (hashes.astype("<u8"), counts.astype("<i8"), lengths.astype("<u4"))
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], [x.split()[0] for x in SUMMARY.split(", ")])


def _summariser(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        hashes, counts, units = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        for _, texts in text_chunks(batches, CHUNK):
            parts, owner, _ = counter.pieces(texts)
            for own, _ in blocks(parts, owner):
                start, end, _, joined = pre_tokens(own)
                short = end - start <= LONGEST
                start, end = start[short], end[short]
                fresh, times, place = added_up(span_hashes(np.frombuffer(joined, np.uint8), start, end), np.ones(len(start), np.int64), "quicksort")
                # counters first, so that a place below their number is one of them
                both, sums, at = added_up(np.concatenate([hashes, fresh]), np.concatenate([counts, times]))
                kept, sums = heaviest(both, sums, IN_TASK)
                both, at = both[kept], at[kept]
                new = at >= len(hashes)
                place = place[at[new] - len(hashes)]
                units |= {h: joined[a:b] for h, a, b in zip(both[new].tolist(), start[place].tolist(), end[place].tolist(), strict=True)}
                if len(units) > 4 * IN_TASK:
                    units = {h: units[h] for h in both.tolist()}
                hashes, counts = both, sums
        if len(hashes):
            yield _summary(hashes, counts, counter.lengths([units[h] for h in hashes.tolist()]))

    return summarise


def _merge(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashes, counts, lengths = (np.concatenate([h, np.frombuffer(b, k)]) for h, b, k in zip(held, row, ("<u8", "<i8", "<u4"), strict=True))
            hashes, counts, at = added_up(hashes, counts)
            kept, counts = heaviest(hashes, counts, most)
            held = hashes[kept], counts, lengths[at[kept]]
    if len(held[0]):
        yield _summary(*held)


class Table:
    """Lengths by hash with open addressing: the first slot is the hash's high bits, and the next ones follow."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray):
        bits = max(4, int(2 * len(hashes)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.uint32)
        left, slot = np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.values[slot] == 0
            # of those that want one free slot the last gets it
            self.keys[slot[free]], self.values[slot[free]] = hashes[left[free]], lengths[left[free]]
            here = (self.keys[slot] == hashes[left]) & (self.values[slot] > 0)
            left, slot = left[~here], (slot[~here] + 1) & (size - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The length of each hash, 0 where the table lacks it."""
        out = np.zeros(len(hashes), np.uint32)
        left, slot = np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        for _ in range(self.probes):
            value = self.values[slot]
            here = (self.keys[slot] == hashes[left]) & (value > 0)
            out[left[here]] = value[here]
            more = ~here & (value > 0)
            left, slot = left[more], (slot[more] + 1) & (len(self.keys) - 1)
            if not len(left):
                break
        return out


def frequent(documents: DataFrame, path: str, most: int = 1 << 16) -> Table:
    """The table of the most frequent pre-tokens; what the driver gets is one summary of at most ``most`` counters."""
    now = materialize(documents.select("text").mapInArrow(_summariser(path), SUMMARY), "summaries")
    while (n := now.count()) > 1:
        now = materialize(now.repartition(-(-n // FAN)).mapInArrow(lambda batches: _merge(batches, most), SUMMARY), "summaries")
    rows = now.collect()
    if not rows:
        return Table(np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    return Table(np.frombuffer(rows[0]["hashes"], "<u8"), np.frombuffer(rows[0]["lengths"], "<u4"))


def count(documents: DataFrame, path: str | None = None, limit: int = 512, most: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    table = documents.sparkSession.sparkContext.broadcast(frequent(documents, path, most))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for rows, texts in text_chunks(batches, CHUNK):
            parts, owner, totals = counter.pieces(texts)
            for own, of in blocks(parts, owner):
                start, end, piece, joined = pre_tokens(own)
                hashes = span_hashes(np.frombuffer(joined, np.uint8), start, end)
                lengths = table.value.find(hashes)
                missed = np.flatnonzero(lengths == 0)
                if len(missed):
                    rare, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
                    place = missed[first]
                    lengths[missed] = counter.remembered(rare, lambda i, at=place, a=start, b=end, s=joined: s[a[at[i]] : b[at[i]]])[back]
                totals += np.bincount(of[piece], lengths, len(texts)).astype(np.int64)
            columns = [rows.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(totals)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in COUNTED.split(", ")])

    found = documents.select("doc_id", "text").mapInArrow(counted, COUNTED)
    return found.withColumn("over_limit", found["n_tokens"] > limit)
