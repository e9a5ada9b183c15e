"""Removal of repeated byte strings by longest-previous-factor arrays, distributed.

A byte goes when a string of ``least`` (100) bytes that covers it also starts earlier in the corpus, in a
document with a smaller id or further left in the same one. That is: position i is removable with the
next 99 bytes when its longest previous factor is at least 100 long. ``previous_factors`` decides this
from suffix order: among suffixes that share 100 bytes, the previous smaller position in suffix order
is an earlier match, so all but the first of them have one.

Suffixes that share 100 bytes also share an anchor, the 20 bytes of least hash in them, and lie within the
180 bytes around it. So suffix arrays are built per bucket of anchors:

1. Anchors are dealt with a digest of the bytes around. An anchor that occurs once cannot match. Of equal
   surroundings, known by 64-bit digests, all but the first are removable as a whole; this settles the inside of long repeats.
2. Where an anchor has different surroundings, its documents are asked for these bytes.
3. Each bucket builds the longest-previous-factor array of its surroundings, up to 100 bytes, and sends
   removable runs home.

Texts meet their requests and their runs in one shuffle, which both joins use. Blocks of numbers travel
between the steps, not rows.

Defined results: null text is empty; rows with equal ids are one document and get equal results if
their texts are equal; a null id precedes all others; texts under 100 bytes lose nothing; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _BYTE, _STEP, _STEP_BACK, materialize, mix, powers, shuffle_partitions, text_chunks, to_buckets

LEAST = 100
GRAM = 20
#: Grams of a string of LEAST bytes.
SPAN = LEAST - GRAM + 1
#: Bytes of entries in a partition on average.
PARTITION = 8 << 20
#: Buckets of anchors in a partition; a task holds one of them at a time.
BUCKETS = 8
#: Bytes of text read at a time.
CHUNK = 1 << 20
#: Entries that a task gathers before it deals them out.
GATHERED = 400_000
NULL_ID = -(1 << 63)

_ANCHORS = {"doc": "<i8", "pos": "<u4", "right": "u1", "anchor": "<u8", "around": "<u8"}
_SPANS = {"doc": "<i8", "start": "<u4", "end": "<u4"}
_ASKED = {"doc": "<i8", "pos": "<u4", "anchor": "<u8"}
_PIECES = {"doc": "<i8", "start": "<u4", "size": "u1"}
BLOCKS = "kind int, bucket long, block binary"


def _pack(kinds: dict[str, str], columns: dict[str, np.ndarray], tail: bytes = b"") -> bytes:
    size = np.int64(len(columns[next(iter(kinds))])).tobytes()
    return size + b"".join(columns[c].astype(t).tobytes() for c, t in kinds.items()) + tail


def _unpack(kinds: dict[str, str], blocks: list[bytes]) -> tuple[dict[str, np.ndarray], list[bytes]]:
    parts: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
    tails = []
    for block in blocks:
        size, at = int(np.frombuffer(block, "<i8", 1)[0]), 8
        for c, t in kinds.items():
            parts[c].append(np.frombuffer(block, t, size, at))
            at += size * np.dtype(t).itemsize
        tails.append(block[at:])
    return {c: np.concatenate(v) if v else np.zeros(0, kinds[c]) for c, v in parts.items()}, tails


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, blocks = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int64()), pa.array(blocks, pa.binary())], ["kind", "bucket", "block"])


def _deal(kind: int, keys: np.ndarray, kinds: dict[str, str], columns: dict[str, np.ndarray]) -> list[tuple[int, int, bytes]]:
    """One block for each distinct key."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], {c: columns[c][order] for c in kinds}
    cuts = np.flatnonzero(np.diff(keys, prepend=-1)).tolist()
    return [(kind, int(keys[a]), _pack(kinds, {c: v[a:b] for c, v in columns.items()})) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]


def _spread(values: np.ndarray, n: int) -> np.ndarray:
    """Buckets for hashes. Anchors are least hashes, so they are mixed anew."""
    values = mix(values ^ np.uint64(0x5BD1E995))
    return (((values >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _home(docs: np.ndarray, n: int) -> np.ndarray:
    return _spread(docs.astype(np.int64).view(np.uint64), n)


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy()


def anchors(docs: np.ndarray, texts: list[bytes]) -> dict[str, np.ndarray]:
    """The anchors of some texts: document, position, bytes to the right, hash, digest of the bytes around."""
    long = [i for i, t in enumerate(texts) if len(t) >= LEAST]
    if not long:
        return {c: np.zeros(0, t) for c, t in _ANCHORS.items()}
    data = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
    sizes = np.fromiter((len(texts[i]) for i in long), np.int64, len(long))
    ends = np.cumsum(sizes)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_STEP, n), out=sums[1:])
    back = powers(_STEP_BACK, n)
    grams = mix((sums[GRAM:] - sums[: n - GRAM + 1]) * back[: n - GRAM + 1])
    # the least hash of SPAN grams, leftmost among equals: prefix and suffix minima of blocks
    keyed = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(keyed) // SPAN)
    padded = np.full(blocks * SPAN, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keyed)] = keyed
    padded = padded.reshape(blocks, SPAN)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(keyed) - SPAN + 1
    least = np.minimum(behind[:windows], ahead[SPAN - 1 : SPAN - 1 + windows])
    valid = np.ones(windows, bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - LEAST + 1) : e] = False
    at = (least[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    which = np.searchsorted(ends, at, "right")
    begin = (ends - sizes)[which]
    left, right = np.minimum(at - begin, SPAN - 1), np.minimum(ends[which] - at, LEAST)
    around = mix((sums[at + right] - sums[at - left]) * back[at - left] + (left * 256 + right).astype(np.uint64))
    return {"doc": docs[np.array(long)][which], "pos": at - begin, "right": right, "anchor": grams[at], "around": around}


def _anchor_dealer(buckets: int, homes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(held: list[dict[str, np.ndarray]]) -> list[tuple[int, int, bytes]]:
        x = {c: np.concatenate([h[c] for h in held]) for c in _ANCHORS}
        spans, rest, _ = _settle(x)
        return _deal(0, _spread(rest["anchor"], buckets), _ANCHORS, rest) + _deal(1, _home(spans["doc"], homes), _SPANS, spans)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for rows, texts in text_chunks(batches, CHUNK):
            held.append(anchors(_ids(rows), texts))
            total += len(held[-1]["doc"])
            if total >= GATHERED:
                yield _batch(flush(held))
                held, total = [], 0
        if total:
            yield _batch(flush(held))

    return deal


def _settle(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """(spans of surroundings that occur earlier, the first of each kind of surroundings, how many kinds its anchor has)."""
    order = np.lexsort((x["pos"], x["doc"], x["around"], x["anchor"]))
    x = {c: v[order] for c, v in x.items()}
    m = len(order)
    new_anchor, new = np.ones(m, bool), np.ones(m, bool)
    new_anchor[1:] = x["anchor"][1:] != x["anchor"][:-1]
    new[1:] = new_anchor[1:] | (x["around"][1:] != x["around"][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(m), 0)) if m else np.zeros(0, int)
    # an entry of the very same place, from a repeated row, is no earlier one
    later = ~new & ((x["doc"] != x["doc"][first]) | (x["pos"] != x["pos"][first]))
    pos = x["pos"][later].astype(np.int64)
    spans = {"doc": x["doc"][later], "start": np.maximum(pos - (SPAN - 1), 0), "end": pos + x["right"][later]}
    group = np.cumsum(new_anchor) - 1
    kinds = np.bincount(group, new, len(group) and int(group[-1]) + 1)[group] if m else np.zeros(0)
    return spans, {c: v[new] for c, v in x.items()}, kinds[new]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    now, held = None, {}
    for batch in batches:
        for kind, bucket, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and held:
                yield now, held
                held = {}
            now = bucket
            held.setdefault(kind, []).append(block)
    if held:
        yield now, held


def _asker(homes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each bucket of anchors: removable spans, and requests for surroundings that differ."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches):
            if 1 in held:
                yield _batch([(1, bucket, b) for b in held[1]])
            if 0 in held:
                x, _ = _unpack(_ANCHORS, held[0])
                spans, first, kinds = _settle(x)
                asked = {c: first[c][kinds > 1] for c in _ASKED}
                rows = _deal(1, _home(spans["doc"], homes), _SPANS, spans) + _deal(2, _home(asked["doc"], homes), _ASKED, asked)
                if rows:
                    yield _batch(rows)

    return ask


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans joined where they touch or overlap, by document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, start, end
    other = np.ones(len(doc), bool)
    other[1:] = doc[1:] != doc[:-1]
    # the furthest end so far within the document
    group = np.cumsum(other) - 1
    lift = group * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + lift)
    fresh = other.copy()
    fresh[1:] |= start[1:] + lift[1:] > far[:-1]
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], (far - lift)[last]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a home: merged spans and requests."""
    for _, held in _by_bucket(batches):
        spans, _ = _unpack(_SPANS, held.get(1, []))
        asked, _ = _unpack(_ASKED, held.get(2, []))
        doc, start, end = merged(spans["doc"], spans["start"], spans["end"])
        order = np.lexsort((asked["pos"], asked["doc"]))
        asked = {c: v[order] for c, v in asked.items()}
        ids = np.union1d(doc, asked["doc"])
        rows = []
        for i, a, b, c, d in zip(ids.tolist(), *(np.searchsorted(v, ids, side).tolist() for v in (doc, asked["doc"]) for side in ("left", "right")), strict=True):
            rows.append((i, np.stack([start[a:b], end[a:b]]).astype("<i8").tobytes(), asked["pos"][c:d].astype("<u4").tobytes() + asked["anchor"][c:d].astype("<u8").tobytes()))
        if rows:
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["home_id", "spans", "asked"])


def _answerer(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes around the anchors asked for, dealt to the anchors' buckets."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches, CHUNK):
            docs, keys, starts, pieces = _ids(rows), [], [], []
            owner = []
            for doc, asked, text in zip(docs.tolist(), rows.column("asked").to_pylist(), texts, strict=True):
                n = len(asked) // 12
                pos = np.frombuffer(asked, "<u4", n).tolist()
                keys.append(np.frombuffer(asked, "<u8", n, 4 * n))
                for p in pos:
                    s = max(0, p - SPAN + 1)
                    starts.append(s)
                    pieces.append(text[s : p + LEAST])
                owner += [doc] * n
            if not pieces:
                continue
            key = _spread(np.concatenate(keys), buckets)
            order = np.argsort(key, kind="stable")
            key, owner_, starts_ = key[order], np.array(owner, np.int64)[order], np.array(starts, np.int64)[order]
            cuts = np.flatnonzero(np.diff(key, prepend=-1)).tolist()
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
                own = [pieces[i] for i in order[a:b].tolist()]
                columns = {"doc": owner_[a:b], "start": starts_[a:b], "size": np.fromiter(map(len, own), np.int64, b - a)}
                out.append((3, int(key[a]), _pack(_PIECES, columns, b"".join(own))))
            yield _batch(out)

    return answer


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dense rank of each key, whether others share it)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    rank = np.empty(len(keys), np.uint64)
    rank[order] = group.astype(np.uint64)
    shared = np.empty(len(keys), bool)
    shared[order] = np.bincount(group, minlength=1)[group] > 1
    return rank, shared


def _previous_smaller(values: np.ndarray) -> np.ndarray:
    """The nearest position to the left with a smaller value, -1 where there is none.

    All positions climb a tree of minima until a left neighbour holds a smaller value, then descend into it,
    so 2 log n rounds suffice whatever the order of the values.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    leaves = 1 << (n - 1).bit_length()
    tree = np.full(2 * leaves, np.iinfo(np.int64).max)
    tree[leaves : leaves + n] = values
    level = leaves
    while level > 1:
        half = level >> 1
        tree[half:level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
        level = half
    found = np.full(n, -1)
    who, node = np.arange(n), np.arange(leaves, leaves + n)
    turned, below = [], []
    while len(who):
        right = (node & 1) == 1
        right &= (node > 1) & (tree[node - 1] < values[who])
        turned.append(who[right])
        below.append(node[right] - 1)
        up = ~right & (node > 1)
        who, node = who[up], node[up] >> 1
    who, node = np.concatenate(turned), np.concatenate(below)
    while len(who):
        leaf = node >= leaves
        found[who[leaf]] = node[leaf] - leaves
        who, node = who[~leaf], node[~leaf] << 1
        node += tree[node + 1] < values[who]
    return found


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many of the next ``most`` bytes at ``a`` and at ``b`` are equal before the first that differs."""
    out = np.empty(len(a), np.int64)
    step = np.arange(most)
    for i in range(0, len(a), 1 << 14):
        differ = data[a[i : i + (1 << 14), None] + step] != data[b[i : i + (1 << 14), None] + step]
        out[i : i + (1 << 14)] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    return out


def longest_previous_factors(data: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The longest previous factor, up to ``least``, of the suffixes of ``data`` at ``at``; each has ``least`` bytes.

    ``doc`` and ``place`` say where a suffix stands in the corpus; suffixes of one place are no earlier than each
    other. Factors shorter than the largest 8 * 2^k that is no more than ``least`` are given as 0: prefix doubling
    drops suffixes that share no prefix of that size. The rest are sorted by their next bytes. In this suffix order,
    among suffixes of an earlier place the one with the longest common prefix is the previous or the next smaller place, so
    comparing the bytes of these two gives the factor.
    """
    out = np.zeros(len(at), np.int64)
    word = np.zeros(len(data), np.uint64)
    tail = np.concatenate([data, np.zeros(8, np.uint8)])
    for b in range(8):
        word = (word << np.uint64(8)) | tail[b : b + len(data)]
    rank, shared = _ranks(word)
    size = 8
    while size * 2 <= least:
        # positions whose halves are both shared can share twice the size
        both = np.flatnonzero(shared[: len(data) - size] & shared[size:])
        joined, again = _ranks((rank[both] << np.uint64(32)) | rank[both + size])
        rank, shared = np.zeros(len(data), np.uint64), np.zeros(len(data), bool)
        rank[both], shared[both] = joined, again
        size *= 2
    some = np.flatnonzero(shared[at])
    if not len(some):
        return out
    begin = at[some]
    keys = [word[begin + i] for i in sorted({*range(size, least - 7, 8), max(size - 8, least - 8)}, reverse=True)]
    order = np.lexsort([*keys, rank[begin]])
    some, begin, whole = some[order], begin[order], rank[begin[order]]
    del keys, order, word, rank, shared
    # one number for each place of the corpus, by document and position
    by_place = np.lexsort((place[some], doc[some]))
    new = np.ones(len(some), bool)
    new[1:] = (np.diff(doc[some][by_place]) != 0) | (np.diff(place[some][by_place]) != 0)
    number = np.empty(len(some), np.int64)
    number[by_place] = np.cumsum(new)
    before = _previous_smaller(number)
    after = _previous_smaller(number[::-1])[::-1]
    after = np.where(after < 0, -1, len(some) - 1 - after)
    for other in (before, after):
        same = np.flatnonzero((other >= 0) & (whole[other] == whole))
        common = _common(data, begin[same], begin[other[same]], least)
        out[some[same]] = np.maximum(out[some[same]], common)
    return out


def _solver(homes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_bucket(batches):
            x, tails = _unpack(_PIECES, held[3])
            data = np.frombuffer(b"".join(tails), np.uint8)
            size = x["size"].astype(np.int64)
            base = np.cumsum(size) - size
            windows = size - LEAST + 1
            piece = np.repeat(np.arange(len(size)), windows)
            inside = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
            place = x["start"].astype(np.int64)[piece] + inside
            found = longest_previous_factors(data, base[piece] + inside, x["doc"][piece], place) >= LEAST
            doc, start, end = merged(x["doc"][piece[found]], place[found], place[found] + LEAST)
            if len(doc):
                yield _batch(_deal(1, _home(doc, homes), _SPANS, {"doc": doc, "start": start, "end": end}))

    return solve


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_chunks(batches, CHUNK):
        out = []
        for doc, early, late, text in zip(rows.column("doc_id").to_pylist(), rows.column("spans").to_pylist(), rows.column("more").to_pylist(), texts, strict=True):
            parts = [np.frombuffer(s, "<i8").reshape(2, -1) for s in (early, late) if s]
            kept, n_removed, n_spans = text, 0, 0
            if parts:
                both = np.concatenate(parts, axis=1)
                _, start, end = merged(np.zeros(both.shape[1], int), both[0], both[1])
                bounds = [0, *np.stack([start, end], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
                n_removed, n_spans = len(text) - len(kept), len(start)
            out.append((doc, len(text), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def without_repeats(documents: DataFrame, kept_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of every document."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), int(total * 30 / 41 / PARTITION))
    dealt = rows.mapInArrow(_anchor_dealer(BUCKETS * parts, parts), BLOCKS)
    asked = to_buckets(dealt, parts).mapInArrow(_asker(parts), BLOCKS)
    gathered = "home_id long, spans binary, asked binary"
    homes = materialize(to_buckets(asked, parts).mapInArrow(_gather, gathered), "homes")

    # one shuffle of the texts for both joins
    texts = rows.withColumn("home_id", F.coalesce("doc_id", F.lit(NULL_ID))).repartition(shuffle_partitions(spark), "home_id")
    requests = homes.filter(F.length("asked") > 0).select("home_id", "asked").hint("shuffle_hash")
    answered = texts.join(requests, "home_id").select("doc_id", "text", "asked").mapInArrow(_answerer(BUCKETS * parts), BLOCKS)
    solved = to_buckets(answered, parts).mapInArrow(_solver(parts), BLOCKS)
    more = to_buckets(solved, parts).mapInArrow(_gather, gathered).select("home_id", F.col("spans").alias("more"))
    spans = homes.select("home_id", "spans").join(more, "home_id", "full").hint("shuffle_hash")
    done = texts.join(spans, "home_id", "left").select("doc_id", "text", "spans", "more")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = done.mapInArrow(_cut, kinds)
    return out if kept_bytes else out.drop("kept")
