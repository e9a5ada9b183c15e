"""Importance resampling towards a target distribution, with n-grams counted from word-id suffix arrays.

A feature is a run of 1 to ``longest`` consecutive words, known by its bucket, the CRC-32 of its bytes modulo
``buckets``.

1. A task numbers the words of a block of text and sorts the block's suffixes by their first ``longest`` word ids. Two
   neighbours that agree in their first k words (their common prefix, LCP) belong to one run of an n-gram. Each run's bytes
   are hashed once, and its bucket is scattered back to the places of its occurrences. The buckets of every document,
   two bytes each, are written beside its id: the texts are read once.
2. Bucket counts of the corpus (S, s) and of the target (T, t) are added up in tasks first; at most ``buckets`` rows
   reach the driver, which makes from them the gain of a bucket:
   floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))).
3. A document's weight is the sum of its gains. Gumbel noise from SHA-256 of seed and id is added, and the highest scores of
   the documents that are long enough are drawn: a sample without replacement in proportion to e ** (weight / 1000). Ranks are
   two-level: the rows are dealt by ranges of score, numbered within their range, and ranges are counted.

Defined results: null and wordless texts have no features and weight 0; a repeated row has features, a weight and a
rank of its own, and counts again; ties of scores go to the smaller id, a null id last; the noise of a null id is
that of an empty id; an empty table gives no rows, and an empty target has t = T = 0; a very long text is taken in
stretches of about ``CHUNK`` bytes that end between words; other columns are ignored. Two words with one 64-bit hash
would count as one (for m distinct words in a block the chance is m**2 / 2**65).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, shuffle_partitions, span_hashes, text_chunks

#: Bytes of text that a suffix array covers, unless a document's stretch is longer.
CHUNK = 1 << 20
#: A-Z are lower-cased; words are runs of these bytes.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IN_WORD = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_WORD = re.compile(rb"[\x30-\x39\x61-\x7A\x80-\xFF]+")
FEATURES = "doc_id long, n_words long, n_features long, buckets binary"
WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def stretches(text: bytes, ahead: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, how many of them are its own): a text in parts that end between words, each with the next ``ahead`` words."""
    at = 0
    while True:
        cut = _BREAK.search(text, at + CHUNK) if len(text) - at > CHUNK else None
        if not cut:
            yield text[at:], len(text) - at
            return
        end = cut.start()
        more = end
        for _ in range(ahead):
            word = _WORD.search(text, more)
            more = word.end() if word else len(text)
        yield text[at:more], end - at
        at = end


def suffix_order(words: np.ndarray, room: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first ``longest`` word ids, words that each shares with the one before it).

    ``room`` is how many words each suffix may take before its document ends; nothing is shared beyond it.
    """
    ahead = [np.where(room > k, np.append(words[k:], np.zeros(min(k, len(words)), words.dtype)), -1) for k in range(longest)]
    order = np.lexsort(ahead[::-1]) if longest > 1 else np.argsort(words, kind="stable")
    shared = np.zeros(len(words), np.int64)
    same = np.ones(max(0, len(words) - 1), bool)
    for column in ahead:
        column = column[order]
        same &= (column[1:] == column[:-1]) & (column[1:] >= 0)
        shared[1:] += same
    return order, shared


def block_buckets(parts: list[tuple[bytes, int]], owner: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features by part, features of each part, words of each part) of a block of stretches of text."""
    joined = b" ".join(p for p, _ in parts).translate(_LOWER) + b" "
    data = np.frombuffer(joined, np.uint8)
    edge = np.flatnonzero(np.diff(_IN_WORD[data].view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    first_byte = np.cumsum([0, *(len(p) + 1 for p, _ in parts)])
    part = np.searchsorted(first_byte, start, "right") - 1
    own = start - first_byte[part] < np.array([n for _, n in parts], np.int64)[part]
    ends = np.cumsum(np.bincount(part, minlength=len(parts)))
    room = ends[part] - np.arange(len(part))
    words = np.unique(span_hashes(data, start, end), return_inverse=True)[1].reshape(-1)
    order, shared = suffix_order(words, room, longest)
    found, features_of = [], []
    for k in range(1, longest + 1):
        valid = room[order] >= k
        places = order[valid]
        # of suffixes with k words those that share fewer with the one before begin a run
        new = shared[valid] < k
        heads = places[new]
        if k == 1:
            crc = [zlib.crc32(joined[a:b]) for a, b in zip(start[heads].tolist(), end[heads].tolist(), strict=True)]
        else:
            crc = [zlib.crc32(b" ".join(joined[a:b] for a, b in zip(start[i : i + k].tolist(), end[i : i + k].tolist(), strict=True))) for i in heads.tolist()]
        bucket = np.empty(len(part), np.uint32)
        bucket[places] = (np.array(crc, np.int64) % buckets)[np.cumsum(new) - 1] if len(places) else 0
        counted = np.flatnonzero(own & (room >= k))
        found.append(bucket[counted])
        features_of.append(part[counted])
    bucket, of = np.concatenate(found), np.concatenate(features_of)
    by_part = np.argsort(of, kind="stable")
    return bucket[by_part], np.bincount(of, minlength=len(parts)), np.bincount(part[own], minlength=len(parts))


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def featurise(texts: DataFrame, id_column: str, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features and ``buckets``, the bucket of every feature in 2 (4 for over 65536 buckets) bytes, of each text."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in text_chunks(batches, CHUNK):
            parts, owner = [], []
            for i, text in enumerate(own):
                for stretch in stretches(text.translate(_LOWER) if len(text) > CHUNK else text, longest - 1):
                    parts.append(stretch)
                    owner.append(i)
            held: list[list[bytes]] = [[] for _ in own]
            n_features, n_words = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            start = size = 0
            for i, (stretch, _) in enumerate(parts):
                size += len(stretch)
                if size < CHUNK and i + 1 < len(parts):
                    continue
                of = np.array(owner[start : i + 1])
                found, counts, words = block_buckets(parts[start : i + 1], of, longest, buckets)
                np.add.at(n_features, of, counts)
                np.add.at(n_words, of, words)
                ends = np.cumsum(counts)
                raw = found.astype(_width(buckets))
                for text, a, b in zip(of.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    held[text].append(raw[a:b].tobytes())
                start, size = i + 1, 0
            columns = [rows.column("doc_id").cast(pa.int64()), pa.array(n_words), pa.array(n_features), pa.array([b"".join(h) for h in held], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FEATURES.split(", ")])

    return texts.select(F.col(id_column).cast("long").alias("doc_id"), "text").mapInArrow(features, FEATURES)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; every task adds up its own first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("buckets").to_pylist()), _width(buckets)), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = features.select("buckets").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths, rounded down."""
    n = len(corpus)
    a, b = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1) * a / ((s + 1) * b))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    width = np.dtype(_width(len(gain))).itemsize

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("buckets").to_pylist()
            sums = np.concatenate([[0], np.cumsum(gain[np.frombuffer(b"".join(own), _width(len(gain)))])])
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) // width)
            weight = np.diff(sums[np.concatenate([[0], ends])])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight)], [x.split()[0] for x in WEIGHED.split(", ")])

    return features.mapInArrow(weigh, WEIGHED)


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3... for the ``most`` highest scores, ties to the smaller doc_id; null for the others.

    Ranges of scores are dealt to tasks, each numbers its own, and only the ranges' counts reach the driver.
    """
    spark = rows.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    # the id of a row is its partition's number in the high bits and its place there in the low 33
    placed = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    ahead, before = [], 0
    for r in sizes:
        ahead.append((r["part"], before))
        before += r["count"]
    # one row for each partition
    starts = F.broadcast(spark.createDataFrame(ahead, "part long, ahead long"))
    rank = F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(starts, "part").withColumn("rank", F.when(rank <= most, rank)).drop("part", "ahead", "at")


def resample(
    documents: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, target_id: str = "item_id"
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    features = materialize(featurise(documents, "doc_id", longest, buckets), "features")
    gain = gains(bucket_counts(features, buckets), bucket_counts(featurise(target, target_id, longest, buckets), buckets))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(share)))
    scored = weighed(features, gain).withColumn("score", F.col("weight") + noise)
    long_enough = F.col("n_words") >= least_words
    able = features.filter(long_enough).count()
    drawn = ranked(scored.filter(long_enough), percent * able // 100)
    others = scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")
