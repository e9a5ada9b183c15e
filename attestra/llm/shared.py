"""What the operators have in common: the shared folder, skew-safe joins, word hashing, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A group is hot when it holds more than this share of all rows, so at most 1 / HOT_SHARE groups are hot.
HOT_SHARE = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a stored table in at least as many partitions as there are cores, as Spark cannot split the row groups of its files."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestra-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    The table survives lost executors. Collecting garbage afterwards lets Spark's cleaner delete
    the shuffle files that only the written plan needed.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def unused(name: str, columns: list[str]) -> str:
    """``name`` with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join each row with its group, whatever the size of the largest group.

    ``groups`` has one row per key with the number of ``rows`` in column ``size``; it should be a
    written table. Groups with more than HOT_SHARE of the ``total`` rows number at most 1000 and are
    broadcast; the rest meet by a shuffled join in which no key is large.
    """
    most = max(1.0, total * HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(size) > most).withColumn("_hot", F.lit(True)))
    cold = groups.filter(F.col(size) <= most)
    carried = [c for c in groups.columns if c not in key]
    tried = rows.join(hot, key, "left")
    found = tried.filter("_hot").drop("_hot")
    missed = tried.filter("_hot is null").drop("_hot", *carried)
    return found.unionByName(missed.join(cold, key, how))


def to_buckets(rows: DataFrame, parts: int) -> DataFrame:
    """Rows dealt by column ``bucket``, bucket b to partition b modulo ``parts``, and sorted by it."""
    return rows.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys in which null equals null; the keys of ``left`` remain."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_right_{k}" for k in keys])


def give_back() -> None:
    """Return what a worker has freed to the system; workers live on after a task, beside the workers of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim:
        trim(0)


@cache
def _libc() -> ctypes.CDLL:
    return ctypes.CDLL(None)


def text_chunks(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts in UTF-8) with at most ``most`` bytes of text unless one text is longer. Null is empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "").cast(pa.large_binary())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start).to_pylist()
            start = stop
    give_back()


#: Fixed values of the word rule: A-Z are lower-cased, and words are separated by these bytes.
SPACES = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_RANDOM = np.random.RandomState(20240229)
_BYTE = _RANDOM.randint(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = _RANDOM.randint(1, 1 << 63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 21:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte strings data[start:end]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_STEP, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_STEP_BACK, len(data))[start] + (end - start).astype(np.uint64))


class Words:
    """The words of some texts: their 64-bit hashes and their texts' numbers, in order."""

    def __init__(self, texts: list[bytes], prefixes: tuple[int, ...] = ()):
        joined = b" ".join(texts).translate(_LOWER) + b" "
        data = np.frombuffer(joined, np.uint8)
        space = _IS_SPACE[data]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_STEP, len(data)), out=sums[1:])
        back = powers(_STEP_BACK, len(data))[start]
        self.n = len(texts)
        self.hash = mix((sums[end] - sums[start]) * back + (end - start).astype(np.uint64))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.text = np.searchsorted(ends, start, "right")
        self.length = end - start
        self.prefix = {k: mix((sums[np.minimum(start + k, end)] - sums[start]) * back + np.uint64(k << 32)) for k in prefixes}
        self.counts = np.bincount(self.text, minlength=self.n)


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): for each text its distinct k-word shingles in order of hash, texts one after another.

    A text of 1 to k - 1 words has its whole sequence as one shingle; one without words has none.
    """
    words = Words(texts)
    m, at = len(words.hash), words.text
    parts, owners = [], []
    if m >= k:
        whole = np.zeros(m - k + 1, np.uint64)
        for i in range(k):
            whole += words.hash[i : m - k + 1 + i] * _PLACES[i]
        inside = at[: m - k + 1] == at[k - 1 :]
        parts.append(mix(whole[inside]))
        owners.append(at[: m - k + 1][inside])
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        first = np.cumsum(words.counts) - words.counts
        whole = _PLACES[32 + words.counts[short]].copy()
        for i in range(k - 1):
            has = words.counts[short] > i
            whole[has] += words.hash[first[short[has]] + i] * _PLACES[i]
        parts.append(mix(whole))
        owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(words.n, np.int64)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    if len(short):
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    ends = np.cumsum(np.bincount(owner, minlength=words.n))
    start = 0
    for end in ends.tolist():
        hashes[start:end].sort()
        start = end
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=words.n)


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Alternates the large-star and small-star steps of map-reduce connected components until the
    stars stand still; each step is written to the shared folder.
    """
    now = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).filter("a <> b")
    before = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select("a", F.col("low").alias("b")).union(small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct()
        seen = Observation()
        now = materialize(small.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), "edges")
        said = (seen.get["n"], seen.get["x"])
        if said == before or not said[0]:
            break
        before = said
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def flag_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
