"""Hard negatives by a vector-approximation file.

Components become integers, floor(256 x), and scores integer inner products. Each dimension is quantised into at most 256
cells of equal width, so a row's approximation is one byte a dimension. For an anchor a table gives the least that each
cell of each dimension can add to the score; summed over the dimensions this is a lower bound, and the upper bound is
larger by the widths of the cells times the anchor's components. Only rows whose bounds say that they may be among the
wanted ones are scored exactly.

1. Rows are dealt to blocks of at most about ``ROWS``, sorted by label, and anchors to groups of about ``ANCHORS``. A task
   takes one block and one group, so every anchor meets all rows, and no task holds more than these.
2. Positives: the rows of the anchor's label whose upper bound reaches the fifth lower bound are scored; each block gives its
   best five, and the best of these are the anchor's.
3. Negatives: each positive opens a window of scores. Rows of other labels whose bounds meet a window, and reach the third
   lower bound among the rows that lie in it for certain, are scored; the best three of all blocks are returned.

Defined results: rows with a null id, label or vector, or with a component that is null or not finite, take no part; nor do
those with a component beyond 2**18 (2**26 as an integer), whose scores need not fit 64 bits. Rows that repeat an id are one
row, the one with the least label and vector. Vectors of different lengths are compared as if the shorter ended in zeros. Ties
go to the smaller id. An anchor without positives, or a positive with an empty window, gives no rows; so does an empty
table. Other columns are ignored. A hot label, or one vector for a third of all rows, is spread over the blocks like any rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, to_buckets

#: Rows of a block and anchors of a group, at most on average; cells of a dimension; the largest component.
ROWS = 1 << 15
ANCHORS = 1 << 12
CELLS = 256
LARGEST = 1 << 26
#: Rows whose bounds are summed at a time.
STEP = 2048

VECTORS = "vec_id long, label long, v binary"
EDGES = "dim int, low long, high long"
BLOCK = "bucket long, kind int, ids binary, labels binary, vectors binary, extra binary"
MET = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with their components as 32-bit integers."""
    for batch in batches:
        vectors = batch.column("embedding")
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(256 * flat)
        bad = ~(np.abs(scaled) <= LARGEST)
        lost = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[bad], minlength=len(sizes)) > 0
        raw = np.where(bad, 0, scaled).astype("<i4")
        ends = np.cumsum(sizes)
        kept = np.flatnonzero(~lost & vectors.is_valid().to_numpy(zero_copy_only=False))
        own = [raw[a:b].tobytes() for a, b in zip((ends - sizes)[kept].tolist(), ends[kept].tolist(), strict=True)]
        at = pa.array(kept)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(own, pa.binary())], ["vec_id", "label", "v"])


def vectors_of(embeddings: DataFrame, label_noise: bool = True) -> DataFrame:
    """A written table of vec_id, label, v of the rows that take part; with ``label_noise`` every seventh id has the next label."""
    label = F.col("label").cast("long")
    if label_noise:
        label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    able = embeddings.filter("vec_id is not null and label is not null and embedding is not null")
    rows = able.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding").mapInArrow(_integers, VECTORS)
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
    return materialize(once.select("vec_id", "x.label", "x.v"), "vectors")


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low, high = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for raw in set(batch.column("v").to_pylist()):
            v = np.frombuffer(raw, "<i4").astype(np.int64)
            if len(v) > len(low):
                low, high = (np.concatenate([x, np.zeros(len(v) - len(x), np.int64)]) for x in (low, high))
            np.minimum(low[: len(v)], v, out=low[: len(v)])
            np.maximum(high[: len(v)], v, out=high[: len(v)])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], [x.split()[0] for x in EDGES.split(", ")])


def grid(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(lower edge of the first cell, width of the cells) of each dimension; 0, the end of a shorter vector, is inside."""
    rows = vectors.select("v").mapInArrow(_extent, EDGES).groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    rows = sorted(rows)
    low, high = (np.array([r[k] for r in rows], np.int64) for k in ("low", "high"))
    return low, -(-(high - low + 1) // CELLS)


def _blocker(dims: int, kind: int, extra: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes one row of all rows of a bucket: ids, labels, vectors, sorted by label and id."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def made() -> pa.RecordBatch:
            rows = sorted(held)
            matrix = np.zeros((len(rows), dims), "<i4")
            for i, r in enumerate(rows):
                v = np.frombuffer(r[2], "<i4")
                matrix[i, : len(v)] = v
            more = np.concatenate([np.frombuffer(r[3], "<i8") for r in rows]) if extra else np.zeros(0, "<i8")
            values = [now, kind, np.array([r[1] for r in rows], "<i8").tobytes(), np.array([r[0] for r in rows], "<i8").tobytes(), matrix.tobytes(), more.tobytes()]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "label", "vec_id", "v", *(["extra"] if extra else []))]
            for bucket, *row in zip(*columns, strict=True):
                if bucket != now and held:
                    yield made()
                    held = []
                now = bucket
                held.append(tuple(row))
        if held:
            yield made()

    return block


def blocks(rows: DataFrame, count: int, dims: int, kind: int, extra: bool = False) -> DataFrame:
    """A written table with one row for each of ``count`` blocks of ``rows`` (vec_id, label, v and, if ``extra``, 64-bit numbers)."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("vec_id"), F.lit(count)))
    columns = ["bucket", "label", "vec_id", "v", *(["extra"] if extra else [])]
    return materialize(to_buckets(dealt.select(*columns), count).mapInArrow(_blocker(dims, kind, extra), BLOCK), "blocks")


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:most]


def reached(lower: np.ndarray, most: int) -> int:
    """The ``most``-th largest lower bound: what falls short of it for certain is not wanted; the least number if there are fewer."""
    return int(np.partition(lower, len(lower) - most)[len(lower) - most]) if len(lower) >= most else -(1 << 62)


class Approximated:
    """A block of rows: exact vectors, and the cells by which bounds are looked up."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, low: np.ndarray, width: np.ndarray):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.exact = np.frombuffer(vectors, "<i4").reshape(len(self.ids), len(low))
        self.low, self.width = low, width
        # places in a table of all dimensions' cells
        self.cells = (self.exact - low) // width + CELLS * np.arange(len(low))

    def slices(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))

    def lower(self, anchor: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, int]:
        """(lower bounds of the rows from start to stop, how far above them the upper bounds are)."""
        first = self.low[:, None] + self.width[:, None] * np.arange(CELLS)
        table = np.where(anchor[:, None] >= 0, anchor[:, None] * first, anchor[:, None] * (first + self.width[:, None] - 1))
        # four bytes where no sum can need more
        small = int(np.abs(table).max(1, initial=0).sum()) < 1 << 31
        table = table.ravel().astype(np.int32 if small else np.int64)
        out = np.zeros(stop - start, np.int64)
        for a in range(start, stop, STEP):
            b = min(stop, a + STEP)
            out[a - start : b - start] = table.take(self.cells[a:b], mode="wrap").sum(1, dtype=table.dtype) if len(anchor) else 0
        return out, int((np.abs(anchor) * (self.width - 1)).sum())

    def scores(self, anchor: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self.exact[places].astype(np.int64) @ anchor


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(block of rows, group of anchors) of each bucket that has both; buckets come in order."""
    now, held = None, {}
    for batch in batches:
        for bucket, kind, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                now, held = bucket, {}
            held[kind] = rest
            if len(held) == 2:
                yield held[0], held[1]


def _met(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in MET.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def _positives(low: np.ndarray, width: np.ndarray, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, anchors in _cells(batches):
            block, group, out = Approximated(*rows[:3], low, width), Approximated(*anchors[:3], low, width), []
            for i, (name, label) in enumerate(zip(group.ids.tolist(), group.labels.tolist(), strict=True)):
                anchor = group.exact[i].astype(np.int64)
                start, stop = block.slices(label)
                lower, gap = block.lower(anchor, start, stop)
                others = block.ids[start:stop] != name
                may = np.flatnonzero(others & (lower + gap >= reached(lower[others], most))) + start
                scores = block.scores(anchor, may)
                out += [(name, None, None, int(block.ids[may[k]]), int(scores[k])) for k in best(scores, block.ids[may], most)]
            if out:
                yield _met(out)

    return find


def _negatives(low: np.ndarray, width: np.ndarray, positives: int, most: int, shares: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, anchors in _cells(batches):
            block, group, out = Approximated(*rows[:3], low, width), Approximated(*anchors[:3], low, width), []
            windows = np.frombuffer(anchors[3], "<i8").reshape(len(group.ids), positives, 3)
            for i, (name, label) in enumerate(zip(group.ids.tolist(), group.labels.tolist(), strict=True)):
                anchor = group.exact[i].astype(np.int64)
                start, stop = block.slices(label)
                before, gap = block.lower(anchor, 0, start)
                after, _ = block.lower(anchor, stop, len(block.ids))
                lower = np.concatenate([before, after])
                places = np.append(np.arange(start), np.arange(stop, len(block.ids)))
                asked = [(int(p), int(s), -(-shares[0] * int(s) // 100), shares[1] * int(s) // 100) for p, s, held in windows[i].tolist() if held]
                may = np.zeros(len(lower), bool)
                for _, _, least, largest in asked:
                    if least > largest:
                        continue
                    some = (lower + gap >= least) & (lower <= largest)
                    sure = lower[some & (lower >= least) & (lower + gap <= largest)]
                    may |= some & (lower + gap >= reached(sure, most))
                places = places[may]
                scores, ids = block.scores(anchor, places), block.ids[places]
                for positive, score, least, largest in asked:
                    inside = np.flatnonzero((scores >= least) & (scores <= largest))
                    for k in inside[best(scores[inside], ids[inside], most)].tolist():
                        out.append((name, positive, score, int(ids[k]), int(scores[k])))
            if out:
                yield _met(out)

    return find


def mine(
    embeddings: DataFrame, anchor_every: int = 50, positives: int = 5, negatives: int = 3, shares: tuple[int, int] = (50, 95), label_noise: bool = True
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives score between ``shares[0]`` and ``shares[1]`` hundredths of the positive's score.
    """
    spark = embeddings.sparkSession
    vectors = vectors_of(embeddings, label_noise)
    low, width = grid(vectors)
    anchors = vectors.filter(F.col("vec_id") % anchor_every == 0)
    n_rows, n_anchors = vectors.count(), anchors.count()
    n_groups = max(1, -(-n_anchors // ANCHORS))
    # where the table is small, smaller blocks make twice as many tasks as there are cores
    n_blocks = max(1, -(-n_rows // ROWS), min(-(-2 * spark.sparkContext.defaultParallelism // n_groups), n_rows // 512))
    dealt = blocks(vectors, n_blocks, len(low), 0)
    wide = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    wide = wide.select((F.col("bucket") * n_groups + F.col("group")).alias("bucket"), *dealt.columns[1:])

    def meet(groups: DataFrame, find: Callable) -> DataFrame:
        copied = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        copied = copied.select((F.col("block") * n_groups + F.col("bucket")).alias("bucket"), *groups.columns[1:])
        return to_buckets(wide.unionByName(copied), n_blocks * n_groups).mapInArrow(find, MET)

    near = meet(blocks(anchors, n_groups, len(low), 1), _positives(low, width, positives))
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    found = near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= positives)
    # at most ``positives`` numbers of three for each anchor: id, score, 1
    listed = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = []
            for own in batch.column("found").to_pylist():
                three = np.zeros((positives, 3), "<i8")
                for i, x in enumerate(own):
                    three[i] = x["vec_id"], x["score"], 1
                extra.append(three.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("anchor_id"), pa.array(extra, pa.binary())], ["vec_id", "extra"])

    windows = listed.mapInArrow(packed, "vec_id long, extra binary")
    asking = blocks(anchors.join(windows, "vec_id"), n_groups, len(low), 1, extra=True)
    far = meet(asking, _negatives(low, width, positives, negatives, shares))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    return far.withColumn("rank", rank).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
