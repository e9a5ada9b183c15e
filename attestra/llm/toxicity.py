"""Toxicity by non-negative positive-unlabelled learning.

Training data are documents labelled toxic and documents taken without their labels. The risk of a
classifier g is estimated as prior * R+(g) + max(0, Ru-(g) - prior * R+-(g)), where R+ is the loss of
positives, R+- their loss as negatives and Ru- the loss of unlabelled rows as negatives; when the
bracket falls below zero its gradient is reversed, which keeps a flexible model from overfitting.
The loss is logistic; as a few long texts can outweigh all others in it when toxic text is common, a
second model is fitted with the bounded sigmoid loss, and kept if its estimated errors are fewer beyond chance.

Features are the words of a text and their beginnings (so that a stem is learnt in languages that
inflect), hashed to BINS bins; a bin enters the model if positives hold it significantly more often than
unlabelled rows of the training sample, whatever share of these is toxic (if nearly all are, nothing tells them apart and no bin enters). A numpy logistic model of at most ``most_features`` bins is trained on at most ``most_positive`` and
``most_unlabelled`` rows, taken by hash of the id; the class prior is counted over all documents, and every whole text,
however long, is scored. Bins are counted and chosen by tasks; the driver gets the chosen bins, and of each training row the
columns among them, so at most (most_positive + most_unlabelled) * most_features numbers whatever the texts are.

Defined results: null text is empty and gets the score of a text without features; repeated rows get
equal scores; labels that are null, contradict each other (the largest counts) or name no document
are harmless; without any positive label every score is 0; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, materialize, text_chunks

BINS = 1 << 20
STEMS = (4, 5, 6)
#: Bytes of text read at a time.
CHUNK = 1 << 19
SCORED = "doc_id long, score double"


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bin) of each word and of each beginning of a longer word; repeats included."""
    words = Words(texts, STEMS)
    owner, bins = [words.text], [words.hash]
    for k in STEMS:
        longer = words.length > k
        owner.append(words.text[longer])
        bins.append(words.prefix[k][longer])
    return np.concatenate(owner), (np.concatenate(bins) & np.uint64(BINS - 1)).astype(np.int64)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_chunks(batches, CHUNK):
        owner, bins = features(texts)
        both = np.unique(owner * BINS + bins)
        ends = np.searchsorted(both, (np.arange(len(texts)) + 1) * BINS)
        start, out = 0, []
        for end in ends.tolist():
            out.append((both[start:end] % BINS).astype("<i4").tobytes())
            start = end
        yield pa.RecordBatch.from_arrays([rows.column("positive"), pa.array(out, pa.binary())], ["positive", "bag"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the bags of a task: how many of either kind there are (bin -1) and how many hold each bin."""
    rows, held = np.zeros(2, np.int64), np.zeros((2, BINS), np.int32)
    for batch in batches:
        for kind, bag in zip(batch.column("positive").to_pylist(), batch.column("bag").to_pylist(), strict=True):
            rows[kind] += 1
            held[kind, np.frombuffer(bag, "<i4")] += 1
    bins = np.flatnonzero(held.any(0))
    columns = [np.append(bins, -1), *(np.append(held[k, bins], rows[k]).astype(np.int64) for k in (1, 0))]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bin", "in_p", "in_u"])


def _entered(good: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bags as the columns of the bins that entered the model."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = np.full(BINS, -1, np.int32)
        where[good] = np.arange(len(good))
        for batch in batches:
            found = [where[np.frombuffer(bag, "<i4")] for bag in batch.column("bag").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array([f[f >= 0].astype("<i4").tobytes() for f in found], pa.binary())], ["positive", "columns"])

    return enter


def chosen_bins(bags: DataFrame, most_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(bins, positives and unlabelled rows that hold each, number of positives and of unlabelled rows).

    A bin is chosen if positives hold it significantly more often; of more than ``most_features`` those of most significance.
    """
    counts = materialize(bags.mapInArrow(_tally, "bin long, in_p long, in_u long").groupBy("bin").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u")), "bins")
    n_p, n_u = counts.filter("bin = -1").select("in_p", "in_u").first() or (0, 0)
    if not n_p or not n_u:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0), n_p, n_u
    rate_p, rate_u = F.col("in_p") / n_p, (F.col("in_u") + 0.5) / (n_u + 1)
    z = (rate_p - rate_u) / F.sqrt(rate_u * (1 - F.least(rate_u, F.lit(0.999))) * (1 / n_p + 1 / n_u) + 1e-9)
    rows = counts.filter("bin >= 0 and in_p >= 3").withColumn("z", z).filter("z > 5").orderBy(F.desc("z"), "bin").limit(most_features).select("bin", "in_p", "in_u").collect()
    found = np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1].astype(float), found[:, 2].astype(float), n_p, n_u


def _holding(strong: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the rows of a task: their number and how many hold each of some bins."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = np.full(BINS, -1, np.int32)
        where[strong] = np.arange(len(strong))
        rows, held = 0, np.zeros(len(strong), np.int64)
        for _, texts in text_chunks(batches, CHUNK):
            owner, bins = features(texts)
            found = where[bins]
            both = np.unique(owner[found >= 0] * len(strong) + found[found >= 0])
            held += np.bincount(both % len(strong), minlength=len(strong))
            rows += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([rows, *held.tolist()], pa.int64()), pa.array(range(-1, len(strong)), pa.int64())], ["n", "place"])

    return count


def rates_of(documents: DataFrame, strong: np.ndarray) -> np.ndarray:
    """The share of all documents that hold each of some bins."""
    found = documents.select("text").mapInArrow(_holding(strong), "n long, place long").groupBy("place").agg(F.sum("n").alias("n"))
    n = {r.place: r.n for r in found.collect()}
    return (np.array([n[k] for k in range(len(strong))]) + 0.5) / (n[-1] + 1)


class Rows:
    """A matrix of zeros and ones by the columns of the ones of each row."""

    __array_ufunc__ = None  # so that numpy leaves products to this class

    def __init__(self, columns: list[np.ndarray], width: int):
        self.shape = (len(columns), width)
        self.row = np.repeat(np.arange(len(columns), dtype=np.int32), [len(c) for c in columns])
        self.column = np.concatenate([*columns, np.zeros(0, np.int32)]).astype(np.int32)

    def __len__(self) -> int:
        return self.shape[0]

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.shape[0])

    def __rmatmul__(self, share: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, share[self.row], self.shape[1])


class Model:
    """Weights by bin and a bias; ``score`` is the logistic function of bias plus the weights of the bins present."""

    def __init__(self, bins: np.ndarray, weights: np.ndarray, bias: float):
        self.bins, self.weights, self.bias = bins, weights, bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        where = np.full(BINS, -1, np.int32)
        where[self.bins] = np.arange(len(self.bins))
        owner, bins = features(texts)
        found = where[bins]
        kept = found >= 0
        both = np.unique(owner[kept] * len(self.bins) + found[kept]) if len(self.bins) else np.zeros(0, np.int64)
        z = np.full(len(texts), self.bias)
        if len(both):
            z += np.bincount(both // len(self.bins), self.weights[both % len(self.bins)], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nnpu(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4, bounded: bool = False) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative positive-unlabelled risk with the logistic or the (bounded) sigmoid loss (Adam)."""
    n = x_p.shape[1]
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    mean = lambda share, x: np.append((share @ x).astype(float), float(share.sum())) / len(x)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        single = w[:n].astype(np.float32)
        gp, gu = (x_p @ single).astype(float) + w[n], (x_u @ single).astype(float) + w[n]
        known, open_ = sigmoid(gp).astype(np.float32), sigmoid(gu).astype(np.float32)
        if bounded:
            rest = float(open_.mean()) - prior * float(known.mean())
            known, open_ = known * (1 - known), open_ * (1 - open_)
            up = -prior * mean(known, x_p)
        else:
            rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            up = -prior * mean(1 - known, x_p)
        down = mean(open_, x_u) - prior * mean(known, x_p)
        slope = up + down if rest >= 0 else -down
        slope[:n] += decay * w[:n]
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w[:n], float(w[n])


def errors(x_p: np.ndarray, x_u: np.ndarray, prior: float, weights: np.ndarray, bias: float) -> float:
    """The estimated share of wrong decisions."""
    found_p, found_u = ((x @ weights.astype(np.float32) + bias >= 0).mean() for x in (x_p, x_u))
    return prior * (1 - found_p) + max(0.0, found_u - prior * found_p)


def train(
    documents: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 8000, prior: float | None = None, most_features: int = 2000
) -> Model | None:
    """A model from confirmed positives and unlabelled documents; None without positives."""
    flags = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("doc_id is not null and toxic is not null")
    order = F.xxhash64("doc_id", F.lit(7))
    positive = flags.filter("toxic > 0").select("doc_id").join(documents.select("doc_id"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(most_positive).withColumn("positive", F.lit(1))
    others = documents.filter("doc_id is not null").select("doc_id").orderBy(order, "doc_id").limit(most_unlabelled).distinct().withColumn("positive", F.lit(0))
    # both lists are bounded by the parameters
    chosen = F.broadcast(positive.unionByName(others))
    bags = materialize(documents.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(_bags, "positive int, bag binary"), "bags")
    good, in_p, in_u, n_p, n_u = chosen_bins(bags, most_features)
    if not n_p or not n_u:
        return None
    if not len(good):
        return Model(good, np.zeros(0), -5.0)
    if not prior:
        prior = class_prior(good, in_p, in_u, n_p, n_u, lambda strong: rates_of(documents, strong))
    columns: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for r in bags.mapInArrow(_entered(good), "positive int, columns binary").collect():
        columns[r["positive"]].append(np.frombuffer(r["columns"], "<i4"))
    return Model(good, *fit(Rows(columns[1], len(good)), Rows(columns[0], len(good)), prior))


def class_prior(good: np.ndarray, in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, rates: Callable[[np.ndarray], np.ndarray]) -> float:
    """The share of positives among all documents.

    A bin that negatives hardly hold is as much rarer among all rows than among positives as positives are rare, so
    the bins whose ratio is surely lowest give it. ``rates`` gives the shares of all documents that hold some bins.
    """
    rate_p, rate_u = in_p / n_p, (in_u + 0.5) / (n_u + 1)
    # the ratio of rates with two standard errors of its logarithm
    surely = np.log(rate_u / rate_p) + 2 * np.sqrt(1 / in_p + 1 / (in_u + 0.5))
    strong = np.argsort(surely, kind="stable")[:20]
    return float(np.clip(rates(good[strong]).sum() / rate_p[strong].sum(), 1e-6, 0.999))


def fit(x_p: Rows, x_u: Rows, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias from the rows of positive and of unlabelled texts."""
    logistic, sigmoid = (nnpu(x_p, x_u, prior, bounded=b) for b in (False, True))
    chance = 2 * np.sqrt(0.25 / len(x_u) + 0.25 * prior**2 / len(x_p))  # two standard errors at most
    fewer = errors(x_p, x_u, prior, *sigmoid) + chance < errors(x_p, x_u, prior, *logistic)
    return sigmoid if fewer else logistic


def _scorer(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches, CHUNK):
            found = model.scores(texts) if model else np.zeros(len(texts))
            columns = [rows.column(c) for c in rows.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], [*(c for c in rows.schema.names if c != "text"), "score"])

    return score


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every document."""
    return documents.select("doc_id", "text").mapInArrow(_scorer(model), SCORED)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def assess(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; the model never sees labels of held-out rows."""
    model = train(documents, labels.filter(~held_out()))
    return score(documents, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def clean_rows(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents scored below ``threshold``, with their own columns."""
    model = train(documents, labels.filter(~held_out()))
    kinds = documents.schema
    kept = documents.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches, CHUNK):
            found = model.scores(texts) if model else np.zeros(len(texts))
            yield rows.filter(pa.array(found < threshold)).select(kept)

    return documents.mapInArrow(keep, kinds)
