"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest. New rows are reduced to one candidate per
digest, an anti-join that merges the sorted buckets finds the digests not yet known, and these are
appended in the same layout, so neither the index nor its buckets are ever shuffled again. What a later batch
adds to a known digest is appended too, marked as no new text; reading merges the entries of a digest
within its bucket, so several batches give the groups that one batch of all rows would give. Batches leave
a file each in every bucket; ``compact`` makes them one sorted file again.

A batch has a name, and its entries count only once a manifest names the attempt that wrote them: a batch that failed half way leaves nothing
that is read, and one that is repeated after it was committed changes nothing. Compaction writes another folder and switches
to it by a manifest, so a driver lost at any time leaves one whole index. Of two writers one commits; the other raises Conflict and
can be repeated.

Defined results: null text counts as empty; empty texts equal each other; of equal texts in a batch
the row with the largest id wins, a null id losing to any other; a repeated row is kept once for
``keep_rows`` and each of its copies carries the same group. Texts of any length travel only as their digests.
Extra columns pass through untouched, whatever they are called (working columns take names that are free). An empty batch appends nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Conflict, Manifests
from .shared import attach_groups, flag_blank, materialize, scratch, shuffle_partitions, unused


__all__ = ["Conflict", "DigestIndex", "groups_of", "keep_rows", "mark_copies"]


class DigestIndex:
    """A digest table of ``buckets`` buckets at ``path`` (new unless it holds one already, which must have as many)."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or shuffle_partitions(spark)
        self.path = path or scratch(spark, "digests")
        self.manifests = Manifests(spark, f"{self.path}/versions")
        self.name = ""
        self._open()

    def _open(self) -> None:
        """Have the table of the last commit in the catalogue."""
        self.version, self.state = self.manifests.latest()
        if not self.state:
            self.state = {"folder": f"entries-{uuid.uuid4().hex}", "batches": {}, "buckets": self.buckets}
        if self.state["buckets"] != self.buckets:
            raise ValueError(f"the index has {self.state['buckets']} buckets, not {self.buckets}")
        if self.name and self.table_folder == self.state["folder"]:
            return
        self.drop()
        self.name, self.table_folder = self._table(self.state["folder"]), self.state["folder"]

    def _table(self, folder: str) -> str:
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, group_size BIGINT, fresh BOOLEAN, attempt STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )
        return name

    def _entries(self) -> DataFrame:
        """What committed attempts wrote; their number is that of the batches since the last compaction."""
        return self.spark.table(self.name).filter(F.col("attempt").isin(*set(self.state["batches"].values())))

    def known(self) -> DataFrame:
        """digest, keep_id, group_size of every text seen so far."""
        return self._entries().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def fresh_texts(self) -> DataFrame:
        """digest, attempt of the batch that brought each text first."""
        return self._entries().filter("fresh").select("digest", "attempt")

    def add(self, texts: DataFrame, id_column: str = "doc_id", text_column: str = "text", batch: str | None = None) -> bool:
        """Append one entry for every text of the batch; those that the index lacks are fresh. False if the batch is in the index already."""
        return self.add_digests(digested(texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))).drop("text"), batch)

    def add_digests(self, rows: DataFrame, batch: str | None = None) -> bool:
        """``add`` for rows of id and digest.

        The batch is aggregated and written first: the optimiser would push the anti-join below the
        aggregation, and copies would then travel before they are combined.
        """
        name, attempt = batch or uuid.uuid4().hex, uuid.uuid4().hex
        self._open()
        if name in self.state["batches"]:
            return False
        counted = rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        counted = materialize(counted, "batch").repartition(self.buckets, "digest")
        if self.state["batches"]:
            digests = self._entries().select("digest").hint("merge")
            fresh = counted.join(digests, "digest", "left_anti").withColumn("fresh", F.lit(True))
            again = counted.join(digests, "digest", "left_semi").withColumn("fresh", F.lit(False))
            counted = fresh.unionByName(again).repartition(self.buckets, "digest")
        else:
            counted = counted.withColumn("fresh", F.lit(True))
        counted.withColumn("attempt", F.lit(attempt)).sortWithinPartitions("digest").write.insertInto(self.name)
        self._commit({**self.state, "batches": {**self.state["batches"], name: attempt}})
        return True

    def compact(self) -> None:
        """One entry for each digest and one file for each bucket, in another folder, to which the index then switches; the old folder stays for readers."""
        self._open()
        folder, attempt = f"entries-{uuid.uuid4().hex}", uuid.uuid4().hex
        beside = self._table(folder)
        merged = self.known().withColumns({"fresh": F.lit(True), "attempt": F.lit(attempt)}).repartition(self.buckets, "digest")
        merged.sortWithinPartitions("digest").write.insertInto(beside)
        self.spark.sql(f"DROP TABLE {beside}")
        self._commit({**self.state, "folder": folder, "batches": {name: attempt for name in self.state["batches"]}})

    def _commit(self, state: dict) -> None:
        self.manifests.commit(self.version + 1, state)
        self.spark.catalog.refreshTable(self.name)
        self._open()

    def drop(self) -> None:
        """Take the table out of the catalogue; its files stay at ``path``."""
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digested(rows: DataFrame, column: str = "digest", text_column: str = "text") -> DataFrame:
    return rows.withColumn(column, F.unhex(F.sha2(flag_blank(F.col(text_column)), 256)))


def groups_of(documents: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, digest, keep_id and group_size of every document, by way of a digest index.

    Without an index of the caller's, a new one takes the documents in two batches, so that the second is merged with what the first left there.
    """
    own = index or DigestIndex(documents.sparkSession)
    rows = materialize(digested(documents.select(F.col("doc_id").alias("id"), "text")).drop("text"), "digests")
    if index is None:
        half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
        own.add_digests(rows.filter(half), "first")
        own.add_digests(rows.filter(~half), "second")
    else:
        own.add_digests(rows)
    groups = materialize(own.known(), "groups")
    if index is None:
        own.drop()
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    return attach_groups(rows.withColumnRenamed("id", "doc_id"), groups, ["digest"], "group_size", total)


def mark_copies(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return groups_of(documents).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_rows(documents: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns; of repeats of a winning row one stays."""
    index = DigestIndex(documents.sparkSession)
    index.add(documents)
    digest, number = unused("_digest", documents.columns), unused("_id", documents.columns)
    least = F.lit(-(1 << 63))
    winners = materialize(index.known().select(F.col("digest").alias(digest), F.coalesce("keep_id", least).alias(number)), "winners")
    index.drop()
    rows = digested(documents, digest).withColumn(number, F.coalesce("doc_id", least))
    return rows.join(winners, [digest, number], "left_semi").dropDuplicates([digest, number]).select(*documents.columns)
