"""An append log of JSON lines as a data source with offsets: batches and streams read byte ranges of its files, each line once.

The offset of a stream is how many bytes of each file have been read, up to the last whole line, so lines appended to a file that was read before are
found, and a restart goes on where the checkpoint says. A partition is a range of at most ``most_bytes`` of one file; a line belongs to the range in
which it starts. Lines are parsed by Spark; those that are no JSON of the schema are rows of a table of their own, with file, offset and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from .versions import VersionedTables

LINES = "file string, start long, line string"
#: Bytes of a partition, and read at a time.
MOST_BYTES = 32 << 20
STEP = 1 << 20


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def whole_lines(path: str) -> dict[str, int]:
    """The files of a log and their bytes up to the last line end; a line that is still being written waits."""
    from pyarrow import fs

    system, root = _open(path)
    found = {}
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        name = info.path.rsplit("/", 1)[-1]
        if info.type != fs.FileType.File or name.startswith(("_", ".")) or not info.size:
            continue
        with system.open_input_file(info.path) as f:
            end = info.size
            while end:
                start = max(0, end - STEP)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                end = start + at + 1 if at >= 0 else start
                if at >= 0:
                    break
        if end:
            found[info.path] = end
    return found


def ranges(before: dict[str, int], now: dict[str, int], most_bytes: int) -> list[Range]:
    """What lies between two offsets, in ranges of at most ``most_bytes``."""
    return [Range(f, a, min(a + most_bytes, end)) for f, end in sorted(now.items()) for a in range(before.get(f, 0), end, most_bytes)]


def lines_of(path: str, part: Range, ends_at: int | None = None) -> Iterator[tuple[str, int, str]]:
    """(file, start, line) of the lines that start in a range; blank ones are skipped. The last may end beyond the range."""
    system, _ = _open(path)
    with system.open_input_file(part.file) as f:
        # a line that starts before the range is another's: the byte before tells
        at = part.start
        if at:
            f.seek(at - 1)
            at = _next_line(f, at - 1)
        f.seek(at)
        rest = b""
        while at < part.end:
            block = f.read(STEP)
            if not block:
                break
            rest += block
            *whole, rest = rest.split(b"\n")
            for line in whole:
                if at >= part.end:
                    return
                if line.strip():
                    yield part.file, at, line.decode("utf-8", "replace")
                at += len(line) + 1


def _next_line(f, at: int) -> int:
    """Where the first line after a place starts."""
    while block := f.read(STEP):
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return at


class _Reader(DataSourceReader):
    def __init__(self, path: str, most_bytes: int):
        self.path, self.most_bytes = path, most_bytes

    def partitions(self) -> list[Range]:
        return ranges({}, whole_lines(self.path), self.most_bytes)

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_of(self.path, partition) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, most_bytes: int):
        self.path, self.most_bytes = path, most_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return whole_lines(self.path)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.most_bytes)

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_of(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for an offset: the log keeps its lines."""


class EventLog(DataSource):
    """Options: path, and most_bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return LINES

    def _arguments(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("most_bytes", MOST_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._arguments())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(*self._arguments())


def lines(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, stream: bool = False) -> DataFrame:
    """The lines of a log, as a table or as a stream."""
    spark.dataSource.register(EventLog)
    source = spark.readStream if stream else spark.read
    return source.format("event_log").option("path", path).option("most_bytes", most_bytes).load()


def parsed(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(events, malformed): the columns of ``schema`` with file and start, and the lines that do not have its form, with the reason."""
    whole = rows.withColumn("_e", F.from_json("line", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    # an object that has none of the columns says as little as no object
    names = [f for f in whole.schema["_e"].dataType.names if f != "_broken"]
    empty = F.forall(F.array(*[F.col("_e")[n].isNull() for n in names]), lambda x: x)
    reason = F.when(F.col("_e._broken").isNotNull() | F.col("_e").isNull(), "no JSON of the schema").when(empty, "none of the columns")
    told = whole.withColumn("reason", reason)
    return told.filter("reason is null").select("file", "start", *[F.col("_e")[n].alias(n) for n in names]), told.filter("reason is not null").select("file", "start", "line", "reason")


def keep(log: DataFrame, schema: str, store: VersionedTables, checkpoint: str, seen: Callable[[int, int, int], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Append a stream of lines to ``events`` and ``malformed`` of a store, both in one commit for each micro-batch.

    A batch that is repeated after a failure is in the store already and changes nothing. ``seen`` is told (batch, events, malformed).
    """

    def write(batch: DataFrame, number: int) -> None:
        good, bad = parsed(batch.persist(), schema)
        try:
            store.append({"events": good, "malformed": bad}, f"{checkpoint}#{number}")
            if seen is not None:
                seen(number, good.count(), bad.count())
        finally:
            batch.unpersist()

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
