"""WARC archives written and read by Spark, with boundary-chain verification.

Writing: each task's records become one archive through the text writer, whose line separator closes
a record. Equal payloads are stored once: the page with the smallest id is a response, the others
are revisit records that refer to it.

Reading: archives are split at every occurrence of the version line, also inside a split file, which
gives candidate records. Each candidate parses its header and names the offset of its successor. From
the start of each file, pointers are doubled until they reach the end: a candidate stays only if the
chain from the file's start reaches it. A version line inside a payload starts no record, and its
bytes go back into the payload that it interrupted.

Defined results: null html is empty; null urls leave out the target; line breaks in urls are escaped;
repeated rows get a record each; an empty table gives no rows; other columns are ignored. Damaged records
(no length, a length past the end) end their chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import attach_groups, flag_blank, materialize, scratch

#: Records of an archive. Gzip cannot be split, so an archive is one task's to read.
MOST_RECORDS = 20_000
#: Fixed values of the format.
VERSION = "WARC/1.1\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: 5 hexadecimal digits make 4 characters."""
    hexed = F.sha1(payload)
    out = []
    for i in range(8):
        value = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(_BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame) -> DataFrame:
    """page_id, digest, kept_id and the text of each page's record, without the line break that ends it."""
    rows = pages.select("page_id", "url", flag_blank(F.col("html")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html")))
    groups = materialize(rows.groupBy("digest").agg(F.min("page_id").alias("kept_id"), F.count("*").alias("n")), "payloads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    rows = attach_groups(rows, groups, ["digest"], "n", total)
    response = F.col("page_id").eqNullSafe(F.col("kept_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(_HTTP), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(response, F.concat(http, F.col("html"))).otherwise(http)
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(VERSION), line("WARC-Type", F.when(response, "response").otherwise("revisit")), line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(_DATE)), F.coalesce(line("WARC-Target-URI", url), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(response, "").otherwise(F.concat(line("WARC-Refers-To", name(F.col("kept_id"))), line("WARC-Profile", F.lit(_PROFILE)))),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select("page_id", "digest", "kept_id", F.concat(header, F.lit("\r\n"), block, F.lit("\r\n")).alias("record"))


def write(pages: DataFrame, path: str | None = None) -> str:
    """Write gzipped archives of at most MOST_RECORDS for ``pages``; returns their folder."""
    path = path or scratch(pages.sparkSession, "warc")
    records(pages).select("record").write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", MOST_RECORDS).text(path)
    return path


def candidates(spark: SparkSession, path: str, keep_all: bool = False) -> DataFrame:
    """Everything that follows a version line: file, at (byte offset), header, next, payload figures and, where needed, the raw bytes.

    ``next`` is the offset of the successor that the header's length implies. ``whole`` says that the
    candidate ends exactly there; then its payload's digest and size are computed at once and the raw
    text is dropped unless ``keep_all``. Offsets come from lengths added up within each part of a file
    and over its parts.
    """
    field = lambda name: F.regexp_extract(F.concat(F.lit("\r\n"), F.col("header"), F.lit("\r\n")), rf"(?i)\r\n{name}: *([^\r\n]*)\r\n", 1)
    cut = spark.read.option("lineSep", VERSION).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("seq"),
    )
    cut = cut.withColumn("split", F.instr("value", "\r\n\r\n"))
    cut = cut.withColumn("header", F.when(F.col("split") > 0, F.expr("substr(value, 1, split - 1)")).otherwise(""))
    cut = cut.withColumn("body", F.when(F.col("split") > 0, F.expr("substr(value, split + 4)")))
    stated = field("Content-Length")
    cut = cut.withColumn("length", F.when(stated.rlike("^[0-9]{1,18}$"), stated.cast("long")))
    cut = cut.withColumn("whole", F.coalesce((F.octet_length("body") == F.col("length") + 4) & F.col("body").endswith("\r\n\r\n"), F.lit(False)))
    payload = payload_of(F.expr("left(body, length(body) - 4)"))
    cut = cut.withColumn("payload", F.when(F.col("whole"), payload))
    raw = F.col("value") if keep_all else F.when(~F.col("whole"), F.col("value"))
    cut = cut.select(
        "file", "part", "seq", (F.octet_length("value").cast("long") + len(VERSION)).alias("bytes"), "length", "whole",
        F.octet_length("header").alias("header_bytes"), F.octet_length("payload").cast("long").alias("stored_bytes"), base32_sha1(F.col("payload")).alias("stored_digest"),
        *[field(n).alias(c) for n, c in (("WARC-Type", "type"), ("WARC-Record-ID", "id"), ("WARC-Target-URI", "url"), ("WARC-Payload-Digest", "digest"), ("WARC-Refers-To", "refers_to"))],
        raw.alias("raw"), *([F.col("payload")] if keep_all else []),
    )
    cut = materialize(cut, "cut")
    parts = cut.groupBy("file", "part").agg(F.sum("bytes").alias("part_bytes"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("part_at"))
    within = Window.partitionBy("file", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("ahead", F.coalesce(F.sum("bytes").over(within), F.lit(0))).join(parts, ["file", "part"])
    # what precedes the first version line has no offset of its own
    placed = placed.withColumn("at", F.col("part_at") + F.col("ahead") - len(VERSION)).filter("at >= 0")
    return placed.withColumn("next", F.col("at") + len(VERSION) + F.col("header_bytes") + 4 + F.col("length") + 4).drop("ahead", "part_at", "bytes", "seq", "part")


def payload_of(block: Column) -> Column:
    """What follows the HTTP header of a record's block."""
    return F.substring(block, F.instr(block, "\r\n\r\n") + 4, F.lit(2**31 - 1))


def chain(links: DataFrame) -> DataFrame:
    """(file, at) of the rows of ``links`` (file, at, next) that the chain from offset 0 of their file reaches.

    Candidates that each name the one behind them form a run, and nothing outside points into it but at its head: a candidate that a distant
    pointer names begins a run. Runs are found in one pass over a file, and pointer jumping joins them: after k rounds every pointer
    spans 2 ** k runs and every run within that many of the start is marked. Without version lines in payloads a file is one run.
    """
    order = Window.partitionBy("file").orderBy("at")
    seen = materialize(links.select("file", "at", "next").withColumns({"behind": F.lead("at").over(order), "named": F.lag("next").over(order)}), "pointers")
    distant = seen.filter("next is not null and not (next <=> behind)").select("file", F.col("next").alias("at")).distinct().withColumn("aimed", F.lit(True))
    head = F.coalesce(F.col("named") != F.col("at"), F.lit(True)) | F.col("aimed").isNotNull()
    up_to_here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = materialize(seen.join(distant, ["file", "at"], "left").select("file", "at", "next", F.sum(head.cast("long")).over(up_to_here).alias("run")), "runs")
    runs = placed.groupBy("file", "run").agg(F.min("at").alias("at"), F.max_by("next", "at").alias("next"))
    known = materialize(runs, "heads")
    reached = known.filter("at = 0").select("file", "at")
    jumps = known.join(known.select("file", F.col("at").alias("next")), ["file", "next"]).select("file", "at", "next")
    most = known.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most - 1).bit_length() if most else 0):
        jumps = materialize(jumps, "jumps")
        reached = materialize(reached.union(reached.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))).distinct(), "reached")
        onward = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        jumps = jumps.join(onward, ["file", "next"]).select("file", "at", F.col("after").alias("next"))
    on_chain = known.join(reached, ["file", "at"], "left_semi").select("file", "run")
    return placed.join(on_chain, ["file", "run"], "left_semi").select("file", "at")


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """type, id, url, digest, refers_to, stored_bytes, stored_digest (and payload) of every true record of the archives in ``path``."""
    found = materialize(candidates(spark, path, payloads), "links")
    true = materialize(chain(found), "true").withColumn("on_chain", F.lit(True))
    found = found.join(true, ["file", "at"], "left").withColumn("on_chain", F.coalesce("on_chain", F.lit(False)))
    if not payloads and not found.filter("not on_chain and whole").isEmpty():
        # a complete record inside a payload: its bytes are needed after all
        return read(spark, path, True).drop("payload")
    columns = ["type", "id", "url", "digest", "refers_to", "stored_bytes", "stored_digest", *(["payload"] if payloads else [])]
    sound = found.filter("on_chain and whole").select(*columns)
    # a record that version lines interrupt is put together from the candidates up to its successor
    parted = found.filter("not (on_chain and whole)")
    owner = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parted = parted.withColumn("owner", F.last(F.when(F.col("on_chain"), F.col("at")), ignorenulls=True).over(owner)).filter("owner is not null")
    own = parted.filter("on_chain")
    pieces = parted.groupBy("file", F.col("owner").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["raw"]), VERSION)
    joined = own.drop("payload", "stored_bytes", "stored_digest").join(pieces, ["file", "at"]).withColumn("text", text)
    body = F.expr("substr(text, instr(text, '\r\n\r\n') + 4)")
    joined = joined.withColumn("body", body).filter(F.octet_length("body") == F.col("length") + 4).withColumn("payload", payload_of(F.expr("left(body, length(body) - 4)")))
    joined = joined.withColumn("stored_bytes", F.octet_length("payload").cast("long")).withColumn("stored_digest", base32_sha1(F.col("payload")))
    return sound.unionByName(joined.select(*columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages``, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    A revisit record's payload is the one of the response that it refers to.
    """
    spark = pages.sparkSession
    found = materialize(read(spark, write(pages)), "records")
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1)
    page = lambda c: F.when(number(F.col(c)) != "", number(F.col(c)).cast("long"))
    found = found.withColumns({"page_id": page("id"), "target": page("refers_to")})
    responses = found.filter("type = 'response'").select(
        "page_id", "digest", F.col("stored_bytes").alias("payload_bytes"), F.col("stored_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), (F.concat(F.lit("sha1:"), F.col("stored_digest")) == F.col("digest")).alias("verified"),
    )
    revisits = found.filter("type = 'revisit'").select("page_id", "target", "digest")
    # a repeated row is a response again: one of equal ones is enough
    stored = responses.select(F.col("page_id").alias("target"), "digest", "payload_bytes", "payload_digest").dropDuplicates(["target", "digest"])
    groups = materialize(revisits.groupBy("target", "digest").agg(F.count("*").alias("n")).join(stored, ["target", "digest"]), "targets")
    total = groups.agg(F.sum("n")).first()[0] or 0
    resolved = attach_groups(revisits, groups, ["target", "digest"], "n", total).select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("target").alias("refers_to"),
        (F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("digest")).alias("verified"),
    )
    return responses.drop("digest").unionByName(resolved)
