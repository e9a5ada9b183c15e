"""Exports with provenance: CSV, JSON, JSON lines and a Markdown report."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import csv_safe

#: Rows of one exported document, which passes through the driver; larger datasets are written by ``write``.
MOST_ROWS = 5000
PROVENANCE = ("verification_status", "url", "retrieved_at")


def flat(cells: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each record: its fields, then each provenance column joined by bars in the order of the fields."""
    wide = cells.groupBy("record_id").agg(*[F.max(F.when(F.col("field") == f, F.struct("value", *PROVENANCE))).alias(f) for f in fields])
    bars = [F.concat_ws("|", *[F.coalesce(F.col(f)[p].cast("string"), F.lit("")) for f in fields]).alias(f"_{p}") for p in PROVENANCE]
    return wide.select("record_id", *[csv_safe(F.col(f)["value"]).alias(f) for f in fields], *bars)


def write(rows: DataFrame, path: str, kind: str) -> None:
    """A dataset of any size as a folder of files."""
    writer = rows.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "jsonl":
        writer.json(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def export(rows: DataFrame, kind: str, order: str = "record_id", title: str = "Dataset") -> str:
    """A document of at most MOST_ROWS rows; a larger dataset is refused, never cut. An empty dataset is an error but for a report."""
    found = [r.asDict(recursive=True) for r in rows.orderBy(order).limit(MOST_ROWS + 1).toLocalIterator()]
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: write them as files")
    if not found and kind != "md":
        raise ValueError("nothing to export")
    if kind == "csv":
        out = io.StringIO()
        sheet = csv.DictWriter(out, list(found[0]), lineterminator="\n")
        sheet.writeheader()
        sheet.writerows(found)
        return out.getvalue()
    if kind == "json":
        return json.dumps(found, ensure_ascii=False, default=str)
    if kind == "jsonl":
        return "".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in found)
    if kind == "md":
        head = [f"# {title}", "", f"{len(found)} records", ""]
        if found:
            names = list(found[0])
            cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
            head += ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
            head += ["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in found]
        return "\n".join(head) + "\n"
    raise ValueError(f"unknown kind {kind!r}")
