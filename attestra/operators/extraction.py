"""Reading fields from pages in stages, and learning where on a site's pages a field stands.

A page is parsed once, in one Arrow stage. Its rungs run in order, and each is asked only about the fields that are still open on that page;
what it found and how many it was asked about is kept as a trace. Fields that no rung filled leave as open pairs of page and field, the only
ones that a model is asked about.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.cells import name_tokens
from ..functions.fields import label_fits
from ..session import checkpoint_folder

#: What a page gives: its records, or one record with the fields that several rungs found.
READ = "page_id long, text string, found array<struct<ordinal:int,field:string,value:string,quote:string,rung:string>>, trace array<struct<place:int,rung:string,asked:int,filled:int>>"
#: Characters of an element's text beyond which it is a container and no value.
LONGEST_VALUE = 220


class Page:
    """A stored page and what has been read from it; the tree is made when it is first needed, and once."""

    def __init__(self, body: str | None, schema: dict | None):
        self.body, self.schema = body or "", schema or {}
        self.is_json = self.body.lstrip()[:1] in ("{", "[")
        self.parses = 0
        self._tree: H.Node | None = None
        #: Records of a listing, if the selectors found several.
        self.listed: list[dict[str, str]] = []

    @property
    def tree(self) -> H.Node:
        if self._tree is None:
            self.parses += 1
            self._tree = H.parse(self.body)
        return self._tree

    @property
    def text(self) -> str:
        return self.body if self.is_json else self.tree.text(H.HIDDEN)


Found = dict[str, tuple[str, str]]
Rung = Callable[[Page, list[str]], Found]


def json_rung(page: Page, wanted: list[str]) -> Found:
    """Fields of the first record of a JSON body, under the same name however it is spelt."""
    records = H.records_in(page.body, 1, None) if page.is_json else []
    return _by_name(records[0], wanted) if records else {}


def json_ld_rung(page: Page, wanted: list[str]) -> Found:
    """Fields of the schema.org objects that a page publishes, the first object that has them."""
    found: Found = {}
    for node in [] if page.is_json else H.json_ld(page.tree):
        found = _by_name(node, [w for w in wanted if w not in found]) | found
    return found


def labelled_rung(page: Page, wanted: list[str]) -> Found:
    """Fields printed as ``Label: value``, the first line whose label names the field."""
    found: Found = {}
    pairs = [] if page.is_json else H.labelled_pairs(page.text)
    for field in wanted:
        hit = next(((value, line) for label, value, line in pairs if label_fits(label, field)), None)
        if hit:
            found[field] = hit
    return found


def selector_rung(page: Page, wanted: list[str]) -> Found:
    """Fields that a site's selectors find; with several containers each is a record of its own."""
    selectors = {f: s for f, s in page.schema.get("fields", {}).items() if f in wanted}
    if not selectors or page.is_json:
        return {}
    if page.schema.get("item"):
        page.listed = H.css_records(page.tree, page.schema["item"], selectors, None)
        first = page.listed[0] if page.listed else {}
    else:
        first = {f: t for f, s in selectors.items() if (t := selected_text(page.tree, s))}
    return {f: (v, v) for f, v in first.items()}


def selected_text(tree: H.Node, selectors: list[str]) -> str:
    """The text of the first element that any of the selectors finds, in their order."""
    return next((" ".join(t.split()) for s in selectors for n in H.select(tree, s)[:1] if (t := n.text())), "")


def _by_name(record: dict, wanted: list[str]) -> Found:
    named = {}
    for key, value in record.items():
        text = H.as_text(value)
        if text:
            named.setdefault(" ".join(name_tokens(key)), (text, text))
    return {f: named[k] for f in wanted if (k := " ".join(name_tokens(f))) in named}


#: The order of the rungs. JSON is exact and comes first; pretty JSON would otherwise read as labelled lines.
RUNGS: tuple[tuple[str, Rung], ...] = (("json", json_rung), ("labelled", labelled_rung), ("selectors", selector_rung), ("json_ld", json_ld_rung))


def read_page(page: Page, fields: list[str], rungs: tuple[tuple[str, Rung], ...] = RUNGS) -> tuple[list[dict], list[dict]]:
    """(found, trace) of one page: each rung is asked about what the ones before it left open."""
    filled: dict[str, dict] = {}
    trace = []
    for place, (name, rung) in enumerate(rungs):
        wanted = [f for f in fields if f not in filled]
        if not wanted:
            break
        got = {f: x for f, x in rung(page, wanted).items() if f in wanted and x[0].strip()}
        filled |= {f: {"ordinal": 0, "field": f, "value": v, "quote": q, "rung": name} for f, (v, q) in got.items()}
        trace.append({"place": place, "rung": name, "asked": len(wanted), "filled": len(got)})
    # a listing whose fields all come from its selectors is as many records as it has containers
    if len(page.listed) > 1 and filled and {x["rung"] for x in filled.values()} == {"selectors"}:
        return [{"ordinal": i, "field": f, "value": v, "quote": v, "rung": "selectors"} for i, r in enumerate(page.listed) for f, v in r.items() if v.strip()], trace
    return [filled[f] for f in fields if f in filled], trace


@dataclass
class Extraction:
    """``found``: page_id, ordinal, field, value, quote, rung; ``trace``: page_id, place, rung, asked, filled; ``open``: page_id, field, text."""

    found: DataFrame
    trace: DataFrame
    open: DataFrame


def extract(
    pages: DataFrame, fields: list[str], schemas: DataFrame | None = None, ask: Callable[[DataFrame], DataFrame] | None = None, rungs: tuple[tuple[str, Rung], ...] = RUNGS
) -> Extraction:
    """Fields of pages (page_id, url, html), by rungs and then, if ``ask`` is given, by a model.

    ``schemas``: domain, item, fields (a map from field to selectors), joined with the page's domain. ``ask`` gets the open pairs (page_id, field,
    text) and gives page_id, field, value, quote. Pages without a body give nothing and leave all fields open.
    """
    checkpoint_folder(pages.sparkSession)
    rows = pages.select("page_id", domain_of(F.col("url")).alias("domain"), "html")
    if schemas is None:
        rows = rows.withColumn("schema", F.lit(None).cast("string"))
    else:
        one = schemas.groupBy("domain").agg(F.min(F.to_json(F.struct("item", "fields"))).alias("schema"))
        rows = rows.join(one, "domain", "left")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, body, schema in zip(*(batch.column(c).to_pylist() for c in ("page_id", "html", "schema")), strict=True):
                page = Page(body, json.loads(schema) if schema else None)
                found, trace = read_page(page, fields, rungs) if page.body.strip() else ([], [])
                open_ = len({x["field"] for x in found}) < len(fields)
                out.append((page_id, page.text if open_ else None, found, trace))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("ordinal", pa.int32()), *((k, pa.string()) for k in ("field", "value", "quote", "rung"))])), pa.list_(pa.struct([("place", pa.int32()), ("rung", pa.string()), ("asked", pa.int32()), ("filled", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "text", "found", "trace"])

    read = rows.select("page_id", "html", "schema").mapInArrow(stage, READ).checkpoint()
    found = read.select("page_id", F.inline("found"))
    trace = read.select("page_id", F.inline("trace"))
    missing = F.array_except(F.array(*map(F.lit, fields)), F.transform("found", lambda x: x["field"]))
    left = read.select("page_id", F.explode(missing).alias("field"), "text")
    if ask is None:
        return Extraction(found, trace, left)
    said = ask(left).filter(F.coalesce(F.btrim("value"), F.lit("")) != "")
    # a model answers for the pairs that it was asked about, once each
    said = said.join(left.select("page_id", "field"), ["page_id", "field"], "left_semi").groupBy("page_id", "field").agg(F.min(F.struct("value", "quote")).alias("x")).checkpoint()
    answered = said.select("page_id", F.lit(0).alias("ordinal"), "field", "x.value", "x.quote", F.lit("model").alias("rung"))
    asked = left.groupBy("page_id").agg(F.count("*").cast("int").alias("asked")).join(said.groupBy("page_id").agg(F.count("*").cast("int").alias("filled")), "page_id", "left")
    asked = asked.select("page_id", F.lit(len(rungs)).alias("place"), F.lit("model").alias("rung"), "asked", F.coalesce("filled", F.lit(0)).alias("filled"))
    return Extraction(found.unionByName(answered), trace.unionByName(asked), left.join(said, ["page_id", "field"], "left_anti"))


def domain_of(url: Column) -> Column:
    """The last two labels of an address's host."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]+)$", 1)


# learning selectors


def steps_of(node: H.Node) -> Iterator[str]:
    """Ways to name one element among others, the most telling first."""
    if node.attrs.get("id"):
        yield f"{node.tag}[id={node.attrs['id']}]"
    classes = [c for c in node.attrs.get("class", "").split() if c.replace("-", "").replace("_", "").isalnum()]
    for name in classes:
        yield f"{node.tag}.{name}"
    for key in sorted(node.attrs):
        if key.startswith(("data-", "item")) and key.replace("-", "").isalnum():
            yield f"{node.tag}[{key}={node.attrs[key]}]" if node.attrs[key].replace("-", "").replace("_", "").isalnum() else f"{node.tag}[{key}]"
    if not classes and not node.attrs.get("id"):
        yield node.tag


def paths_of(node: H.Node, most_steps: int = 3) -> list[str]:
    """Selectors for an element that other pages of its kind may share: by itself, below a parent, and by its place among twins."""
    own = list(steps_of(node))
    out = list(own)
    twins = [c for c in node.parent.children if isinstance(c, H.Node) and c.tag == node.tag] if node.parent else [node]
    placed = [f"{s}:nth-of-type({next(i for i, t in enumerate(twins, 1) if t is node)})" for s in own] if len(twins) > 1 else []
    ends = own + placed
    up, depth = node.parent, 1
    while up is not None and up.tag and depth < most_steps:
        ends = [f"{parent} > {end}" for parent in list(steps_of(up))[:2] for end in ends]
        out += ends
        up, depth = up.parent, depth + 1
    return list(dict.fromkeys(out))


def _places(tree: H.Node, value: str) -> Iterator[H.Node]:
    """The innermost elements whose whole text is a value."""
    plain = " ".join(value.split())
    for node in tree.walk():
        if node.tag and node.tag not in H.HIDDEN and " ".join(node.text().split()) == plain and not any(isinstance(c, H.Node) and " ".join(c.text().split()) == plain for c in node.children):
            yield node


def learn_selectors(pages: DataFrame, examples: DataFrame, held_out: Column, most_candidates: int = 20, least_right: int = 2) -> DataFrame:
    """domain, field, selector, seen, right, wrong, missed, reason, place of every candidate; ``reason`` is null for proven ones, which have a ``place`` from 1.

    ``examples``: page_id, field, value. Candidates come from the pages that are not ``held_out`` (a condition on page_id): the paths of elements whose
    text is the value. The ``most_candidates`` that most pages of a domain share are run on the held-out pages, where the first element that one finds
    must have the value of that page's example. Refused are candidates that find something else anywhere, find a container, or are right on
    fewer than ``least_right`` held-out pages. Pages are read one by one whatever their domain, and only counts are grouped.
    """
    checkpoint_folder(pages.sparkSession)
    wanted = examples.filter(F.coalesce(F.btrim("value"), F.lit("")) != "").groupBy("page_id", "field").agg(F.min("value").alias("value"))
    per_page = wanted.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("wanted"))
    rows = pages.select("page_id", domain_of(F.col("url")).alias("domain"), "html").join(per_page, "page_id").withColumn("held", held_out)

    def propose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page_id, domain, body, values in zip(frame["page_id"], frame["domain"], frame["html"], frame["wanted"], strict=True):
                tree = H.parse(body)
                for field, value in dict(values).items():
                    found = {s for node in _places(tree, value) for s in paths_of(node)}
                    out += [(page_id, domain, field, s) for s in found]
            yield pd.DataFrame(out, columns=["page_id", "domain", "field", "selector"])

    seen = rows.filter("not held").select("page_id", "domain", "html", "wanted").mapInPandas(propose, "page_id long, domain string, field string, selector string")
    counted = seen.groupBy("domain", "field", "selector").agg(F.count("*").alias("seen"))
    order = Window.partitionBy("domain", "field").orderBy(F.desc("seen"), F.length("selector"), "selector")
    chosen = counted.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most_candidates).drop("n").checkpoint()
    listed = chosen.groupBy("domain").agg(F.to_json(F.array_sort(F.collect_list(F.struct("field", "selector")))).alias("tried"))

    def prove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for domain, body, values, tried in zip(frame["domain"], frame["html"], frame["wanted"], frame["tried"], strict=True):
                tree, values = H.parse(body), dict(values)
                for x in json.loads(tried):
                    if x["field"] in values:
                        text = selected_text(tree, [x["selector"]])
                        right = text == " ".join(values[x["field"]].split())
                        out.append((domain, x["field"], x["selector"], int(right), int(bool(text) and not right), int(not text), int(len(text) > LONGEST_VALUE and not right)))
            yield pd.DataFrame(out, columns=["domain", "field", "selector", "right", "wrong", "missed", "container"])

    shape = "domain string, field string, selector string, right long, wrong long, missed long, container long"
    proof = rows.filter("held").select("domain", "html", "wanted").join(listed, "domain").mapInPandas(prove, shape)
    proof = proof.groupBy("domain", "field", "selector").agg(*[F.sum(c).alias(c) for c in ("right", "wrong", "missed", "container")])
    both = chosen.join(proof, ["domain", "field", "selector"], "left").fillna(0, ["right", "wrong", "missed", "container"])
    reason = (
        F.when(F.col("container") > 0, "finds a container").when(F.col("wrong") > 0, "finds something else on another page")
        .when(F.col("right") == 0, "finds nothing on another page").when(F.col("right") < least_right, "too few pages to prove it")
    )
    told = both.withColumn("reason", reason).drop("container")
    best = Window.partitionBy("domain", "field", F.col("reason").isNull()).orderBy(F.desc("right"), F.length("selector"), "selector")
    return told.withColumn("place", F.when(F.col("reason").isNull(), F.row_number().over(best)))


def schemas_of(learnt: DataFrame, most: int = 5) -> DataFrame:
    """domain, item, fields for ``extract`` from proven selectors, the best ``most`` for each field."""
    kept = learnt.filter(F.col("place") <= most).groupBy("domain", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "selector"))), lambda x: x["selector"]).alias("selectors"))
    return kept.groupBy("domain").agg(F.lit(None).cast("string").alias("item"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "selectors")))).alias("fields"))
