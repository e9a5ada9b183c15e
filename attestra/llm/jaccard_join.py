"""Near-duplicate components by an n-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct five-word shingles, known by 64-bit hashes; equal sets are one node.
Nodes x and y link when 100 * |x & y| >= 75 * |x | y|, so they share at least need(n) = ceil(0.75 n) shingles of
either. With all shingles in one global order (rare first), the first n - need(n) + l of each then share at
least l: the l-prefix. Every node picks the l whose estimated cost is least, scanning the postings of
a longer prefix against verifying fewer candidates; a pair must share min(l_x, l_y) prefix shingles.

1. One pass counts set sizes, digests and very frequent shingles.
2. A second pass deals shingles to buckets, each with its document's place in a lot (the documents that a task
   gathers at a time). A bucket finds which occur again and tells the lots; frequent shingles, a bounded
   list, take the short way. A lot knows its nodes, so these travel once. Blocks of numbers travel, not rows.
3. A node with fewer than need(n) shared shingles links with nothing. The others get their prefix.
4. Components need links, not all pairs: within each posting list every node is first verified against
   a few leaders, in rounds with more and other leaders. Then only pairs from different components
   remain: each node meets the nodes of larger components in its posting lists, what it shares with
   each is counted, and those that share enough are verified. Every pair that shares enough prefix
   shingles is thus verified or already connected, so no link is lost.

Defined results: null and blank texts have no shingles and link with nothing; texts of one to four
words are one shingle; repeated rows are equal sets; a null doc_id can join two others but is never
a component's name unless all are null; an empty table gives no rows; other columns are ignored.
Chance collisions of 64-bit digests are the only error (for m sets m**2 / 2**65).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import attach_groups, components, give_back, materialize, mix, powers, shingle_sets, shuffle_partitions, text_chunks, to_buckets

WORDS = 5
PERCENT = 75
#: A shingle is frequent when at least this share of documents hold it.
FREQUENT = 1 / 256
#: The longest multi-match considered, and the cost of verifying a candidate in units of reading a posting.
MOST_MATCHES = 6
VERIFY = 20.0
#: Bytes of text read at a time, and shingles that a task gathers before it deals them out.
CHUNK = 1 << 18
GATHERED = 400_000
#: Bytes of shingles in a partition on average.
PARTITION = 12 << 20
#: Leaders of a posting list's nodes in each round.
LEADERS = (1, 8)
#: Nodes of a posting list that one task compares at a time, on average.
POSTING = 50_000
_ALWAYS = np.uint32(0xFFFFFFFF)

FACTS = "doc_id long, n long, node long, shingle long, times long"
DEALT = "bucket long, lot long, nodes binary, sizes binary, owners binary, hashes binary, degrees binary"
SHARED = "node long, n long, hashes binary, degrees binary"
LIVE = "node long, n long, matches int, prefix array<long>, shingles binary, bitmap binary"


def need(n, percent: int = PERCENT):
    """How many shingles of a set of n a linked set must share."""
    return -(-n * percent // 100)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, nodes, sizes, hashes) of many documents at a time."""
    held: list[tuple] = []
    total = 0
    for rows, texts in text_chunks(batches, CHUNK):
        hashes, sizes = shingle_sets(texts, WORDS)
        starts = np.cumsum(sizes) - sizes
        sums = np.add.reduceat(np.append(mix(hashes ^ np.uint64(0xA5A5A5A5)), np.uint64(0)), starts)
        nodes = mix(np.where(sizes > 0, sums, np.uint64(0)) + sizes.astype(np.uint64))
        held.append((rows.column("doc_id").to_pylist(), nodes, sizes, hashes))
        total += len(hashes)
        if total >= GATHERED:
            yield _joined(held)
            held, total = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    ids = [i for h in held for i in h[0]]
    return ids, *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3))


def _fresh(nodes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, seen: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without empty sets, repeats and the nodes that the task has seen."""
    keep = np.zeros(len(nodes), bool)
    for i, (node, size) in enumerate(zip(nodes.tolist(), sizes.tolist(), strict=True)):
        if size and node not in seen:
            seen.add(node)
            keep[i] = True
    return nodes[keep], sizes[keep], hashes[np.repeat(keep, sizes)]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    names = [x.split()[0] for x in FACTS.split(", ")]

    def batch(*columns) -> pa.RecordBatch:
        size = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], names)

    for ids, nodes, sizes, hashes in _gathered(batches):
        yield batch(ids, sizes, nodes.view(np.int64), None, None)
        own, _, hashes = _fresh(nodes, sizes, hashes, seen)
        hashes = np.sort(hashes)
        first = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1))) if len(hashes) else np.zeros(0, int)
        times = np.diff(np.append(first, len(hashes)))
        often = times >= max(16, len(own) / 64)
        if often.any():
            yield batch(None, None, None, hashes[first[often]].view(np.int64), times[often])


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, so that high bytes that are zero compress to nothing."""
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def _values(block: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64()] + [pa.binary()] * (len(columns) - 2)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in DEALT.split(", ")])


def _deal(keys: np.ndarray, lots: np.ndarray | int, owner: np.ndarray, hashes: np.ndarray, degrees: np.ndarray | None = None) -> list[tuple]:
    """One row for each distinct pair of bucket and lot, with its entries by hash: differences of hashes, owners, degrees."""
    lots = np.broadcast_to(np.asarray(lots, np.int64), len(keys))
    order = np.lexsort((hashes, lots, keys))
    keys, lots, owner, hashes = keys[order], lots[order], owner[order].astype("<u4"), hashes[order]
    degrees = None if degrees is None else degrees[order].astype("<u4")
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (lots[1:] != lots[:-1])
    cuts = np.flatnonzero(new).tolist()
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        steps = np.diff(hashes[a:b], prepend=np.uint64(0)).astype("<u8")
        out.append((int(keys[a]), int(lots[a]), b"", b"", _planes(owner[a:b]), _planes(steps), b"" if degrees is None else _planes(degrees[a:b])))
    return out


def _entries(row: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners, hashes, degrees) of a row of ``_deal``."""
    return _values(row[3], "<u4"), np.cumsum(_values(row[4], "<u8"), dtype=np.uint64), _values(row[5], "<u4")


def _spread(values: np.ndarray, n: int) -> np.ndarray:
    return (((values >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _dealer(frequent: np.ndarray, buckets: int, homes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shingles go to ``buckets`` with their places in a lot, the documents gathered at a time; the lot's nodes go home, to one of ``homes`` further buckets.

    Frequent shingles go straight home. A lot is named by what it holds, so that a task run again names it alike.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, nodes, sizes, hashes in _gathered(batches):
            nodes, sizes, hashes = _fresh(nodes, sizes, hashes, seen)
            if not len(nodes):
                continue
            owner = np.repeat(np.arange(len(nodes)), sizes)
            lot = mix(np.array([(nodes * powers(np.uint64(0x9E3779B97F4A7C15), len(nodes))).sum(dtype=np.uint64)]))
            home, lot = buckets + int(_spread(lot, homes)[0]), int(lot.view(np.int64)[0])
            rows = [(home, lot, nodes.astype("<u8").tobytes(), sizes.astype("<i4").tobytes(), b"", b"", b"")]
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
                known = frequent[at] == hashes
                if known.any():
                    rows += _deal(np.full(int(known.sum()), home), lot, owner[known], hashes[known], np.full(int(known.sum()), _ALWAYS))
                owner, hashes = owner[~known], hashes[~known]
            if len(hashes):
                rows += _deal(_spread(hashes, buckets), lot, owner, hashes)
            yield _batch(rows)

    return deal


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Rows sorted by bucket, a bucket at a time."""
    now, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for bucket, *rest in zip(*columns, strict=True):
            if bucket != now and rows:
                yield now, rows
                rows = []
            now = bucket
            rows.append(rest)
    if rows:
        yield now, rows
        rows.clear()
    give_back()


def _sharer(buckets: int, homes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each bucket, tell the lots which of their shingles occur again, and how often."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            if bucket >= buckets:
                yield _batch([(bucket - buckets, *r) for r in rows])
                continue
            found = [_entries(r) for r in rows]
            owner, hashes = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            lots = np.repeat(np.array([r[0] for r in rows], np.int64), [len(f[0]) for f in found])
            del found
            order = np.argsort(hashes)
            ordered = hashes[order]
            new = np.ones(len(order), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            first = np.flatnonzero(new)
            degree = np.diff(np.append(first, len(order)))
            degrees = np.repeat(degree, degree)
            some, degrees = order[degrees > 1], degrees[degrees > 1]
            if len(some):
                yield _batch(_deal(_spread(lots[some].view(np.uint64), homes), lots[some], owner[some], hashes[some], degrees))

    return share


def _gatherer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each lot that hold enough shingles that occur again, with these and how often they do."""
    for _, rows in _by_bucket(batches):
        lots: dict[int, list[list]] = {}
        for r in rows:
            lots.setdefault(r[0], []).append(r)
        for own in lots.values():
            nodes, sizes = next((np.frombuffer(r[1], "<u8"), np.frombuffer(r[2], "<i4")) for r in own if r[1])
            found = [_entries(r) for r in own if r[3]]
            if not found:
                continue
            owner, hashes, degrees = (np.concatenate([f[k] for f in found]) for k in range(3))
            enough = np.bincount(owner, minlength=len(nodes)) >= need(sizes)
            kept = np.flatnonzero(enough[owner])
            if not len(kept):
                continue
            kept = kept[np.lexsort((hashes[kept], owner[kept]))]
            owner, hashes, degrees = owner[kept], hashes[kept], degrees[kept]
            # two lots that hold the same count as one
            once = np.ones(len(kept), bool)
            once[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
            owner, hashes, degrees = owner[once], hashes[once].astype("<u8"), degrees[once].astype("<u4")
            cuts = np.flatnonzero(np.diff(owner.astype(np.int64), prepend=-1)).tolist()
            ends = [*cuts[1:], len(owner)]
            who = owner[cuts]
            columns = [
                pa.array(nodes[who].view(np.int64)), pa.array(sizes[who].astype(np.int64)),
                pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array([degrees[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SHARED.split(", ")])


def choose_matches(degrees: np.ndarray, unshared: int, n: int) -> tuple[int, int]:
    """(l, shared shingles in the l-prefix) of least estimated cost, for shared degrees in the global order.

    A candidate of an l-prefix shares at least l of its shingles, so at most sum(degrees) / l candidates exist.
    """
    least = need(n)
    best, kept, cost = 1, 0, np.inf
    sums = np.cumsum(np.minimum(degrees, 1e9))
    for matches in range(1, min(MOST_MATCHES, least) + 1):
        length = min(max(0, n - least + matches - unshared), len(degrees))
        postings = float(sums[length - 1]) if length else 0.0
        total = postings + VERIFY * postings / matches
        if total < cost:
            best, kept, cost = matches, length, total
    return best, kept


def _bitmap(hashes: np.ndarray) -> bytes:
    """512 bits, one for each hash; sets differ in at least as many elements as their bitmaps in bits."""
    bits = np.zeros(512, np.uint8)
    bits[(hashes & np.uint64(511)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node: each node once, with its prefix, if it shares enough with other nodes than itself."""
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in LIVE.split(", ")])

    def add(node: int, size: int, hashes: bytes, degrees: bytes, copies: int) -> None:
        own, degree = np.frombuffer(hashes, "<u8"), np.frombuffer(degrees, "<u4")
        # a copy of the set in another lot is the same node
        own, degree = own[degree > copies], degree[degree > copies]
        if len(own) < need(size):
            return
        order = np.lexsort((own, degree))
        matches, kept = choose_matches(degree[order], size - len(own), size)
        out.append((node, size, matches, own[order][:kept].view(np.int64), own.tobytes(), _bitmap(own)))

    held, copies = None, 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0]:
                add(*held, copies)
                copies = 0
                if len(out) >= 256:
                    yield flush()
                    out.clear()
            held, copies = row, copies + 1
    if held:
        add(*held, copies)
    if out:
        yield flush()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a_set, b_set = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
        n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        good = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(a_set[i], "<u8"), np.frombuffer(b_set[i], "<u8")
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[at] == x).sum())
            good[i] = 100 * common >= PERCENT * int(n_a[i] + n_b[i] - common)
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, for rows sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(v[a] for v in values)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
        held.clear()
    give_back()


MET = "x long, l_x int, nodes binary, matches binary"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node that seeks in a posting list: the nodes of larger components that sizes, shared shingles and bitmaps allow."""
    for group in _groups(batches, ["token", "chunk"]):
        seeks, node, n, held, matches, size, component = (group.column(c).to_numpy() for c in ("seeks", "node", "n", "held", "matches", "size", "component"))
        bits = np.frombuffer(b"".join(group.column("bitmap").to_pylist()), np.uint64).reshape(-1, 8)
        y = ~seeks
        bits_y = bits[y]
        node_y, n_y, held_y, matches_y, size_y, component_y = node[y], n[y], held[y], matches[y].astype(np.uint8), size[y], component[y]
        out = []
        for i in np.flatnonzero(seeks).tolist():
            larger = (size_y > size[i]) | ((size_y == size[i]) & (component_y > component[i]))
            larger &= np.maximum(n_y, n[i]) * PERCENT <= np.minimum(n_y, n[i]) * 100
            larger &= np.minimum(held_y, held[i]) * (100 + PERCENT) >= (n_y + n[i]) * PERCENT
            # the bitmaps bound what two sets share; the pair must be able to link
            some = np.flatnonzero(larger)
            apart = np.bitwise_count(bits_y[some] ^ bits[i]).sum(1)
            larger = some[(held_y[some] + held[i] - apart) * (100 + PERCENT) >= 2 * PERCENT * (n_y[some] + n[i])]
            if len(larger):
                out.append((int(node[i]), int(matches[i]), node_y[larger].astype("<i8").tobytes(), matches_y[larger].tobytes()))
        if out:
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in MET.split(", ")])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that share at least as many prefix shingles as the less demanding of the two asks."""
    for group in _groups(batches, ["x"]):
        x, l_x = int(group.column("x")[0].as_py()), int(group.column("l_x")[0].as_py())
        nodes = np.frombuffer(b"".join(group.column("nodes").to_pylist()), "<i8")
        matches = np.frombuffer(b"".join(group.column("matches").to_pylist()), np.uint8)
        found, first, shared = np.unique(nodes, return_index=True, return_counts=True)
        found = found[shared >= np.minimum(matches[first], l_x)]
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(found, x)), pa.array(np.maximum(found, x))], ["a", "b"])


def verified(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link."""
    side = lambda c: live.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"set_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "set_a", "set_b").mapInArrow(_verify, "a long, b long")


def facts(documents: DataFrame) -> DataFrame:
    """A written table with (doc_id, n, node) of every document and (shingle, times) of frequent shingles."""
    return materialize(documents.select("doc_id", "text").mapInArrow(_facts, FACTS), "facts")


def live_nodes(documents: DataFrame, known: DataFrame) -> DataFrame:
    """The nodes that may link, with prefixes and shared shingles."""
    spark = documents.sparkSession
    n_docs, total = known.filter("n is not null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most total / (FREQUENT * n_docs) shingles
    often = known.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).filter(F.col("times") >= max(2, FREQUENT * n_docs))
    frequent = np.sort(np.array([r[0] for r in often.select("shingle").collect()], np.int64).view(np.uint64))
    parts = max(shuffle_partitions(spark), int(8 * total / PARTITION))
    dealt = documents.select("doc_id", "text").mapInArrow(_dealer(frequent, parts, parts), DEALT)
    shared = to_buckets(dealt, parts).mapInArrow(_sharer(parts, parts), DEALT)
    nodes = to_buckets(shared, parts).mapInArrow(_gatherer, SHARED)
    return materialize(nodes.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_live, LIVE), "live")


def links(live: DataFrame) -> DataFrame:
    """(node, component) for nodes with links; components are named by their smallest node."""
    spark = live.sparkSession
    held = (F.octet_length("shingles") / 8).cast("long").alias("held")
    posts = materialize(live.select("node", "n", held, "matches", F.explode("prefix").alias("token")), "posts")
    bitmaps = live.select("node", "bitmap")

    def fits(n_x: Column, n_y: Column, held_x: Column, held_y: Column) -> Column:
        """Whether the sizes allow a link, and each holds enough shingles that others hold too."""
        return (F.greatest(n_x, n_y) * PERCENT <= F.least(n_x, n_y) * 100) & (F.least(held_x, held_y) * (100 + PERCENT) >= (n_x + n_y) * PERCENT)

    def apart(x: str, y: str) -> Column:
        """In how many bits two bitmaps differ, 8 bytes at a time."""
        word = lambda c, i: F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("long")
        return sum((F.bit_count(word(x, i).bitwiseXOR(word(y, i))) for i in range(1, 8)), F.bit_count(word(x, 0).bitwiseXOR(word(y, 0))))

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, total n, total held) that the bitmaps allow to link."""
        side = lambda c: bitmaps.select(F.col("node").alias(c), F.col("bitmap").alias(f"bitmap_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").filter((F.col("held") - apart("bitmap_a", "bitmap_b")) * (100 + PERCENT) >= 2 * PERCENT * F.col("n")).select("a", "b")

    def labelled(found: DataFrame) -> DataFrame:
        """The posting lists that hold several components; a node that ``found`` lacks is one of its own."""
        own = posts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = own.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
        return materialize(own.join(mixed.select("token"), "token"), "mixed")

    edges, found = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, component long")
    for turn, leaders in enumerate(LEADERS):
        own = labelled(found)
        order = F.xxhash64("node", F.pmod(F.col("token"), F.lit(leaders)), F.lit(turn))
        lead = own.groupBy("token").agg(F.min(F.struct(order, "node", "n", "held", "component")).alias("lead"))
        near = own.join(lead, "token").filter((F.col("component") != F.col("lead.component")) & fits(F.col("n"), F.col("lead.n"), F.col("held"), F.col("lead.held")))
        pairs = near.select(
            F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"), (F.col("n") + F.col("lead.n")).alias("n"), (F.col("held") + F.col("lead.held")).alias("held")
        ).distinct()
        edges = materialize(edges.union(verified(close(pairs), live)), "links")
        # until the last leaders have met all, labels that join most of a component do
        found = materialize(near_labels(edges), "labels") if turn + 1 < len(LEADERS) else components(edges)
    sizes = materialize(found.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    sized = attach_groups(found, sizes, ["component"], "size", sizes.agg(F.sum("size")).first()[0] or 0)
    own = labelled(sized).withColumn("size", F.coalesce("size", F.lit(1)))
    # of two nodes the one in the smaller component looks for the other, in every posting list that they share
    lists = own.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"), (1 + F.floor(F.count("*") / POSTING)).cast("int").alias("chunks"))
    both = own.join(lists, "token").join(bitmaps, "node")
    columns = ["token", "chunk", "seeks", "node", "n", "held", "bitmap", "matches", "size", "component"]
    seekers = both.filter(F.struct("size", "component") < F.col("top")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("seeks", F.lit(True))
    sought = both.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("seeks", F.lit(False))
    parts = shuffle_partitions(spark)
    met = seekers.select(*columns).unionByName(sought.select(*columns)).repartition(parts, "token", "chunk").sortWithinPartitions("token", "chunk").mapInArrow(_meet, MET)
    pairs = met.repartition(parts, "x").sortWithinPartitions("x").mapInArrow(_count, "a long, b long")
    more = materialize(verified(pairs, live), "links")
    return found if more.isEmpty() else components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def near_labels(edges: DataFrame) -> DataFrame:
    """(node, component): the least node within two steps of each, so that nodes of one label are connected."""
    both = edges.union(edges.select("b", "a"))
    one = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
    two = both.join(one.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("component"))
    return two.select("node", F.least("node", "component").alias("component"))


def near_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    known = facts(documents)
    found = links(live_nodes(documents, known))
    rows = known.filter("n is not null").select("doc_id", "n", "node")
    classes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "classes")
    linked = named.join(found.select("node"), "node", "left_semi").groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    # nodes without links are components of their own
    groups = attach_groups(named, materialize(linked, "linked"), ["component"], "nodes", named.count(), "left")
    groups = materialize(groups.select("node", "size", F.coalesce("component_id", "least").alias("component_id")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    joined = attach_groups(rows.filter("n > 0"), groups, ["node"], "size", total)
    alone = rows.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def keep_first(documents: DataFrame) -> DataFrame:
    """Of each component the rows with its smallest id, with their own columns; rows that repeat this id all stay, as no column tells them apart."""
    chosen = near_components(documents).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    # a null id has no component to belong to and stays
    stay = documents.filter("doc_id is null")
    return documents.join(chosen.filter("doc_id is not null"), "doc_id", "left_semi").select(*documents.columns).unionByName(stay)
