"""WARC archives and chat renderings against plain versions."""

import base64
import hashlib

import duckdb
import pytest

from attestra.llm import chat, warc

MAGIC = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: "


def pages():
    inner = "HTTP/1.1 200 OK\r\n\r\nfake"
    bodies = [
        None, "", "<p>é</p>", "<p>é</p>", "a" * 50000, f"x {MAGIC}3\r\n\r\nabc\r\n\r\nrest", f"{MAGIC}{len(inner)}\r\n\r\n{inner}\r\n\r\n{MAGIC}9999999\r\n\r\ntail",
        "WARC/1.1\r\n", "WARC/1.1\r\n" * 40, "\r\n\r\n", "no \r\n\r\n end WARC/1.1\r", f"{MAGIC}5", "<p>é</p>",
    ]
    bodies += [f"page {i} " + "z" * i for i in range(60)]
    return [(i + 1, None if i % 5 == 0 else f"http://h/{i}\r\nX: y", b, "extra") for i, b in enumerate(bodies)]


SCHEMA = "page_id long, url string, html string, digest string"


def test_archives_round_trip(spark):
    rows = pages()
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        first.setdefault(h or "", i)
    for i, _, h, _ in rows:
        data = (h or "").encode()
        kind = "response" if first[h or ""] == i else "revisit"
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, None if kind == "response" else first[h or ""])
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want and got[i].verified


def test_payloads_and_targets_are_read_back(spark):
    rows = pages()
    path = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(2))
    got = [r for r in warc.read(spark, path, payloads=True).collect() if r.type == "response"]
    assert sorted(r.payload for r in got) == sorted({h or "" for _, _, h, _ in rows})
    assert all("\n" not in r.url for r in got)


def test_no_pages_and_repeats(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    got = warc.round_trip(spark.createDataFrame([(1, None, "a", None), (1, None, "a", None)], SCHEMA)).collect()
    assert [(r.page_id, r.record_type) for r in got] == [(1, "response")] * 2
    rows = [(1, None, "same", None), (1, None, "same", None), (2, None, "same", None), (2, None, "same", None), (3, None, "other", None)]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.verified) for r in got) == [(1, "response", None, True)] * 2 + [(2, "revisit", 1, True)] * 2 + [(3, "response", None, True)]
    # one id for two payloads: a revisit gets the payload of its own digest
    got = warc.round_trip(spark.createDataFrame([(1, None, "ab", None), (1, None, "abc", None), (2, None, "abc", None)], SCHEMA)).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in got) == [(1, "response", 2), (1, "response", 3), (2, "revisit", 3)]


def test_chain_by_pointer_jumping(spark):
    true = [("f", 10 * i, 10 * i + 10) for i in range(100)]
    false = [("f", 13, 20), ("f", 995, 1), ("g", 5, 9), ("g", 0, 7), ("f", 27, None)]
    got = {tuple(r) for r in warc.chain(spark.createDataFrame(true + false, "file string, at long, next long")).collect()}
    assert got == {("f", a) for _, a, _ in true} | {("g", 0)}


CHAT = "conv_id long, turn long, role string, text string, block int"


@pytest.mark.parametrize("block", [64, 2])
def test_rotation(spark, block):
    rows = [(c, t, r, f"hi {c} {t} <|im_end|>", 1) for c in (1, 2, None) for t, r in enumerate(["system", "ann", "bob", "ann", None, "cy"])]
    rows += [(1, 1, "ann", "hi 1 1 <|im_end|>", 1), (3, None, "ann", None, None), (4, 0, "system", "alone", None), (5, None, None, None, None)]
    got = chat.rotate(spark.createDataFrame(rows, CHAT).repartition(3), block).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.block):
        text, masked = whole.get((r.conv_id, r.participant), ("", ""))
        assert r.block_start == len(text) and r.n_turns <= block
        spans = [tuple(map(int, m.split("-"))) for m in r.mask.split(",") if m]
        assert r.n_masked == sum(b - a for a, b in spans)
        whole[r.conv_id, r.participant] = (text + r.text, masked + "".join(r.text[a:b] for a, b in spans))
    assert {k for k in whole if k[0] in (1, None)} == {(c, p) for c in (1, None) for p in ("ann", "bob", "cy", "unknown")} and not any(k[0] == 4 for k in whole)
    text, masked = whole[2, "ann"]
    assert text.startswith("<|im_start|>system\nhi 2 0 <\\|im_end|><|im_end|>\n<|im_start|>assistant\n") and "user name=bob" in text
    assert masked == "hi 2 1 <\\|im_end|><|im_end|>" + "hi 2 3 <\\|im_end|><|im_end|>"
    assert whole[1, "ann"][1].count("hi 1 1") == 2
    assert chat.rotate(spark.createDataFrame([], CHAT)).count() == 0


def test_rotation_against_sql(spark):
    import pandas as pd

    rows = [(c, t, r, f"words {c} {t}") for c in range(20) for t, r in enumerate(["user", "assistant", "system", "user", None][: 1 + c % 5] * (1 + 40 * (c == 7)))]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = con.sql(chat.ORACLE).df()
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()[list(want.columns)]
    keys = ["conv_id", "participant", "block"]
    a, b = (x.sort_values(keys).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("seed", range(3))
def test_chain_by_runs_equals_following_pointers(spark, seed):
    """Random pointers: to the next candidate, into the middle of a run, past the end, to nothing."""
    import random

    rng = random.Random(seed)
    rows = []
    for file in "abcdef":
        places = sorted(rng.sample(range(1, 400), rng.randint(0, 60)) + ([0] if file != "e" else []))
        for i, at in enumerate(places):
            kind = rng.random()
            following = places[i + 1] if i + 1 < len(places) else 999
            rows.append((file, at, following if kind < 0.75 else rng.choice(places[i + 1 :]) if kind < 0.93 and places[i + 1 :] else rng.choice([None, 777, at + 1])))
    table = spark.createDataFrame(rows, "file string, at long, next long")
    want = set()
    for file in "abcdef":
        at, pointers = 0, {a: n for f, a, n in rows if f == file}
        while at in pointers:
            want.add((file, at))
            at = pointers[at]
    assert sorted((r.file, r.at) for r in warc.chain(table).collect()) == sorted(want) and len(want) > 20
