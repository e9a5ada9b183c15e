"""FLAC media columns: lossless 8-bit PCM with linear prediction, Rice residuals and verified checksums.

Encoding cuts each stream into frames, predicts with the best of three fixed orders and one adaptive
linear predictor, and Rice-codes the residual. Decoding finds the frames by the stream's seek table,
verifies both checksums of each, and runs through all frames of a batch in step: the i-th
samples of all frames are decoded together by numpy, so no Python runs per sample. ``pcm_blocks`` gives
the decoded blocks with their sample offsets, and ``stored_blocks`` writes them; a reader seeks by them.

Streams are read if they are mono, 8 bits deep, with a seek point for each frame, as written here.
Defined results: null payloads are empty; a text's payload is its UTF-8 bytes and zeros up to a positive
multiple of 64; repeated rows give equal rows; an empty table gives no rows; other columns are ignored. A very long
text is one stream, and a task holds some 30 times its bytes; as offsets are 24 bits of seek table, streams end near 950 MB. A
damaged stream is a row with a status in ``pcm_blocks`` and raises ``ValueError`` elsewhere; so does a damaged stored block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import materialize, text_chunks

BLOCK = 1024
ORDER = 4
#: The highest fixed order tried, and the mark of the adaptive predictor.
FIXED = 2
ADAPTIVE = 9
PRECISION = 10
#: Bytes of payload that are encoded or decoded together.
CHUNK = 1 << 20
RATE = 8000
#: What a damaged stream makes the decoder raise.
DAMAGE = (ValueError, IndexError, struct.error, OverflowError)
STORED = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset:bigint,n_samples:bigint,crc32:bigint,pcm:binary>>"
DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_BLOCKS = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("crc32", pa.int64()), ("pcm", pa.binary())]))


@cache
def _crc8_table() -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = ((b << 1) ^ 0x07) & 0xFF if b & 0x80 else b << 1
        out.append(b)
    return out


@cache
def _crc16_table() -> np.ndarray:
    b = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        b = np.where(b & 0x8000, (b << 1) ^ 0x8005, b << 1) & 0xFFFF
    return b.astype(np.uint16)


@cache
def _crc16_by_distance(n: int) -> np.ndarray:
    """Row d: what a byte d places before the end adds to the checksum."""
    out = np.zeros((n, 256), np.uint16)
    out[0] = one = _crc16_table()
    for d in range(1, n):
        out[d] = (out[d - 1] << np.uint16(8)) ^ one[out[d - 1] >> np.uint16(8)]
    return out


def crc16(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Checksums of data[start:end] for frames that follow one another without overlap."""
    sizes = end - start
    longest = int(sizes.max())
    table = _crc16_by_distance(1 << (longest - 1).bit_length())
    distance = np.repeat(end - 1, sizes) - (at := np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())))
    return np.bitwise_xor.reduceat(table[distance, data[at]], np.cumsum(sizes) - sizes)


@cache
def frame_header(number: int, samples: int) -> bytes:
    if number < 0x80:
        coded = bytes([number])
    else:
        tail = []
        limit = 0x40
        while number >= limit:
            tail.append(0x80 | number & 0x3F)
            number >>= 6
            limit >>= 1
        coded = bytes([(~(2 * limit - 1) & 0xFF) | number, *reversed(tail)])
    head = b"\xff\xf8\x70\x02" + coded + struct.pack(">H", samples - 1)
    crc = 0
    for b in head:
        crc = _crc8_table()[crc ^ b]
    return head + bytes([crc])


def _put(words: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
    """Set the low ``width`` (at most 16) bits of each value, highest first, from bit ``at`` on; ``at`` increases."""
    if not len(at):
        return
    word, room = at >> 6, 64 - (at & 63) - width
    value = value.astype(np.uint64)
    held = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] |= np.bitwise_or.reduceat(held, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)


def _predictors(x: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(residuals, predictor kind: a fixed order or ADAPTIVE, coefficients, shifts) of frames in the rows of ``x``."""
    frames = len(x)
    single = x.astype(np.float32)
    autocorrelation = np.array([np.einsum("ij,ij->i", single[:, j:], single[:, : x.shape[1] - j]) for j in range(ORDER + 1)], np.float64)
    error = autocorrelation[0] * (1 + 1e-9) + 1e-9
    a = np.zeros((ORDER, frames))
    for i in range(ORDER):
        k = (autocorrelation[i + 1] - sum(a[j] * autocorrelation[i - j] for j in range(i))) / error
        new = a.copy()
        new[i] = k
        for j in range(i):
            new[j] = a[j] - k * a[i - 1 - j]
        a, error = new, np.maximum(error * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(0), 1e-6)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(top)).astype(int) - 1, 0, 14)
    most = (1 << (PRECISION - 1)) - 1
    coefficients = np.clip(np.rint(a * (1 << shift)), -most - 1, most).astype(np.int32)
    padded = np.pad(x, ((0, 0), (ORDER, 0)))
    n = x.shape[1]
    predicted = sum(coefficients[j][:, None] * padded[:, ORDER - 1 - j : ORDER - 1 - j + n] for j in range(ORDER)) >> shift[:, None]
    choices = [x]
    for _ in range(FIXED):
        choices.append(np.diff(choices[-1], axis=1, prepend=0))
    choices.append(x - predicted)
    best, kind, cost = choices[0].copy(), np.zeros(frames, int), None
    mask = inside.astype(np.int32)
    for i, residual in enumerate(choices):
        last = i == len(choices) - 1
        warm = ORDER if last else i
        own = np.einsum("ij,ij->i", np.abs(residual[:, warm:]), mask[:, warm:]) + 8 * warm + 30 * last
        if cost is None:
            cost = own
            continue
        better = own < cost
        best[better], kind[better], cost = residual[better], ADAPTIVE if last else i, np.minimum(cost, own)
    return best, kind, coefficients, shift


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (of 16 bytes or more), its bytes as signed samples shifted by 128."""
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    counts = -(-sizes // BLOCK)
    number = np.concatenate([np.arange(c) for c in counts.tolist()])
    n = np.full(len(number), BLOCK)
    last = np.cumsum(counts) - 1
    n[last] = sizes - (counts - 1) * BLOCK
    data = np.frombuffer(b"".join(payloads), np.uint8)
    ends = np.cumsum(n)
    column = np.arange(BLOCK)
    inside = column < n[:, None]
    x = np.zeros((len(n), BLOCK), np.int32)
    x[inside] = data.astype(np.int32) - 128
    residual, kind, coefficients, shift = _predictors(x, inside)
    warm = np.where(kind == ADAPTIVE, ORDER, kind)
    coded = inside & (column >= warm[:, None])
    u = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    mean = (u * coded).sum(1) / np.maximum(n - warm, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean * np.log(2), 1e-9))).astype(int) + 1, 0, 14)
    k = np.where(((u >> k[:, None]) * coded).sum(1) + k * (n - warm) <= ((u >> np.maximum(k - 1, 0)[:, None]) * coded).sum(1) + np.maximum(k - 1, 0) * (n - warm), k, np.maximum(k - 1, 0))
    u, each = u[coded], np.repeat(k, n - warm)
    q = u >> each
    width = q + 1 + each
    code = (1 << each) | (u & ((1 << each) - 1))
    per_frame = np.add.reduceat(np.append(width, 0), np.minimum(np.cumsum(n - warm) - (n - warm), len(width)))
    per_frame = np.where(n > warm, per_frame, 0)
    plain = per_frame + 8 * warm + np.where(kind == ADAPTIVE, 9 + ORDER * PRECISION, 0) + 10 >= 8 * n
    side = np.where(plain, 8 * n, 8 * warm + np.where(kind == ADAPTIVE, 9 + ORDER * PRECISION, 0) + 10 + per_frame)
    headers = [frame_header(i, s) for i, s in zip(number.tolist(), n.tolist(), strict=True)]
    head = np.fromiter(map(len, headers), np.int64, len(headers))
    body = head + 1 + -(-side // 8)
    total = body + 2
    start = np.cumsum(total) - total
    words = np.zeros((int(total.sum()) >> 3) + 3, np.uint64)
    at = (start + head) * 8
    _put(words, at, np.where(plain, 2, np.where(kind == ADAPTIVE, 2 * (31 + ORDER), 2 * (8 + kind))), 8)
    at = at + 8
    rice = ~plain
    for j in range(ORDER):
        has = rice & (warm > j)
        _put(words, at[has] + 8 * j, x[has, j] & 0xFF, 8)
    at = at + 8 * warm
    linear = rice & (kind == ADAPTIVE)
    _put(words, at[linear], np.full(int(linear.sum()), PRECISION - 1), 4)
    _put(words, at[linear] + 4, shift[linear], 5)
    for j in range(ORDER):
        _put(words, at[linear] + 9 + PRECISION * j, coefficients[j][linear] & ((1 << PRECISION) - 1), PRECISION)
    at = at + np.where(kind == ADAPTIVE, 9 + ORDER * PRECISION, 0)
    _put(words, at[rice] + 6, k[rice], 4)
    at = at + 10
    own = np.repeat(rice, n - warm)
    first = np.cumsum(width) - width
    frame_first = np.repeat(at - np.concatenate([[0], np.cumsum(per_frame)[:-1]]), n - warm)
    _put(words, (frame_first + first + q)[own], code[own], (width - q)[own])
    packed = words.astype(">u8").view(np.uint8)
    for row in np.flatnonzero(plain).tolist():
        packed[start[row] + head[row] + 1 : start[row] + head[row] + 1 + n[row]] = x[row, : n[row]] & 0xFF
    heads = np.frombuffer(b"".join(headers), np.uint8)
    packed[np.repeat(start - (np.cumsum(head) - head), head) + np.arange(len(heads))] = heads
    crc = crc16(packed, start, start + body)
    packed[start + body], packed[start + body + 1] = crc >> 8, crc & 0xFF
    stream, out, f = packed.tobytes(), [], 0
    for payload, c in zip(payloads, counts.tolist(), strict=True):
        own_start, own_total = start[f : f + c] - start[f], total[f : f + c]
        size = min(BLOCK, len(payload))
        shifted = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", size, size) + int(own_total.min()).to_bytes(3, "big") + int(own_total.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5(shifted).digest()
        points = b"".join(struct.pack(">QQH", i * BLOCK, o, s) for i, (o, s) in enumerate(zip(own_start.tolist(), n[f : f + c].tolist(), strict=True)))
        end = int(start[f + c - 1] + total[f + c - 1])
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + stream[int(start[f]) : end])
        f += c
    return out


def _seek_points(stream: bytes) -> tuple[int, int, bytes, np.ndarray]:
    """(where the frames begin, samples, their MD5, seek points)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, points = 4, False, 0, b"", None
    while not last:
        if at + 4 > len(stream):
            raise ValueError("the stream ends in its metadata")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            if (packed >> 36) & 0xFF != 7:
                raise ValueError("only mono streams of 8 bits are read")
            total, md5 = packed & (1 << 36) - 1, block[18:34]
        elif kind == 3:
            points = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        at += 4 + size
    if points is None or int(points["n"].sum()) != total:
        raise ValueError("the seek table does not cover the stream")
    return at, total, md5, points


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, sample offsets of its blocks) of each stream; checksums are verified."""
    begin, end, samples, numbers, owners, infos = [], [], [], [], [], []
    base = 0
    for i, stream in enumerate(streams):
        at, total, md5, points = _seek_points(stream)
        starts = base + at + points["offset"].astype(np.int64)
        begin.append(starts)
        end.append(np.append(starts[1:], base + len(stream)))
        samples.append(points["n"].astype(np.int64))
        numbers.append(np.arange(len(points)))
        owners.append(len(points))
        infos.append((md5, points["sample"].astype(np.int64)))
        base += len(stream)
    if not streams:
        return []
    start, stop, n, number = (np.concatenate(v) for v in (begin, end, samples, numbers))
    joined = b"".join(streams) + bytes(16)
    data = np.frombuffer(joined, np.uint8)
    stated = (data[stop - 2].astype(np.uint16) << 8) | data[stop - 1]
    if (crc16(data, start, stop - 2) != stated).any():
        raise ValueError("a frame's checksum is wrong")
    head = np.empty(len(n), np.int64)
    for i, (s, number_i, n_i) in enumerate(zip(start.tolist(), number.tolist(), n.tolist(), strict=True)):
        expected = frame_header(number_i, n_i)
        if joined[s : s + len(expected)] != expected:
            raise ValueError("a frame's header is wrong")
        head[i] = len(expected)

    order = np.argsort(-n, kind="stable")
    n, cursor = n[order], (start[order] + head[order]) * 8
    window = np.zeros(len(data) - 8, np.uint64)
    for b in range(8):
        window = (window << np.uint64(8)) | data[b : b + len(window)]

    def peek(at: np.ndarray) -> np.ndarray:
        """64 bits from each position, of which 57 at least are valid, highest first."""
        return window[at >> 3] << (at & 7).astype(np.uint64)

    def take(at: np.ndarray, width: int, signed: bool = False) -> np.ndarray:
        value = (peek(at) >> np.uint64(64 - width)).astype(np.int64)
        return np.where(value >> (width - 1) > 0, value - (1 << width), value) if signed else value

    frames = len(n)
    kind = take(cursor, 8) >> 1
    cursor = cursor + 8
    plain, fixed, linear = kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (plain | fixed | linear).all():
        raise ValueError("unknown kind of subframe")
    warm = np.where(linear, kind - 31, np.where(fixed, kind - 8, 0))
    deepest = int(warm.max(initial=0))
    out = np.zeros((int(n.max()), frames), np.int32)
    for j in range(deepest):
        has = np.flatnonzero(warm > j)
        out[j, has] = take(cursor[has], 8, True)
        cursor[has] += 8
    #: The coefficients of the fixed predictors.
    rules = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
    coefficients, shift = np.zeros((max(deepest, ORDER), frames), np.int32), np.zeros(frames, np.int32)
    for o, rule in enumerate(rules):
        for j, c in enumerate(rule):
            coefficients[j, fixed & (warm == o)] = c
    lin = np.flatnonzero(linear)
    if len(lin):
        precision = take(cursor[lin], 4) + 1
        shift[lin] = take(cursor[lin] + 4, 5, True)
        cursor[lin] += 9
        for j in range(int(warm[lin].max())):
            has = lin[warm[lin] > j]
            for p in np.unique(precision):
                some = has[precision[warm[lin] > j] == p]
                coefficients[j, some] = take(cursor[some], int(p), True)
                cursor[some] += int(p)
    rice = ~plain
    partitions, k = np.zeros(frames, np.int64), np.zeros(frames, np.int64)
    if rice.any():
        method = take(cursor[rice], 2)
        if method.any():
            raise ValueError("only residuals with 4-bit Rice parameters are read")
        partitions[rice] = take(cursor[rice] + 2, 4)
        cursor[rice] += 6
    due = np.where(rice, 0, 1 << 62)
    part = n >> partitions
    escaped = np.zeros(frames, bool)
    active = np.searchsorted(-n, -np.arange(1, int(n.max()) + 1), "right")
    for i in range(int(n.max())):
        w = int(active[i])
        # what still warms up is known already
        now = warm[:w] <= i
        everyone = bool(now.all())
        first = due[:w] <= i
        if not everyone:
            first &= now
        if first.any():
            at = np.flatnonzero(first)
            k[at] = take(cursor[at], 4)
            cursor[at] += 4
            due[at] = (i // part[at] + 1) * part[at]
            escaped[at] = k[at] == 15
            if escaped[at].any():
                raw = at[escaped[at]]
                k[raw] = take(cursor[raw], 5)
                cursor[raw] += 5
        at = cursor[:w]
        bits = peek(at)
        high = bits >> np.uint64(32)
        if not (high > 0).all() or escaped[:w].any() or plain[:w].any() or not everyone:
            residual, used = _slow(bits, high, at, k[:w], escaped[:w], plain[:w], now, peek)
        else:
            q = 32 - np.frexp(high.astype(np.float64))[1].astype(np.int64)
            kw = k[:w]
            rest = ((bits << (q + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - kw).astype(np.uint64)).astype(np.int64)
            u = (q << kw) | rest
            residual = (u >> 1) ^ -(u & 1)
            used = q + 1 + kw
        cursor[:w] += used
        if i:
            reach = min(i, len(coefficients))
            predicted = coefficients[0, :w] * out[i - 1, :w]
            for j in range(1, reach):
                predicted = predicted + coefficients[j, :w] * out[i - 1 - j, :w]
            value = residual + (predicted >> shift[:w])
        else:
            value = residual
        if everyone:
            out[i, :w] = value
        else:
            out[i, :w][now] = value[now]
    back = np.empty(frames, np.int64)
    back[order] = np.arange(frames)
    pcm = (out.T + 128).astype(np.uint8)[back]
    n = n[back]
    result, f = [], 0
    for count, (md5, offsets) in zip(owners, infos, strict=True):
        payload = b"".join(pcm[f + j, : n[f + j]].tobytes() for j in range(count))
        if hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest() != md5:
            raise ValueError("the stream's MD5 is wrong")
        result.append((payload, offsets))
        f += count
    return result


def _slow(bits, high, at, k, escaped, plain, now, peek):
    """One step for frames of any kind: plain samples, escaped residuals, long runs of zeros, warming up."""
    q = np.zeros(len(at), np.int64)
    coded = now & ~escaped & ~plain
    place = at.copy()
    left = np.flatnonzero(coded & (high == 0))
    while len(left):
        q[left] += 32
        place[left] += 32
        left = left[(peek(place[left]) >> np.uint64(32)) == 0]
    bits = peek(place)
    high = np.maximum(bits >> np.uint64(32), 1)
    more = 32 - np.frexp(high.astype(np.float64))[1].astype(np.int64)
    rest = ((bits << (more + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
    u = ((q + more) << k) | rest
    residual, used = (u >> 1) ^ -(u & 1), q + more + 1 + k
    width = np.where(plain, 8, k)
    raw = (peek(at) >> np.uint64(1) >> (63 - width).astype(np.uint64)).astype(np.int64)
    raw = np.where((width > 0) & (raw >> np.maximum(width - 1, 0) > 0), raw - (1 << width), raw)
    direct = plain | escaped
    return np.where(now, np.where(direct, raw, residual), 0), np.where(now, np.where(direct, width, used), 0)


def padded(text: bytes) -> bytes:
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_chunks(batches, CHUNK):
        media = encode([padded(t) for t in texts])
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        streams = batch.column("media").to_pylist()
        start = size = 0
        for i, stream in enumerate(streams):
            if size and size + len(stream) > CHUNK:
                yield batch.slice(start, i - start), streams[start:i]
                start = i
                size = 0
            size += len(stream)
        if start < len(streams):
            yield batch.slice(start), streams[start:]


def media_column(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (a FLAC stream of its padded bytes)."""
    return documents.select("doc_id", "text").mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


def _decoded(streams: list[bytes]) -> list[tuple[bytes, np.ndarray, str | None]]:
    """(payload, block offsets, what is wrong) of each stream; a damaged one does not spoil the others."""
    try:
        return [(p, o, None) for p, o in decode(streams)]
    except DAMAGE as error:
        if len(streams) == 1:
            return [(b"", np.zeros(0, np.int64), str(error) or type(error).__name__)]
        return [x for s in streams for x in _decoded([s])]


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, sample_offset, n_samples, pcm, crc32, status of every decoded block; a damaged stream is one row without a block, whose status says what is wrong."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, streams in _streams(batches):
            out = []
            for doc, (payload, offsets, wrong) in zip(rows.column("doc_id").to_pylist(), _decoded(streams), strict=True):
                bounds = [*offsets.tolist(), len(payload)]
                out += [(doc, i, a, b - a, payload[a:b], zlib.crc32(payload[a:b]), None) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
                if wrong is not None:
                    out.append((doc, None, None, None, None, None, wrong))
            names = ["doc_id", "block", "sample_offset", "n_samples", "pcm", "crc32", "status"]
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return media.mapInArrow(blocks, "doc_id long, block long, sample_offset long, n_samples long, pcm binary, crc32 long, status string")


def stored_blocks(documents: DataFrame) -> DataFrame:
    """A written table with one row for each document: doc_id, n_bytes, media_bytes, media_sha256, and the PCM blocks that its FLAC stream decodes to.

    A block has the offset of its first sample, so a reader that wants sample s takes the last block whose offset is at most s.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches, CHUNK):
            streams = encode([padded(t) for t in texts])
            held = []
            for payload, offsets in decode(streams):
                bounds = [*offsets.tolist(), len(payload)]
                held.append([{"sample_offset": a, "n_samples": b - a, "crc32": zlib.crc32(payload[a:b]), "pcm": payload[a:b]} for a, b in zip(bounds, bounds[1:], strict=False)])
            columns = [
                rows.column("doc_id").cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, streams), pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in streams]), pa.array(held, _BLOCKS),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return materialize(documents.select("doc_id", "text").mapInArrow(store, STORED), "blocks")


def read_blocks(blocks: list[dict]) -> bytes:
    """The payload of stored blocks, whose checksums and offsets must be right."""
    at = 0
    for b in blocks:
        if b["sample_offset"] != at or b["n_samples"] != len(b["pcm"]) or zlib.crc32(b["pcm"]) != b["crc32"]:
            raise ValueError(f"the block at sample {at} is damaged")
        at += len(b["pcm"])
    return b"".join(b["pcm"] for b in blocks)


def described_blocks(stored: DataFrame) -> DataFrame:
    """What ``described`` gives, from stored blocks that are read back."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                blocks = rows.column("blocks").to_pylist()
                payloads = [read_blocks(b) for b in blocks]
                columns = [
                    rows.column("doc_id"), rows.column("n_bytes"), pa.array(map(len, payloads), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()), rows.column("media_bytes"), rows.column("media_sha256"),
                    pa.array([feature(p, len(b)) for p, b in zip(payloads, blocks, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in DESCRIBED.split(", ")])

    return stored.mapInArrow(describe, DESCRIBED)


def feature(payload: bytes, blocks: int) -> str:
    """Number of blocks, mean and mean step of the samples, share of steps that cross the mean."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    mean = x.mean()
    crossings = np.count_nonzero(np.diff(x > mean))
    return f"{blocks}:{mean:.3f}:{np.abs(np.diff(x)).mean():.3f}:{crossings / len(x):.4f}"


def described(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from the decoded streams."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, streams in _streams(batches):
            found = decode(streams)
            columns = [
                rows.column("doc_id"), rows.column("n_bytes"),
                pa.array([len(p) for p, _ in found], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p, _ in found]),
                pa.array([zlib.crc32(p[-64:]) for p, _ in found], pa.int64()), pa.array(map(len, streams), pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in streams]), pa.array([feature(p, len(o)) for p, o in found]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(describe, kinds)
