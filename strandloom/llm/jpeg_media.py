"""Media columns: baseline JPEG.

encode() stores bytes losslessly as 8-bit luminance samples: an 8x8 block for each byte, flat at that value, in rows of 64
blocks. A flat block has only a DC coefficient, which is a multiple of 8, so with a DC quantiser of 8 it is exact. Each row
of blocks is a restart interval. Payloads of more than 64 * 8,191 bytes become several images one after another (a JPEG side
is at most 65,535). decode() is a reader of baseline JPEGs in general: it parses the markers, Huffman-decodes the scan
(all restart intervals at once, in step, in numpy) and rebuilds the DC-only luminance thumbnail, one sample for each block.

Edge cases: a null text equals the empty one (64 zero bytes); equal texts give equal values; an empty table gives no rows;
other columns are ignored. decode() raises ValueError or another of DAMAGED for what it can't read (progressive, lossless and
arithmetic JPEGs, files cut short); media_features() gives null features and a reason for these and for null and empty media.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows

WIDE, TALL = 64, 8191
# Number of DC luminance codes of each length from 1 to 16, for categories 0 to 11 in order.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
# One AC code, '0': the end of a block.
AC_COUNTS, AC_SYMBOLS = (1, *[0] * 15), (0,)


def canonical(counts: tuple[int, ...] | bytes, symbols: tuple[int, ...] | bytes) -> list[tuple[int, int, int]]:
    """(length, code, symbol) of a Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((length, code, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@functools.lru_cache(64)
def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: code length (0: no code) and symbol."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for n, code, s in canonical(counts, symbols):
        a = code << (16 - n)
        length[a : a + (1 << (16 - n))], symbol[a : a + (1 << (16 - n))] = n, s
    return length, symbol


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference plus 255: bits and their number, with the end of the block."""
    bits, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    table = {s: (n, c) for n, c, s in canonical(DC_COUNTS, range(12))}
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        n, c = table[cat]
        extra = d if d > 0 else d + (1 << cat) - 1
        bits[d + 255], size[d + 255] = ((c << cat) | extra) << 1, n + cat + 1
    return bits, size


_BITS, _SIZE = _codes()


def encode(payload: bytes) -> bytes:
    """payload: a positive multiple of 64 bytes."""
    if not payload or len(payload) % WIDE:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    step = WIDE * TALL
    return b"".join(_encode_image(np.frombuffer(payload[i : i + step], np.uint8)) for i in range(0, len(payload), step))


def _encode_image(samples: np.ndarray) -> bytes:
    rows = samples.reshape(-1, WIDE).astype(np.int64) - 128
    diff = np.diff(rows, axis=1, prepend=0) + 255
    size = _SIZE[diff]
    total = size.sum(axis=1)
    length = (total + 7) // 8  # bytes of each interval
    start = np.zeros(len(rows), np.int64)
    np.cumsum(length[:-1], out=start[1:])
    # each code has at most 20 bits: it is laid over four bytes at its bit place
    at = (np.cumsum(size, axis=1) - size + start[:, None] * 8).ravel()
    word = (_BITS[diff].ravel() << (32 - (at & 7) - size.ravel()).astype(np.uint32)).astype(np.uint32)
    out = np.zeros(int(length.sum()) + 4, np.int64)
    for k in range(4):
        part = (word >> np.uint32(24 - 8 * k)) & np.uint32(255)
        out += np.bincount((at >> 3) + k, weights=part, minlength=len(out)).astype(np.int64)[: len(out)]
    raw = out[: int(length.sum())].astype(np.uint8)
    spare = length * 8 - total  # the last byte of an interval is filled with ones
    raw[start + length - 1] |= ((1 << spare) - 1).astype(np.uint8)
    stuffed = np.flatnonzero(raw == 255)
    ends = start[1:]
    data = np.insert(raw, np.concatenate([stuffed + 1, np.repeat(ends, 2)]), np.concatenate([np.zeros(len(stuffed), np.uint8), np.stack([np.full(len(ends), 255), 0xD0 + np.arange(len(ends)) % 8], 1).ravel().astype(np.uint8)]))
    height = len(rows) * 8
    head = segment(0xDB, bytes([0, 8] + [1] * 63)) + segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + (WIDE * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    head += segment(0xC4, bytes([0x00, *DC_COUNTS, *range(12)])) + segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])) + segment(0xDD, WIDE.to_bytes(2, "big")) + segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    return b"\xff\xd8" + head + data.tobytes() + b"\xff\xd9"


class Frame:
    """Header of one baseline image and the place of its scan."""

    def __init__(self, data: bytes, at: int):
        self.quant, self.tables, self.interval, self.parts = {}, {}, 0, []
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG starts here")
        at += 2
        while True:
            while data[at + 1] == 0xFF:  # fill bytes
                at += 1
            kind, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at] != 0xFF:
                raise ValueError("a marker is expected")
            body = data[at + 4 : at + 2 + n]
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif kind in (0xC0, 0xC1):
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline JPEGs are read")
            elif kind == 0xC4:
                while body:
                    n_codes = sum(body[1:17])
                    self.tables[body[0]] = lookup(body[1:17], body[17 : 17 + n_codes])
                    body = body[17 + n_codes :]
            elif kind == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif kind == 0xDA:
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                if len(chosen) != len(self.parts):
                    raise ValueError("all components must be in one scan")
                for p in self.parts:
                    p["dc"], p["ac"] = self.tables[chosen[p["id"]] >> 4], self.tables[0x10 | (chosen[p["id"]] & 15)]
                self.scan = at + 2 + n
                return
            at += 2 + n


def _scan(data: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The scan's bytes without stuffing, starts and lengths of its restart intervals, and the place after it."""
    mark = np.flatnonzero((data[at:-1] == 255) & (data[at + 1 :] != 0)) + at
    mark = mark[data[mark + 1] != 255]
    other = mark[(data[mark + 1] & 0xF8) != 0xD0]
    end = int(other[0]) if len(other) else len(data)
    cuts = mark[mark < end]
    body = data[at:end]
    keep = np.ones(len(body), bool)
    keep[1:] = ~((body[:-1] == 255) & (body[1:] == 0))
    keep[cuts - at] = keep[cuts - at + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    starts = np.concatenate([[0], place[cuts - at + 2]])
    stops = np.concatenate([place[cuts - at], [place[-1]]])
    return body[keep], starts, stops - starts, end


def decode(data: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, DC-only luminance thumbnail) of each image in data."""
    return decode_many([data])[0]


def decode_many(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """decode() of many files at once: intervals of images with equal tables and layout are decoded in step."""
    out: list[list] = [[] for _ in files]
    groups: dict = {}  # lookup() keeps equal tables as one object, and the groups keep them alive
    for k, data in enumerate(files):
        raw, at = np.frombuffer(data, np.uint8), 0
        while at < len(data) - 1:
            f = Frame(data, at)
            body, starts, lengths, end = _scan(raw, f.scan)
            across, down = -(-f.width // (8 * max(p["h"] for p in f.parts))), -(-f.height // (8 * max(p["v"] for p in f.parts)))
            if len(f.parts) == 1:
                f.parts[0]["h"] = f.parts[0]["v"] = 1
                across, down = -(-f.width // 8), -(-f.height // 8)
            key = tuple((p["h"], p["v"], id(p["dc"]), id(p["ac"])) for p in f.parts)
            groups.setdefault((key, f.interval or across * down), []).append((k, len(out[k]), f, body, starts, lengths, across, down))
            out[k].append(None)
            at = end + 2
    for (_, interval), items in groups.items():
        parts = items[0][2].parts
        bodies, base, starts, todo = [], 0, [], []
        for _, _, _, body, s, _, across, down in items:
            bodies.append(body)
            starts.append(s + base)
            base += len(body)
            left = across * down - interval * np.arange(len(s))
            todo.append(np.minimum(left, interval))
        stops = np.concatenate([s + b for (_, _, _, _, _, b, _, _), s in zip(items, starts, strict=True)])
        first = _in_step(np.concatenate([*bodies, np.full(8, 255, np.uint8)]), np.concatenate(starts), stops, np.concatenate(todo), parts)
        row = 0
        for k, j, f, _, s, _, across, down in items:
            h, v = parts[0]["h"], parts[0]["v"]
            dc = first[row : row + len(s)].reshape(-1, v, h)[: across * down]
            row += len(s)
            image = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            thumb = np.clip((image * f.quant[f.parts[0]["q"]] + 4) // 8 + 128, 0, 255).astype(np.uint8)
            out[k][j] = (f.width, f.height, thumb)
    return out


def _in_step(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, todo: np.ndarray, parts: list[dict]) -> np.ndarray:
    """DC values of the first component, [interval, unit, v * h], all intervals one code at a time; ends: the places after their bytes."""
    bit = starts.astype(np.int64) * 8
    per = parts[0]["h"] * parts[0]["v"]
    most = int(todo.max())
    out = np.zeros((len(starts), most, per), np.int32)
    last = np.zeros((len(parts), len(starts)), np.int32)
    limit = len(data) - 5

    def peek(b: np.ndarray) -> np.ndarray:
        at = np.minimum(b >> 3, limit)
        w = (data[at].astype(np.uint32) << 16) | (data[at + 1].astype(np.uint32) << 8) | data[at + 2]
        return (w >> (8 - (b & 7)).astype(np.uint32)) & 0xFFFF

    for unit in range(most):
        own = np.flatnonzero(todo > unit)
        whole = len(own) == len(starts)
        for c, p in enumerate(parts):
            for sub in range(p["h"] * p["v"]):
                b = bit if whole else bit[own]
                w = peek(b)
                n, cat = p["dc"][0][w], p["dc"][1][w].astype(np.uint32)
                if (n == 0).any():
                    raise ValueError("the scan has no valid code")
                if (b >> 3 > ends[own]).any():
                    raise ValueError("the scan ends too early")
                b = b + n
                extra = (peek(b) >> (16 - cat)).astype(np.int32)
                d = np.where((cat > 0) & (extra < ((1 << cat) >> 1)), extra - ((1 << cat) - 1).astype(np.int32), extra).astype(np.int32)
                b = b + cat
                last[c, own] += d
                if c == 0:
                    out[own, unit, sub] = last[c, own]
                # AC: pass over the codes up to the end of the block
                live, k = np.arange(len(b)), np.ones(len(b), np.int32)
                while len(live):
                    w = peek(b[live])
                    n, s = p["ac"][0][w], p["ac"][1][w]
                    if (n == 0).any():
                        raise ValueError("the scan has no valid code")
                    b[live] += n + (s & 15)
                    k[live] += np.where(s == 0, 64, (s >> 4) + 1)
                    live = live[k[live] < 64]
                if whole:
                    bit = b
                else:
                    bit[own] = b
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDE if raw else WIDE), len(raw)


def feature(images: list[tuple[int, int, np.ndarray]]) -> str:
    """Sizes of the first image, number of images, and a 64-bit difference hash of all thumbnails one below another."""
    samples = np.concatenate([x[2] for x in images])
    rows = np.linspace(0, len(samples), 9).astype(int)
    tall = np.stack([samples[a : max(b, a + 1)].mean(axis=0) if a < len(samples) else samples[-1] for a, b in zip(rows[:-1], rows[1:], strict=True)])
    cols = np.linspace(0, samples.shape[1], 10).astype(int)
    small = np.stack([tall[:, a : max(b, a + 1)].mean(axis=1) for a, b in zip(cols[:-1], cols[1:], strict=True)], axis=1)
    return f"{images[0][0]}x{images[0][1]}*{len(images)}:{int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), 'big'):016x}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, problem string"
MEDIA = "doc_id long, n_bytes long, media binary"
_GROUP = 1 << 22
#: What decoding a damaged file raises: a missing table or marker, or places beyond the data.
DAMAGED = (ValueError, IndexError, KeyError, AttributeError, OverflowError)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a JPEG column."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [payload_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MEDIA)


def media_row(data: bytes, images: list[tuple[int, int, np.ndarray]]) -> dict:
    payload = np.concatenate([x[2].ravel() for x in images]).tobytes()
    return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature(images), "width": images[0][0], "height": sum(x[1] for x in images), "problem": None}


def unreadable(data: bytes | None, problem: str) -> dict:
    """What is known of a file that can't be decoded."""
    return dict.fromkeys(_ARROW.names[2:]) | {"media_bytes": None if data is None else len(data), "media_sha256": None if data is None else hashlib.sha256(data).hexdigest(), "problem": problem}


def media_rows(media: list[bytes | None]) -> list[dict]:
    """Features of stored files, decoded in groups of about 4 MB; those of a group with a damaged file are decoded one by one."""
    out, at = [], 0
    while at < len(media):
        end, size = at, 0
        while end < len(media) and (end == at or size + len(media[end] or b"") <= _GROUP):
            size += len(media[end] or b"")
            end += 1
        some = media[at:end]
        there = [d for d in some if d]
        try:
            found = iter(decode_many(there))
            out += [media_row(d, next(found)) if d else unreadable(d, "no media" if d is None else "empty") for d in some]
        except DAMAGED:
            for d in some:
                if not d:
                    out.append(unreadable(d, "no media" if d is None else "empty"))
                    continue
                try:
                    out.append(media_row(d, decode(d)))
                except DAMAGED as e:
                    out.append(unreadable(d, f"damaged: {e}"[:200]))
        at = end
    return out


def media_features(media: DataFrame) -> DataFrame:
    """Reads the media column back and computes its features. Of null, empty and damaged media those are null and `problem` says why."""
    arrow_rows(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = media_rows(b.column(2).to_pylist())
            cols = {k: [r[k] for r in rows] for k in _ARROW.names[2:]}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(cols[k], _ARROW.field(k).type) for k in _ARROW.names[2:])], schema=_ARROW)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


_ARROW = pa.schema([(k, pa.string() if t == "string" else pa.int64()) for k, t in (x.split() for x in SCHEMA.split(", "))])
