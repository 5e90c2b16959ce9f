"""Media columns: AVI files of motion-JPEG, written, parsed and cut into clips.

A payload of bytes becomes a film: every 576 bytes are one 24 x 24 frame of 8-bit
samples, each a lossless (process 14) JPEG in an AVI container with an index. The
reader walks the RIFF chunks, takes the frames by their index entries, decodes
them, and finds shots where the histogram of a frame differs from the one before
by more than its neighbourhood leads to expect.

The Huffman table gives a difference of ``s`` bits a code of ``9 - s`` bits, so each
sample takes exactly nine bits and whole films are packed and unpacked as arrays.
The decoder reads any table; those of constant width take the array path.

Defined results
    null text: as the empty text, one frame of padding. Repeated rows give equal
    media. Empty table: empty result. Broken media: the row stays, with null fields
    and the reason in ``problem``. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
UNIT = SIDE * SIDE
WIDTH = 9  # bits of a coded sample
FPS = 25
BINS = 16
PAD = b"\xff"

MEDIA = "doc_id bigint, media binary"
READ = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, problem string"
CLIPS = "doc_id bigint, clip int, first_frame int, frames int, start_s double, end_s double"


@lru_cache(1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The nine bits of each difference (at difference + 255), and back."""
    to, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (WIDTH - s)) - 2  # ones and a last zero: a canonical code of 9 - s bits
        to[d + 255] = code << s | (d if d >= 0 else d + (1 << s) - 1)
        back[to[d + 255]] = d
    return to, back


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: What every frame starts with: Huffman table, frame header (SOF3), scan header.
HEAD = (
    b"\xff\xd8"
    + _segment(0xC4, bytes([0, *[1] * 9, *[0] * 7, *range(8, -1, -1)]))
    + _segment(0xC3, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
)


def pack_frames(frames: np.ndarray) -> list[bytes]:
    """Lossless JPEGs of ``frames`` (n, 24, 24), predicted from the left (first column: from above)."""
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    v = _codes()[0][d.reshape(-1, 8) + 255]  # eight samples are nine bytes
    out = np.empty((len(v), WIDTH), np.uint8)
    out[:, 0] = v[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (v[:, k - 1] << (8 - k)) | (v[:, k] >> (k + 1))
    out[:, 8] = v[:, 7]
    flat, step = out.tobytes(), UNIT * WIDTH // 8
    return [HEAD + flat[i : i + step].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(flat), step)]


@lru_cache(64)
def _tables(head: bytes) -> tuple[int, int, dict[tuple[int, int], int], int]:
    """Height, width, codes ``(length, code) -> bits`` and predictor from the segments before the scan."""
    at, height, width, table, predictor = 2, 0, 0, {}, 0
    while at < len(head):
        marker, length = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + length]
        if marker == 0xC4:
            code, k = 0, 17
            for size in range(1, 17):
                for _ in range(body[size]):
                    table[size, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xC3:
            if body[0] != 8 or body[5] != 1:
                raise ValueError("only one component of 8 bits is read")
            height, width = struct.unpack_from(">HH", body, 1)
        elif marker == 0xDA:
            predictor = body[3]
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("the frame is not lossless JPEG")
        at += 2 + length
    if predictor != 1 or not height:
        raise ValueError("only predictor 1 is read")
    return height, width, table, predictor


def _scan(jpeg: bytes) -> tuple[bytes, bytes]:
    """A frame's segments and its coded samples without stuffing."""
    at = 2
    while jpeg[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    return jpeg[:at], jpeg[at : jpeg.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")


def _by_bits(data: bytes, n: int, table: dict[tuple[int, int], int]) -> np.ndarray:
    """Differences coded with any table, bit by bit."""
    bits, at, out = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0, []
    for _ in range(n):
        size = code = 0
        while (size, code) not in table:
            code, size, at = code << 1 | bits[at], size + 1, at + 1
            if size > 16:
                raise ValueError("no such code")
        s, value = table[size, code], 0
        for _ in range(s):
            value, at = value << 1 | bits[at], at + 1
        out.append(value if s == 0 or value >> (s - 1) else value - (1 << s) + 1)
    return np.array(out, np.int16)


def unpack_frames(jpegs: list[bytes]) -> np.ndarray:
    """The samples (n, height, width) of lossless JPEGs of one size."""
    scans = [_scan(j) for j in jpegs]
    height, width, table, _ = _tables(scans[0][0])
    if any(s[0] != scans[0][0] and _tables(s[0])[:2] != (height, width) for s in scans):
        raise ValueError("frames differ in size")
    n = height * width
    if all(s[0] == HEAD and len(s[1]) == n * WIDTH // 8 for s in scans):
        b = np.frombuffer(b"".join(s[1] for s in scans), np.uint8).reshape(-1, WIDTH).astype(np.uint16)
        v = np.empty((len(b), 8), np.uint16)
        for k in range(8):
            v[:, k] = (b[:, k] << (k + 1) | b[:, k + 1] >> (7 - k)) & 511
        d = _codes()[1][v].reshape(-1, height, width)
    else:
        d = np.stack([_by_bits(data, n, _tables(head)[2]).reshape(height, width) for head, data in scans])
    x = d.astype(np.int32)
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
    return np.cumsum(x, axis=2).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI of the payload, whose length is a multiple of 576."""
    frames = pack_frames(np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE))
    most = max(map(len, frames), default=0)
    header = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    picture = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", UNIT, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture))
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", header) + strl) + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames of an AVI, found by its index, and its frames per second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    fps, movi, index = float(FPS), None, b""
    at, end = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            if micro := struct.unpack_from("<I", data, at + 20)[0]:
                fps = 1e6 / micro
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None or not index:
        raise ValueError("no frames or no index")
    frames = []
    for k, (name, _, start, size) in enumerate(struct.iter_unpack("<4sIII", index)):
        start += movi
        if data[start : start + 4] != name or struct.unpack_from("<I", data, start + 4)[0] != size:
            raise ValueError(f"index entry {k} does not fit")
        if name[2:] in (b"dc", b"db"):
            frames.append(data[start + 8 : start + 8 + size])
    if not frames:
        raise ValueError("no frames")
    return frames, fps


def cuts(frames: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """First frames of all shots, and the histogram difference (0 to 1) before each frame.

    A shot starts where the difference exceeds the mean of the up to ``window``
    differences before it by ``factor`` standard deviations, and ``least``.
    """
    n = len(frames)
    levels = (frames.reshape(n, -1) // (256 // BINS)).astype(np.int64)
    size = levels.shape[1]
    hist = np.bincount((levels + np.arange(n)[:, None] * BINS).ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * size)
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (diff, diff * diff))
    to = np.arange(len(diff))
    start = np.maximum(0, to - window)
    count = np.maximum(1, to - start)
    mean = (sums[to] - sums[start]) / count
    spread = np.sqrt(np.maximum(0, (squares[to] - squares[start]) / count - mean * mean))
    found = np.flatnonzero((diff > mean + factor * spread) & (diff > least)) + 1
    return np.concatenate([[0], found]), diff


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + PAD * (-len(data) % UNIT or (0 if data else UNIT))


def _arrow(columns: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _in_parts(rows: Iterator[tuple[dict, int]], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows of about ``most`` bytes at the most, however long single rows are."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 100
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def encode(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: the text of each row of ``docs(doc_id, text)`` as an AVI file."""
    schema = _arrow(MEDIA)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = write_avi(payload_of(text.as_py()))
                yield {"doc_id": key, "media": media}, len(media)

    return docs.select("doc_id", "text").mapInArrow(lambda b: _in_parts(rows(b), schema), MEDIA)


def describe(media: bytes | None) -> dict:
    """What is read back from one medium."""
    try:
        frames = unpack_frames(read_avi(media or b"")[0])
    except (ValueError, IndexError, struct.error) as e:
        return {"problem": str(e)}
    payload = frames.tobytes()
    starts, diff = cuts(frames)
    longest = int(np.diff(np.append(starts, len(frames))).max())
    return {
        "n_bytes": len(payload.rstrip(PAD)), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": f"frames={len(frames)};shots={len(starts)};longest={longest};change={diff.mean() if len(diff) else 0.0:.6f}",
    }


def read_back(media: DataFrame) -> DataFrame:
    """One row per medium of ``media(doc_id, media)``: payload digests and features (`READ`)."""
    schema = _arrow(READ)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield {"doc_id": key} | describe(data.as_py()), 0

    return media.select("doc_id", "media").mapInArrow(lambda b: _in_parts(rows(b), schema), READ)


def clips(media: DataFrame) -> DataFrame:
    """Timed clips, one row per shot of each readable medium (`CLIPS`)."""
    schema = _arrow(CLIPS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    jpegs, fps = read_avi(data.as_py() or b"")
                    frames = unpack_frames(jpegs)
                except (ValueError, IndexError, struct.error):
                    continue
                starts = [*cuts(frames)[0].tolist(), len(frames)]
                for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
                    yield {"doc_id": key, "clip": k, "first_frame": a, "frames": b - a, "start_s": a / fps, "end_s": b / fps}, 0

    return media.select("doc_id", "media").mapInArrow(lambda b: _in_parts(rows(b), schema), CLIPS)
