"""WARC archives compressed with Zstandard: one frame per record, shared dictionary.

An archive starts with a skippable frame that holds the dictionary, followed by one
frame per record. `write_archives` turns pages into such archives (a row of bytes
per archive, of bounded size) and `read_archives` takes rows of archive bytes, as
`spark.read.format("binaryFile")` also gives them, and yields one row per record,
with every header and length checked.

Payloads seen before are stored as `revisit` records that name the response.

Defined results
    null html: an empty payload. Null page_id: its record has no id and is never the
    response others refer to. Repeated page_ids with one payload are all responses,
    as each holds the smallest id. Empty table: no archive. Control characters in a
    url are percent-encoded in the header. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.shared import spread_join

SKIPPABLE = 0x184D2A5D  # fixed value of the format: the dictionary's frame
FRAME = 0xFD2FB528  # fixed value: a Zstandard frame
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 16 << 20
#: The dictionary is fitted on the beginnings of at most this many pages (a bounded
#: sample; records are always whole).
DICTIONARY_PAGES, DICTIONARY_PREFIX = 200, 20_000
DICTIONARY_BYTES = 32 << 10
MIN_REVISIT_BYTES = 100
NO_ID = "null"

ARCHIVES = "archive string, content binary"
RECORDS = (
    "archive string, record int, page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, payload binary, problem string"
)


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds ``payload, digest, refers_to`` to ``page_id, url`` (refers_to null: a response)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Only digests held by several ids matter, and few rows hold one of them: their sums
    # are made before the shuffle, and payloads only move to meet one that is not hot.
    first = (
        rows.where(F.length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count("*").alias("n"))
        .where("first_id < last_id").drop("last_id")
    )
    small, large = rows.where(F.length("payload") < min_bytes), rows.where(F.length("payload") >= min_bytes)
    joined = spread_join(large, "digest", first, "n", pages.count(), "left").unionByName(small.withColumn("first_id", F.lit(None).cast("long")))
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"))


def fit_dictionary(pages: DataFrame, n_pages: int = DICTIONARY_PAGES, size: int = DICTIONARY_BYTES, prefix: int = DICTIONARY_PREFIX) -> bytes:
    """A dictionary from the first ``prefix`` characters of at most ``n_pages`` pages; empty where there are too few.

    The pages are chosen by hashes alone, so only those chosen send their texts.
    """
    chosen = pages.where("html is not null and html <> ''").select(F.xxhash64("page_id", "html").alias("chosen")).distinct().orderBy("chosen").limit(n_pages)
    texts = pages.join(F.broadcast(chosen), F.xxhash64("page_id", "html") == F.col("chosen")).groupBy("chosen").agg(F.first(F.substring("html", 1, prefix)).alias("html"))
    samples = [r["html"].encode() for r in sorted(texts.collect(), key=lambda r: r["chosen"])]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] if samples else b""


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _id(page_id: int | None) -> str:
    return f"<urn:page:{NO_ID if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, and with it the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}"]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``pages(page_id, url, html)`` as rows ``archive, content``; an archive ends once it passes ``archive_bytes``."""
    dictionary = fit_dictionary(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = as_dictionary(dictionary)
        packer = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True)
        lead = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""
        task, number, out, size = TaskContext.get().partitionId(), 0, [lead], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{task:06d}-{number:06d}.warc.zst"], "content": [b"".join(out)]}, schema=pa.schema([("archive", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                frame = packer.compress(record_bytes(*r))
                out.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield row()
                    number, out, size = number + 1, [lead], 0
        if size:
            yield row()

    return plan_records(pages).mapInArrow(write, ARCHIVES)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and block headers."""
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        header = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
        if header & 1:
            return at + 4 * checksum


def split_frames(content: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """The decoded frames of one archive, one at a time, or what is wrong with them."""
    data, at, made = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        length = struct.unpack_from("<I", data, 4)[0]
        raw = bytes(data[8 : 8 + length])
        if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        made, at = as_dictionary(raw), 8 + length
    unpacker = zstandard.ZstdDecompressor(dict_data=made) if made else zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            magic, length = struct.unpack_from("<II", data, at)
            if magic & 0xFFFFFFF0 == 0x184D2A50:  # any other skippable frame
                at += 8 + length
                continue
            if magic != FRAME:
                raise ValueError("no Zstandard frame")
            end = frame_end(data, at)
            if end > len(data):
                raise ValueError("frame is cut off")
            frame = unpacker.decompressobj().decompress(data[at:end])
        except (struct.error, IndexError, ValueError, zstandard.ZstdError) as e:
            yield None, f"bad frame at byte {at}: {e}"
            return  # without the frame's end there is no way to the next
        yield frame, None
        at = end


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def parse_record(data: bytes) -> dict:
    """The fields of one record; ``problem`` names what is malformed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields, problem = _headers(lines[1:]), None
    length = fields.get("content-length", "")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]) or not gap:
        problem = "no WARC version line"
    elif missing := {"warc-type", "warc-record-id", "warc-date"} - fields.keys():
        problem = "missing " + ", ".join(sorted(missing))
    elif not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        problem = "Content-Length does not fit the block"
    block = rest[:-4]
    http, split, payload = block.partition(b"\r\n\r\n")
    inner = _headers(http.split(b"\r\n")[1:]) if split else {}
    declared, digest = inner.get("content-length", ""), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = fields.get("warc-type")
    if not problem and kind == "response" and (declared != str(len(payload)) or hashlib.sha256(payload).hexdigest() != digest):
        problem = "payload does not fit its length or digest"
    return {
        "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")),
        "payload_bytes": int(declared) if declared.isdigit() else None, "payload_digest": digest or None, "payload": payload if kind == "response" else None, "problem": problem,
    }


def read_archives(archives: DataFrame, name: str = "archive", content: str = "content") -> DataFrame:
    """One row per record of the archives in column ``content``."""
    schema = pa.schema([("archive", pa.string()), ("record", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for k, (frame, problem) in enumerate(split_frames(data.as_py() or b"")):
                    fields = parse_record(frame) if problem is None else {"problem": problem}
                    rows.append({"archive": archive.as_py(), "record": k} | fields)
                    size += len(frame or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select(F.col(name).cast("string"), F.col(content)).mapInArrow(read, RECORDS)


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select *, case when n >= 100 then min(page_id) over (partition by digest, n >= 100) end as first_id from p)
select page_id, n as payload_bytes, digest as payload_digest,
       case when page_id > first_id then 'revisit' else 'response' end as record_type,
       case when page_id > first_id then first_id end as refers_to
from f
"""
