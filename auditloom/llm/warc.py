"""Zstandard WARC archives: writing and reading.

An archive starts with a skippable frame that holds the dictionary, then has one
Zstandard frame for each record.  Readers load the dictionary from that frame, find the
end of each frame from its block headers, and check every record's header and lengths.

Of records with equal payloads of at least ``MIN_PAYLOAD`` bytes the one with the largest
id is written whole; the others are revisits that hold its HTTP head and refer to it.

Archives travel as rows (name, content) of bounded size.  ``read_archives`` takes any
frame with a binary ``content`` column, such as ``spark.read.format("binaryFile")`` gives.

Defined results.  A null payload is empty; a null address leaves its header out.  Rows of
equal id and payload that hold the largest id are all written whole.  A null id is never
referred to.  A record that fails a check comes back with ``error`` set and what could be
read of it.  An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

MIN_PAYLOAD = 1000
#: Bytes of records after which a task starts another archive.
ARCHIVE_BYTES = 8 << 20
#: The dictionary is trained from at most so many payloads' first bytes.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8192, 32 << 10
DATE = "2024-01-01T00:00:00Z"

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
_NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(identifier: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", identifier or "")
    return int(found[1]) if found else None


def write_record(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; ``digest`` is the payload's SHA-1 in hex."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
    fields["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not _NAME.fullmatch(name):
            raise ValueError(f"bad header line {line[:60]!r}")
        found[name.decode().lower()] = value.strip().decode()
    return found


def _length(fields: dict[str, str]) -> int:
    if not re.fullmatch(r"\d+", fields.get("content-length", "")):
        raise ValueError("no valid content length")
    return int(fields["content-length"])


def read_record(data: bytes) -> dict:
    """The parts of one record; ``error`` tells the first check that failed."""
    out = dict.fromkeys(("record_id", "record_type", "url", "refers_to", "payload_bytes", "payload_digest", "payload", "error"))
    try:
        head, gap, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.split(b"\r\n")
        if not gap or version != VERSION:
            raise ValueError("not a record of this version")
        fields = _fields(lines)
        out |= {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
        for name in ("warc-record-id", "warc-type", "warc-date", "warc-payload-digest"):
            if not fields.get(name):
                raise ValueError(f"no {name}")
        size = _length(fields)
        if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise ValueError(f"the block has {len(rest) - 4} bytes, not {size}")
        http, gap, payload = rest[:size].partition(b"\r\n\r\n")
        status, *lines = http.split(b"\r\n")
        if not gap or not status.startswith(b"HTTP/"):
            raise ValueError("no HTTP head")
        full = _length(_fields(lines))
        method, _, digest = fields["warc-payload-digest"].partition(":")
        if method != "sha1":
            raise ValueError(f"unknown digest {method}")
        out |= {"payload_bytes": full, "payload_digest": base64.b32decode(digest).hex()}
        if out["record_type"] == "revisit":
            if payload or not out["refers_to"] or fields.get("warc-profile") != PROFILE:
                raise ValueError("not a sound revisit")
        elif out["record_type"] == "response":
            out["payload"] = payload
            if len(payload) != full:
                raise ValueError(f"the payload has {len(payload)} bytes, not {full}")
            if hashlib.sha1(payload).hexdigest() != out["payload_digest"]:
                raise ValueError("the payload has another digest")
        else:
            raise ValueError(f"unknown type {out['record_type']}")
    except ValueError as fault:
        out["error"] = str(fault)
    return out


def frame_end(data: memoryview, start: int) -> int:
    """Where the Zstandard frame that begins at ``start`` ends."""
    if bytes(data[start : start + 4]) != FRAME_MAGIC:
        raise ValueError(f"no frame at {start}")
    try:
        at = start + zstandard.frame_header_size(bytes(data[start : start + 18]))
        summed = bool(data[start + 4] & 4)
        while True:
            block = int.from_bytes(data[at : at + 3], "little")
            if at + 3 > len(data):
                raise ValueError("cut off")
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
    except (zstandard.ZstdError, IndexError) as fault:
        raise ValueError(f"bad frame at {start}: {fault}") from fault
    at += 4 * summed
    if at > len(data):
        raise ValueError(f"the frame at {start} is cut off")
    return at


def start_of_archive(dictionary: bytes) -> bytes:
    """The leading skippable frame."""
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def open_archive(data: memoryview) -> tuple[zstandard.ZstdDecompressor, int]:
    """(a decompressor with the archive's dictionary, where the records start)."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return zstandard.ZstdDecompressor(), 0
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        raise ValueError("the dictionary frame is cut off")
    raw = bytes(data[8:end])
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
    if not raw:
        return zstandard.ZstdDecompressor(), end
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), end


def records(content: bytes) -> Iterator[dict]:
    """The records of one archive, one frame each."""
    data, broken = memoryview(content), dict.fromkeys(("record_id", "record_type", "url", "refers_to", "payload_bytes", "payload_digest", "payload"))
    try:
        reader, at = open_archive(data)
        while at < len(data):
            end = frame_end(data, at)
            try:
                # a frame's own size is not trusted: what it holds is counted as it comes
                yield read_record(reader.decompressobj().decompress(data[at:end]))
            except zstandard.ZstdError as fault:
                yield broken | {"error": f"frame at {at}: {fault}"}
            at = end
    except (ValueError, zstandard.ZstdError) as fault:
        yield broken | {"error": str(fault)}


def train_dictionary(pages: DataFrame, payload_col: str = "html") -> bytes:
    """A compression dictionary from a bounded sample; empty where there is too little."""
    sample = pages.select(F.substring(F.col(payload_col), 1, SAMPLE_BYTES).alias("x")).filter("length(x) > 0").limit(SAMPLE_ROWS)
    parts = [r["x"].encode() for r in sample.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes() if len(parts) > 7 else b""
    except zstandard.ZstdError:
        return b""


def _archive_rows(dictionary: bytes):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
        lead = start_of_archive(dictionary)
        parts, size = [lead], 0

        def archive() -> pa.RecordBatch:
            content = b"".join(parts)
            return pa.record_batch([[f"{hashlib.sha1(content).hexdigest()}.warc.zst"], pa.array([content], pa.binary())], ["name", "content"])

        for batch in batches:
            for page, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                parts.append(writer.compress(write_record(page, url, payload or b"", digest, refers_to)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    parts, size = [lead], 0
        if size:
            yield archive()

    return rows


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_payload: int = MIN_PAYLOAD,
    dictionary: bytes | None = None,
) -> DataFrame:
    """Archives as rows (name, content) with a record for each page."""
    ready(pages.sparkSession)
    if dictionary is None:
        dictionary = train_dictionary(pages, payload_col)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    whole = (
        rows.filter(F.octet_length("payload") >= min_payload)
        .groupBy("digest")
        .agg(F.max("page").alias("whole"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND whole IS NOT NULL")
        .select("digest", "whole")
    )
    marked = rows.join(whole, "digest", "left").select(
        "page", "url", "payload", "digest", F.when(~F.col("page").eqNullSafe(F.col("whole")), F.col("whole")).alias("refers_to")
    )
    return marked.mapInArrow(_archive_rows(dictionary), "name string, content binary")


_RECORD = "record_id string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string, page_id long, refers_to_page long"


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary(), "page_id": pa.int64(), "refers_to_page": pa.int64()}
    for batch in batches:
        for content in batch.column(0):
            found, size = [], 0
            for record in records(content.as_py() or b""):
                found.append(record | {"page_id": page_of(record["record_id"]), "refers_to_page": page_of(record["refers_to"])})
                size += len(record["payload"] or b"")
                if size >= ARCHIVE_BYTES:
                    yield _columns(found, kinds)
                    found, size = [], 0
            if found:
                yield _columns(found, kinds)


def _columns(found: list[dict], kinds: dict) -> pa.RecordBatch:
    names = [f.split()[0] for f in _RECORD.split(", ")]
    return pa.record_batch([pa.array([r[n] for r in found], kinds.get(n, pa.string())) for n in names], names)


def read_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """One row for each record of the archives, checked."""
    ready(archives.sparkSession)
    return archives.select(content_col).mapInArrow(_record_rows, _RECORD)
