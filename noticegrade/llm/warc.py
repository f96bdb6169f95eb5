"""WARC archives of pages, written by Spark, and a salvage reader for archives with damage.

``write_archives`` makes a record of every page in the engine's own expressions, compresses each
in a gzip member of its own, and writes the archives with Spark's text writer, so they go to
whatever store the folder is in. ``read_archives``
reads whole archive files. Every record is checked: version line, headers, length, the blank
lines after the block, and the payload's digest. Where a check fails the reader looks for the
next place at which a record passes all checks, goes on from there, and logs the bytes between
as a gap, with the first reason. In compressed archives the same is done with members: what a
damaged member gives up to the very byte that fails is used, then the next valid member is
looked for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrade.llm.words import small_batches

#: Bytes of an archive file, about, and the packs of records that make it up.
FILE_BYTES, PACKS = 32 << 20, 128
#: Records of an archive file that is compressed by the text writer, or not at all.
FILE_RECORDS = 4000
#: Rows that the reader hands on at a time.
_ROWS_AT_ONCE = 500
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_MEMBER = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")


def payload_digest(payload: Column) -> Column:
    """Base-32 SHA-1 of a text's UTF-8 bytes: 20 bits, so 5 hex digits and 4 letters, at a time."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One record per row of ``pages`` as ``value``, without its last line feed.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of ``least_bytes`` or more,
    the one with the largest page_id is a response and the others revisit it. Rows that repeat
    that page_id with that payload are responses too. A null page_id is smaller than any other;
    if a payload has only null ids, all of them are responses. A null url has no header. Line
    ends in a url are percent-encoded. Other columns aren't looked at.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", payload_digest(F.col("payload"))).withColumn("size", F.octet_length("payload"))
    held = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(held.filter("n > 1").select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    head = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    lines = [
        F.lit(VERSION),
        head("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        head("WARC-Record-ID", name("page_id")),
        head("WARC-Target-URI", uri),
        head("WARC-Date", F.lit(_DATE)),
        head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, head("WARC-Profile", F.lit(PROFILE))),
        F.when(revisit, head("WARC-Refers-To", name("first"))),
        head("X-Payload-Length", F.col("size").cast("string")),
        head("Content-Type", F.lit("text/html; charset=utf-8")),
        head("Content-Length", F.octet_length(block).cast("string")),
        F.lit(""),
        block,
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r")).alias("value"))


def _member_of(value: str) -> bytes:
    """A record's gzip member without its last byte, which is 0."""
    data = value.encode() + b"\n"
    member = zlib.compress(data, 6, 31)
    if member[-1]:  # the length's last byte, from 16 MB on: an empty member after it ends with 0
        member += zlib.compress(b"", 6, 31)
    return member[:-1]


def _packs(values: Iterator[str], most: int) -> Iterator[bytes]:
    """The members of some records, gathered to packs of at most ``most`` bytes; a larger member is a pack of its own."""
    pack, size = [], 0
    for member in map(_member_of, values):
        if pack and size + len(member) >= most:
            yield b"\0".join(pack)
            pack, size = [], 0
        pack.append(member)
        size += len(member) + 1
    if pack:
        yield b"\0".join(pack)


def write_archives(
    pages: DataFrame, folder: str, compression: str = "gzip", least_bytes: int = 0, file_bytes: int = FILE_BYTES
) -> None:
    """Write ``pages`` as archives below ``folder``.

    With gzip every record is a member of its own, so damage in one leaves the others whole. The
    text writer doesn't know of the members: their files are named as plain text. A file has at
    most ``PACKS`` packs of members, each of at most ``file_bytes / PACKS`` bytes or one member, so
    only records larger than a pack make a file longer than ``file_bytes``. Any other
    ``compression`` is the text writer's, with ``FILE_RECORDS`` records to a file.
    """
    out, separator, most = records(pages, least_bytes), "\n", FILE_RECORDS

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            packs = list(_packs((value.as_py() for value in batch.column("value")), file_bytes // PACKS))
            yield pa.RecordBatch.from_arrays([pa.array(packs, pa.binary())], names=["value"])

    if compression == "gzip":
        # what the writer puts between lines is the packs' last byte
        out, separator, most = out.mapInArrow(members, "value binary").select(F.col("value").cast("string")), "\0", PACKS
        compression = "none"
    writer = out.write.option("lineSep", separator).option("maxRecordsPerFile", most)
    writer.option("compression", compression).text(folder)


@dataclass
class Found:
    """A record, or a gap if ``reason`` is set. Offsets are in the file, or in a member's content."""

    offset: int
    length: int
    reason: str | None = None
    headers: dict[str, str] | None = None
    block: bytes = b""
    member: int = 0


def _record(data: bytes, at: int) -> tuple[Found | None, str]:
    """The record at ``at`` if it passes all checks, or why it doesn't."""
    version = _VERSION_LINE.match(data, at)
    if not version:
        return None, "no version line"
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        return None, "headers without an end"
    headers = {}
    for line in data[version.end() : end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None, "bad header"
        headers[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isdigit():
        return None, "no length"
    start = end + 4
    stop = start + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, "wrong length"
    block = data[start:stop]
    wanted = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and wanted.startswith("sha1:") and wanted[5:] != base32_sha1(block):
        return None, "wrong digest"
    return Found(at, stop + 4 - at, None, headers, block), ""


def base32_sha1(block: bytes) -> str:
    return base64.b32encode(hashlib.sha1(block).digest()).decode()


def salvage_records(data: bytes) -> Iterator[Found]:
    """Records of an uncompressed archive, and a gap for every run of bytes that gave none."""
    at = gap = 0
    why = ""
    while at < len(data):
        found, reason = _record(data, at)
        if found:
            if gap < at:
                yield Found(gap, at - gap, why)
            yield found
            at = gap = at + found.length
            continue
        why = reason if at == gap else why
        line = _VERSION_LINE.search(data, at + 1)
        at = line.start() if line else len(data)
    if gap < len(data):
        yield Found(gap, len(data) - gap, why)


def _before_damage(data: bytes, at: int, pos: int) -> bytes:
    """All that the member at ``at`` gives before it fails, which is in the piece at ``pos``."""
    step = zlib.decompressobj(31)
    out = [step.decompress(data[at:pos])]
    with suppress(zlib.error):  # a call that fails gives nothing, so a byte at a time
        for k in range(pos, len(data)):
            out.append(step.decompress(data[k : k + 1]))
    return b"".join(out)


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(content, end, what is wrong) of the member at ``at``; content as far as it came."""
    step = zlib.decompressobj(31)
    out, pos = [], at
    while pos < len(data) and not step.eof:
        piece = data[pos : pos + 65536]
        try:
            out.append(step.decompress(piece))
        except zlib.error as error:
            return _before_damage(data, at, pos), pos, f"bad member: {error}"
        pos += len(piece)
    if not step.eof:
        return b"".join(out), len(data), "member without an end"
    return b"".join(out), pos - len(step.unused_data), ""


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive file, compressed (many members or one) or not."""
    if _VERSION_LINE.match(data):
        yield from salvage_records(data)
        return
    at = gap = number = 0
    why = "no member"
    while at < len(data):
        content, end, wrong = _member(data, at) if data.startswith(_MEMBER, at) else (b"", at, "no member")
        for found in salvage_records(content):
            if found.reason is None or not wrong:
                found.member = number
                yield found
        number += bool(content)
        if not wrong:
            if gap < at:
                yield Found(gap, at - gap, why)
            at = gap = end
            continue
        why = wrong if at == gap else why
        following = data.find(_MEMBER, at + 1)
        plain = _VERSION_LINE.search(data, at + 1)
        if plain and (following < 0 or plain.start() < following):
            yield Found(gap, plain.start() - gap, why)
            stop = following if following >= 0 else len(data)
            for found in salvage_records(data[plain.start() : stop]):
                found.offset += plain.start()
                yield found
            at = gap = stop
            continue
        at = following if following >= 0 else len(data)
    if gap < len(data):
        yield Found(gap, len(data) - gap, why)


def _id(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


_ROWS = (
    "archive string, member long, start long, length long, gap string, record_type string, page_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long"
)


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """A row for every record and every gap of the archives below ``folder``.

    Rows of gaps have the reason in ``gap`` and no record; rows of records have ``gap`` null.
    ``start`` and ``length`` are bytes of the file, or of the content of ``member`` in a compressed
    one. With ``payload`` the blocks come along as text. An empty file has no rows.
    """
    names = [part.split()[0] for part in _ROWS.split(", ")] + ["payload"] * payload

    def row(path: str, found: Found) -> tuple:
        place = (path, found.member, found.offset, found.length, found.reason)
        if found.reason is not None:
            return (*place, *[None] * (6 + payload))
        h = found.headers
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or base32_sha1(found.block)
        size = int(h.get("x-payload-length", len(found.block)))
        known = (h.get("warc-type"), _id(h.get("warc-record-id")), h.get("warc-target-uri"), size, digest, _id(h.get("warc-refers-to")))
        return (*place, *known, *[found.block.decode("utf-8", "replace")] * payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = path.as_py()
                for part in batched((row(name, found) for found in salvage(content.as_py())), _ROWS_AT_ONCE):
                    columns = zip(*part, strict=True)
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds + [pa.string()] * payload, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(read, _ROWS + ", payload string" * payload)
