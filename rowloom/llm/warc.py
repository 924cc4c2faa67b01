"""WARC archives: written with revisits for equal payloads, read back with salvage of damaged files.

Writer: one record per page, each a gzip member of its own (or plain, if asked for). Of pages with equal payloads
the one with the smallest id is a ``response``; the others are ``revisit`` records without payload that refer to it.

Reader: a record is taken if its member inflates with the right checksum, its version line and headers parse, its
length fits, and its digests are right. After a failed check the reader looks for the next gzip member or version
line from which a whole valid record can be read, reports the bytes in between as a gap with its reason, and
goes on there. So every intact record of a damaged file is recovered, and records and gaps cover every byte. Files
are read by a window of bounded size; one record is held at a time. A record of more than ``RECORD_BYTES`` (headers
included, inflated) is a gap with that reason.

Headers may be folded over lines, and stand once each. SHA-1 digests are compared as bytes, written in base32 of either case or in hex; those
of other algorithms are not checked, nor is the payload digest of a body in chunked transfer or of one segment of a
record. The payload of an HTTP response is its body, that of any other record its block.

Defined results: a null or empty page is an empty payload, and such payloads are equal; a null id counts as the
largest; pages that repeat the smallest id of a payload are all responses. An empty table gives no archives. An empty
file has neither records nor gaps. Other columns of the pages are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.components import written
from rowloom.llm.files import locate, new_file
from rowloom.llm.text import map_batches
from rowloom.session import checked_broadcast, scratch_path

FILE_BYTES = 64 << 20  # an archive is closed when it has this size
WINDOW = 1 << 20
RECORD_BYTES = 256 << 20  # a larger record is not read
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/"
# Fixed value of the format: the profile of a revisit with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "<urn:x-page:%s>"
RECORDS = ("kind string, path string, offset bigint, length bigint, record_type string, record_id string, "
           "target_uri string, refers_to string, payload_digest string, payload_bytes bigint, reason string")


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_value(text: str) -> str:
    """A value that stays on its line."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in text or "\n" in text else text


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {ID % page_id}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: {ID % refers_to}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, target: str | None = None, key: str = "page_id", url: str = "url", html: str = "html",
                   compress: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row below ``target``; returns ``(path, records)`` of the archives, a table in the shared folder."""
    spark = pages.sparkSession
    folder = target or scratch_path(spark, "warc")
    rows = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    firsts = rows.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Only payloads that occur more than once; broadcast if they are few, else joined by a shuffle.
    marked = rows.join(checked_broadcast(written(firsts, "payloads")), "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, records, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, target_uri, text, first, again in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    path, out = new_file(folder, "pages")
                    size, records = 0, 0
                data = record(page_id, target_uri, text.encode(), first, again)
                data = gzipped(data) if compress else data
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())],
                                             names=["path", "records"])

    stored = map_batches(marked.select("id", "url", "html", "first", revisit.alias("again")), store, "path string, records bigint")
    return written(stored, "archives")


class Window:
    """Random access to a file of any size, by blocks."""

    def __init__(self, file: Any) -> None:
        self.file, self.size = file, file.size()
        self.at, self.block = 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.block)):
            self.at, self.block = at, self.file.read_at(min(max(n, WINDOW), self.size - at), at)
        return self.block[at - self.at : at - self.at + n]

    def find(self, mark: bytes, at: int) -> int:
        """First place of ``mark`` at or after ``at``, or the size of the file."""
        while at < self.size:
            part = self.get(at, WINDOW)
            if (k := part.find(mark)) >= 0:
                return at + k
            if at + len(part) >= self.size:
                break
            at += len(part) - len(mark) + 1
        return self.size


class Damaged(Exception):
    pass


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of a record, and the bytes it takes with its end."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("headers do not end")
    headers = headers_of(data[:end])
    first, last = end + 4, end + 4 + length_of(headers)
    if len(data) < last:
        raise Damaged("record is cut off")
    if data[last : last + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    block = data[first:last]
    check(headers, block)
    return headers, block, last + 4


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not (lines[0].startswith("WARC/1.") and len(lines[0]) <= 10):
        raise Damaged("no version line")
    headers: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name is not None:  # a folded value
            headers[name] = f"{headers[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header without colon")
        name = name.strip().lower()
        if name in headers and name != "warc-concurrent-to":
            raise Damaged("a header stands twice")  # as where one record was cut off inside its headers
        headers[name] = value.strip()
    length_of(headers)
    if "warc-type" not in headers:
        raise Damaged("a needed header is missing")
    return headers


def length_of(headers: dict[str, str]) -> int:
    """The length of the block; plain digits, as many as any file can need."""
    if not re.fullmatch(r"[0-9]{1,18}", said := headers.get("content-length", "")):
        raise Damaged("length is no number" if said else "a needed header is missing")
    return int(said)


def check(headers: dict[str, str], block: bytes) -> None:
    if wrong(headers.get("warc-block-digest", ""), block):
        raise Damaged("block digest is wrong")
    whole = headers["warc-type"] in ("response", "resource", "request") and "warc-segment-number" not in headers
    if whole and not (is_http(headers) and chunked(block)) and wrong(headers.get("warc-payload-digest", ""), payload_of(headers, block)):
        raise Damaged("payload digest is wrong")


def wrong(said: str, data: bytes) -> bool:
    """Whether a digest, as it stands in a header, is not the one of ``data``; other algorithms are not checked."""
    algorithm, _, value = said.partition(":")
    if algorithm.strip().lower() not in ("sha1", "sha-1"):
        return False
    value = value.strip().rstrip("=")
    try:
        digest = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except (ValueError, binascii.Error):
        return True
    return digest != hashlib.sha1(data).digest()


def is_http(headers: dict[str, str]) -> bool:
    implied = "" if headers["warc-type"] == "resource" else "application/http"
    return headers.get("content-type", implied).lower().startswith("application/http")


def chunked(block: bytes) -> bool:
    """Whether the body of an HTTP message is in chunks, with or without which its digest may have been taken."""
    return bool(re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", block.partition(b"\r\n\r\n")[0]))


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if is_http(headers) else block


def record_at(window: Window, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and stored length of the valid record at ``at``; raises if there is none."""
    start = window.get(at, 5)
    if start[:3] == MEMBER:
        unpack, parts, place, room = zlib.decompressobj(31), [], at, RECORD_BYTES
        try:
            while not unpack.eof:
                raw = window.get(place, 1 << 16)
                if not raw:
                    raise Damaged("member is cut off")
                part = unpack.decompress(raw, room + 1)
                room -= len(part)
                if room < 0:
                    raise Damaged(f"record is larger than {RECORD_BYTES} bytes")
                if not parts and part and not (part[:5] == VERSION[: len(part)]):
                    raise Damaged("member holds no record")
                parts.append(part)
                place += len(raw) - len(unpack.unused_data)
        except zlib.error as problem:
            raise Damaged(f"member does not inflate: {problem}") from None
        data = b"".join(parts)
        headers, block, taken = parse(data)
        if taken != len(data):
            raise Damaged("member holds more than its record")
        return headers, block, place - at
    if start == VERSION:
        size = 1 << 14
        while (end := (head := window.get(at, size)).find(b"\r\n\r\n")) < 0:
            if len(head) < size or size > 1 << 20:
                raise Damaged("headers do not end")
            size *= 4
        headers = headers_of(head[:end])
        need = end + 8 + length_of(headers)
        if at + need > window.size:
            raise Damaged("record is cut off")
        if need > RECORD_BYTES:
            raise Damaged(f"record is larger than {RECORD_BYTES} bytes")
        headers, block, taken = parse(window.get(at, need))
        return headers, block, taken
    raise Damaged("neither a member nor a version line")


def salvage(window: Window) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """``(offset, length, headers, block, None)`` of each record, ``(offset, length, None, b"", reason)`` of each gap."""
    at, gap, why = 0, None, None
    following = {MEMBER: -1, VERSION: -1}  # next places of the marks, looked up again only when passed
    while at < window.size:
        try:
            headers, block, length = record_at(window, at)
        except Damaged as problem:
            if gap is None:
                gap, why = at, str(problem)
            for mark, place in following.items():
                if place <= at:
                    following[mark] = window.find(mark, at + 1)
            at = min(following.values())
            continue
        if gap is not None:
            yield gap, at - gap, None, b"", why
            gap = None
        yield at, length, headers, block, None
        at += length
    if gap is not None:
        yield gap, window.size - gap, None, b"", why


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and gaps of the files named in ``archives(path)``; ``kind`` is ``record`` or ``gap``."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = locate(path)
                with system.open_input_file(place) as file:
                    rows = []
                    for at, length, headers, block, reason in salvage(Window(file)):
                        if headers is None:
                            rows.append(("gap", path, at, length, *[None] * 6, reason))
                        else:
                            rows.append(("record", path, at, length, *described(headers, block), None))
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))), schema=schema())

    def schema() -> pa.Schema:
        kinds = {"string": pa.string(), "bigint": pa.int64()}
        return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in RECORDS.split(", "))])

    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_batches(archives.select("path").repartition(parts), load, RECORDS)


def described(headers: dict[str, str], block: bytes) -> tuple[str, str | None, str | None, str | None, str | None, int]:
    """Type, id, URI, reference, digest and full payload size of a record."""
    size = len(payload_of(headers, block))
    if headers["warc-type"] == "revisit":  # the payload is elsewhere; the HTTP header keeps its size
        for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and re.fullmatch(rb"[0-9]{1,18}", value.strip()):
                size = int(value)
    digest = headers.get("warc-payload-digest")
    return (
        headers["warc-type"], headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-refers-to"),
        digest.removeprefix("sha1:") if digest else None, size,
    )
