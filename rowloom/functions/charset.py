"""Charsets: bytes of a line to text and back. A text column read raw still holds its bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOM = "\ufeff"

# Charsets read and written, and the one taken when a source is not valid UTF-8.
UTF8, LATIN1, LATIN9, CP1252 = "UTF-8", "ISO-8859-1", "ISO-8859-15", "windows-1252"
SINGLE_BYTE = {LATIN1: "latin-1", LATIN9: "iso8859-15", CP1252: "cp1252"}
CHARSETS = (UTF8, *SINGLE_BYTE)
FALLBACK = CP1252
# Known by their byte order mark, and text already when a line is read.
UTF16LE, UTF16BE = "UTF-16LE", "UTF-16BE"


def _differences(charset: str) -> tuple[str, str]:
    """Characters of ``charset`` that differ from ISO-8859-1: as read in ISO-8859-1, and as meant."""
    read, meant = [], []
    for byte in range(128, 256):
        char = bytes([byte]).decode(SINGLE_BYTE[charset], errors="replace")
        if char not in (chr(byte), "\ufffd"):
            read.append(chr(byte))
            meant.append(char)
    return "".join(read), "".join(meant)


def _decode_single(data: Column, charset: str) -> Column:
    text = F.decode(data, LATIN1)
    read, meant = _differences(charset)
    # Moving characters is slow, and few texts need it. One range is found faster than a set of characters.
    return F.when(text.rlike(f"[{min(read)}-{max(read)}]"), F.translate(text, read, meant)).otherwise(text) if read else text


def decode_raw(raw: Column, encoding: Column | str) -> Column:
    """Raw line -> text. Bytes that are not valid UTF-8 become the replacement character."""
    data = raw.cast("binary")
    if isinstance(encoding, str):
        encoding = F.lit(encoding)
    chain = F.when(encoding == UTF8, F.make_valid_utf8(raw))
    for charset in SINGLE_BYTE:
        chain = chain.when(encoding == charset, _decode_single(data, charset))
    return chain.otherwise(F.make_valid_utf8(raw))


def encode_raw(text: Column, charset: str) -> Column:
    """Text -> raw bytes in a text column; characters the charset lacks become ``?``."""
    if charset == UTF8:
        return text
    if charset in (UTF16LE, UTF16BE):
        return F.encode(text, charset).cast("string")
    read, meant = _differences(charset)
    safe = F.regexp_replace(text, r"[^\x00-\xFF]", "?")
    if read:
        # A character whose place is taken cannot be written; the others move to their byte.
        moved = F.translate(F.translate(text, read, "?" * len(read)), meant, read)
        same = f"\\x00-{chr(ord(min(read)) - 1)}{chr(ord(max(read)) + 1)}-\\xFF"
        safe = F.when(text.rlike(f"[^{same}]"), F.regexp_replace(moved, r"[^\x00-\xFF]", "?")).otherwise(text)
    # ASCII has the same bytes in all of them
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.encode(safe, LATIN1).cast("string"))
