"""The salvage reader on hostile headers, folded lines, digests of many forms, and random damage."""

import base64
import hashlib
import io
import random

import pytest

from rowloom.llm import warc


class File(io.BytesIO):
    """As the files of pyarrow: size() and read_at()."""

    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def read(data):
    return list(warc.salvage(warc.Window(File(data))))


def kinds(data):
    return ["gap" if headers is None else headers["warc-type"] for _, _, headers, _, _ in read(data)]


def plain(headers, block=b"abc"):
    return b"WARC/1.0\r\n" + "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


GOOD = warc.record(1, "http://a/", b"<p>1", None, False)
SHA = hashlib.sha1(b"abc").digest()


@pytest.mark.parametrize("length", ["²", "9" * 5000, "-3", "+3", "3.0", "0x3", "", " ", "1" * 18, "٣"])
def test_hostile_lengths_are_gaps(length):
    bad = plain(["WARC-Type: resource", f"Content-Length: {length}"])
    for data in (bad + GOOD, warc.gzipped(bad) + warc.gzipped(GOOD)):
        assert kinds(data) == ["gap", "response"]


@pytest.mark.parametrize("digest", [
    "sha1:" + base64.b32encode(SHA).decode(), "sha1:" + base64.b32encode(SHA).decode().lower(), "SHA1:" + SHA.hex(),
    "sha-1: " + SHA.hex().upper(), "sha256:" + "0" * 64, "md5:wrong", "nonsense", "",
])
def test_digests_of_intact_records(digest):
    lines = ["WARC-Type: resource", "Content-Type: text/plain", f"WARC-Block-Digest: {digest}", f"WARC-Payload-Digest: {digest}", "Content-Length: 3"]
    for data in (plain(lines), warc.gzipped(plain(lines))):
        assert kinds(data) == ["resource"]
        wrong = kinds(plain(lines, b"abd"))
        assert wrong == (["gap"] if digest.lower().startswith(("sha1", "sha-1")) else ["resource"])


@pytest.mark.parametrize("digest", ["sha1:", "sha1:!!!", "sha1:" + "0" * 40, "sha1:" + "z" * 40, "sha1:ABC"])
def test_unreadable_digests_fail(digest):
    assert kinds(plain(["WARC-Type: resource", f"WARC-Block-Digest: {digest}", "Content-Length: 3"])) == ["gap"]


def test_folded_headers():
    data = plain(["WARC-Type:", " resource", "X-Note: one", "\ttwo", "Content-Length:\t", " 3"])
    (_, _, headers, block, _), = read(data)
    assert (headers["warc-type"], headers["x-note"], block) == ("resource", "one two", b"abc")
    assert kinds(b"WARC/1.0\r\n folded\r\n\r\nabc\r\n\r\n") == ["gap"]


def test_payloads_that_are_no_http_body():
    digest = warc.digest_of(b"abc")
    assert kinds(plain(["WARC-Type: response", "Content-Type: text/dns", f"WARC-Payload-Digest: sha1:{digest}", "Content-Length: 3"])) == ["response"]
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    lines = ["WARC-Type: response", "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(body)}"]
    assert kinds(plain(lines, body)) == ["response"]


def test_large_http_length_of_a_revisit():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\n"
    (_, _, headers, got, _), = read(plain(["WARC-Type: revisit", f"Content-Length: {len(block)}"], block))
    assert warc.described(headers, got)[-1] == 0


def test_a_member_that_inflates_without_end_is_a_gap(monkeypatch):
    monkeypatch.setattr(warc, "RECORD_BYTES", 1 << 16)
    bomb = warc.gzipped(plain(["WARC-Type: resource", "Content-Length: 10000000"], bytes(10_000_000)))
    found = read(bomb + warc.gzipped(GOOD))
    assert [f[2] is None for f in found] == [True, False] and "larger" in found[0][4]
    assert kinds(plain(["WARC-Type: resource", "Content-Length: 100000"], bytes(100_000)) + GOOD) == ["gap", "response"]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("seed", range(60))
def test_random_damage(seed, compress):
    """Records and gaps cover every byte once, and a record whose bytes are untouched is found."""
    rng = random.Random(seed)
    records = []
    for i in range(12):
        payload = bytes(rng.choices(b"WARC/1.\r\n\x1f\x8b\x08 <p>ab", k=rng.randrange(400)))
        data = warc.record(i, f"http://h/{i}", payload, None if i % 3 else 0, i % 3 == 0)
        records.append(warc.gzipped(data) if compress else data)
    pieces = []  # bytes, and the number of the record that they are whole
    for i, data in enumerate(records):
        if rng.random() < 0.6:
            pieces.append((data, i))
            continue
        at, how = rng.randrange(len(data)), rng.randrange(4)
        noise = bytes(rng.choices([rng.randrange(256), 31, 139, 8, 87], k=rng.randrange(1, 50)))
        changed = [data[:at] + bytes([data[at] ^ 1 << rng.randrange(8)]) + data[at + 1 :], data[:at], data[at + 1 :],
                   data[:at] + noise + data[at:]][how]
        pieces.append((changed, None))
        if rng.random() < 0.3:
            pieces.append((noise, None))
    whole, place = {}, 0
    for data, i in pieces:
        if i is not None:
            whole[place] = (i, len(data))
        place += len(data)
    found = read(b"".join(d for d, _ in pieces))
    assert [f[0] for f in found] == [0, *(f[0] + f[1] for f in found)][:-1]
    assert sum(f[1] for f in found) == place and all(f[1] > 0 for f in found)
    taken = {f[0]: (f[2].get("warc-record-id"), f[1]) for f in found if f[2] is not None}
    for at, (i, n) in whole.items():
        assert taken.get(at) == (warc.ID % i, n)
    assert all((f[2] is None) == (f[4] is not None) for f in found)
