"""Secret scan: patterns, and encoded candidates that are reported only once their structure is confirmed.

Patterns find assignments to names such as ``token``, access identifiers and runs of lower
case hexadecimal digits. Beside them every long run of base64 or hexadecimal characters is a
candidate. It is decoded and read by the structure that it would have as a secret, and
reported only if all of it holds together:

* ``jwt``: a signed or encrypted token, whose header is a JSON object that names an algorithm
  and whose claims are a JSON object (of an encrypted one the header names the encryption and
  five parts are there);
* ``key``: a private key in DER (RSA, DSA, elliptic curve, PKCS#8, also encrypted) or in the
  OpenSSH container. The lengths of all nested elements must fill their parents exactly; of an
  RSA key the modulus must be the product of its primes. The outer length says where the key
  ends, so text that follows does no harm, and line breaks, real or written as ``\\n``, may lie within;
* ``encoded``: base64 or hexadecimal digits of readable text in which an assignment, an access
  identifier, a token or a key is found, to a depth of two.

Public keys, certificates, hashes and other random bytes are not reported. Keys in the old PEM
encryption can't be told from random bytes and aren't either.

Spans are code points, the end exclusive. Each kind's matches are leftmost and don't overlap;
different kinds may. Null texts are empty and hold nothing. Texts are read whole, however
long; repeated rows have rows of their own, null ids too. Other columns don't matter, whatever
their names. No rows give no rows.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, whole

BASE = ("assign", "access", "hex")
#: In the order in which spans of one start are listed.
KINDS = (*BASE, "jwt", "key", "encoded")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_CANDIDATE, DEPTH = 6, 20, 24, 20, 2
#: Beyond so many bits of a modulus its lengths suffice.
MOST_BITS = 1 << 14

# The first is for text in lower case, where it has the matches that either case has in the text.
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4))
_HEX = re.compile(rb"[0-9a-f]{%d,}" % LEAST_HEX)
_TOKEN = re.compile(rb"e[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?")
_BREAK = rb"(?:\r?\n[ \t]*|(?:\\r)?\\n)"
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{%d,}(?:%s[A-Za-z0-9+/_-]+)*={0,2}" % (LEAST_CANDIDATE, _BREAK))
_PIECE = re.compile(rb"(?:\\r)?\\n|[A-Za-z0-9+/_-]+")
_HEX_DIGITS = re.compile(rb"[0-9a-fA-F]+")
_URL_SAFE = bytes.maketrans(b"-_", b"+/")
_TOKEN_BYTE = re.compile(rb"[A-Za-z0-9_-]")

#: The content of object identifiers of key algorithms and of password-based encryption.
RSA, EC, ED25519 = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2b6570")
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: DER tags.
INTEGER, BITS, OCTETS, OID, SEQUENCE, TAGGED_0, TAGGED_1 = 0x02, 0x03, 0x04, 0x06, 0x30, 0xA0, 0xA1


def unbase64(text: bytes) -> bytes | None:
    """Bytes of base64 in either alphabet; without padding, a last group may be short."""
    text = text.rstrip(b"=").translate(_URL_SAFE)
    return None if len(text) % 4 == 1 else base64.b64decode(text + b"=" * (-len(text) % 4))


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the content of the DER element at ``at``, if its length is well formed and fits."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 0 < k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def elements(data: bytes, at: int, end: int, most: int = 16) -> list[tuple[int, int, int]] | None:
    """The elements that fill a range exactly, at most ``most`` of them."""
    out = []
    while at < end:
        one = element(data, at, end)
        if one is None or len(out) == most:
            return None
        out.append(one)
        at = one[2]
    return out


def private_key(data: bytes) -> tuple[str, int] | None:
    """What kind of private key ``data`` begins with, and how many bytes it takes."""
    if data.startswith(b"openssh-key-v1\0"):
        end = _openssh(data)
        return ("openssh", end) if end else None
    outer = element(data, 0, len(data))
    if outer is None or outer[0] != SEQUENCE:
        return None
    kind = _inside(data, outer[1], outer[2])
    return (kind, outer[2]) if kind else None


def _inside(data: bytes, at: int, end: int) -> str | None:
    parts = elements(data, at, end)
    if not parts or len(parts) < 2:
        return None
    tags = [p[0] for p in parts]
    content = lambda k: data[parts[k][1] : parts[k][2]]
    number = lambda k: int.from_bytes(content(k), "big")
    if set(tags) == {INTEGER} and all(p[1] < p[2] for p in parts) and number(0) <= 1:
        if len(tags) == 9:
            size = 8 * (parts[1][2] - parts[1][1])
            return "rsa" if 256 <= size and (size > MOST_BITS or number(1) == number(4) * number(5)) else None
        if len(tags) == 6:
            return "dsa" if number(1) > number(2) > number(5) > 0 and number(1) > number(4) and number(1).bit_length() >= 512 else None
        return None
    if tags[:2] == [INTEGER, OCTETS] and content(0) == b"\x01" and 16 <= len(content(1)) <= 72 and tags[2:] in ([], [TAGGED_0], [TAGGED_1], [TAGGED_0, TAGGED_1]):
        inner = [elements(data, a, b, 1) for _, a, b in parts[2:]]
        return "ec" if all(x and x[0][0] == (OID if t == TAGGED_0 else BITS) for x, t in zip(inner, tags[2:], strict=True)) else None
    of = tags.index(SEQUENCE) if SEQUENCE in tags[:2] else None
    named = elements(data, *parts[of][1:]) if of is not None else None
    if not named or named[0][0] != OID:
        return None
    oid = data[named[0][1] : named[0][2]]
    if of == 0:
        return "encrypted" if tags == [SEQUENCE, OCTETS] and oid.startswith(PASSWORD_BASED) and len(content(1)) >= 16 else None
    if tags[0] != INTEGER or content(0) not in (b"\0", b"\1") or tags[2:3] != [OCTETS] or any(t not in (TAGGED_0, TAGGED_1, 0x81) for t in tags[3:]):
        return None
    inner = element(data, *parts[2][1:])
    if inner is None or inner[2] != parts[2][2]:
        return None
    if oid == ED25519:
        return "ed25519" if inner[0] == OCTETS and inner[2] - inner[1] == 32 else None
    own = _inside(data, inner[1], inner[2]) if inner[0] == SEQUENCE else None
    if oid in (RSA, EC):
        return own if own == ("rsa" if oid == RSA else "ec") else None
    return "pkcs8" if inner[0] in (SEQUENCE, OCTETS, INTEGER) else None


def _openssh(data: bytes) -> int | None:
    """The end of an OpenSSH key container whose nested lengths fit."""
    at = len(b"openssh-key-v1\0")

    def taken() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if len(data) < at + 4 + n:
            return None
        at += 4 + n
        return data[at - n : at]

    cipher, kdf, options = taken(), taken(), taken()
    keys = int.from_bytes(data[at : at + 4], "big")
    if not cipher or not kdf or options is None or not 1 <= keys <= 16:
        return None
    at += 4
    public = [taken() for _ in range(keys)]
    secret = taken()
    if any(p is None or not re.match(rb"\0\0\0[\x07-\x40](ssh-|ecdsa-|sk-)", p) for p in public) or not secret or len(secret) % 8:
        return None
    return at if cipher != b"none" or secret[:4] == secret[4:8] else None


def token_end(found: bytes) -> int | None:
    """How much of a dotted candidate is a token."""
    parts = found.split(b".")
    try:
        header = json.loads(unbase64(parts[0]) or b"")
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return None
        if isinstance(header.get("enc"), str):
            return len(found) if len(parts) == 5 else None
        claims = json.loads(unbase64(parts[1]) or b"")
    except (ValueError, RecursionError):
        return None
    if not isinstance(claims, dict) or not (parts[2] or header["alg"] == "none"):
        return None
    return sum(map(len, parts[:3])) + 2


def _pieces(data: bytes, start: int, end: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The characters of a candidate without its line breaks, and where its pieces lie."""
    spans = [m.span() for m in _PIECE.finditer(data, start, end) if data[m.start()] != 0x5C]
    return b"".join(data[a:b] for a, b in spans), spans


def _readable(data: bytes) -> bool:
    return not data.translate(None, bytes(range(32, 127)) + b"\t\r\n" + bytes(range(128, 256)))


def _holds(raw: bytes, depth: int) -> bool:
    """Whether ``raw`` is readable text with a secret in it."""
    if depth == DEPTH or len(raw) < 10 or not _readable(raw):
        return False
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return any(kind != "hex" for kind, *_ in _found(raw, depth + 1))


def _confirmed(data: bytes, start: int, end: int, depth: int) -> tuple[str, int, int] | None:
    """The kind of secret that a run of base64 or hexadecimal characters begins with, and its span."""
    text, spans = _pieces(data, start, end)
    digits = _HEX_DIGITS.match(text)
    digits = digits[0][: len(digits[0]) & ~1] if digits else b""
    line = text[: spans[0][1] - spans[0][0]]
    # Characters, the bytes they stand for, and how many characters stand for how many bytes. What
    # follows a secret may have been taken for a last line of it: a key says itself where it ends.
    ways = [(digits, bytes.fromhex(digits.decode()), 2, 1)] if len(digits) >= LEAST_CANDIDATE else []
    for chars in dict.fromkeys([text, line]):
        ways.append((chars, unbase64(chars) or unbase64(chars[: len(chars) & ~3]) or b"", 4, 3))

    def upto(need: int) -> int:
        for a, b in spans:
            if need <= b - a:
                at = a + need
                break
            need -= b - a
        while at < end and data[at : at + 1] == b"=":
            at += 1
        return at

    for chars, raw, of, per in ways:
        if key := private_key(raw):
            return "key", start, upto(-(-key[1] * of // per))
        if _holds(raw, depth):
            return "encoded", start, upto(len(chars))
    return None


def _found(data: bytes, depth: int = 0) -> list[tuple[str, int, int]]:
    """Kinds and spans in bytes, each kind's in order."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(data.lower()) if m.end(1) - m.start(1) >= LEAST_VALUE]
    out += [("access", *m.span()) for m in _ACCESS.finditer(data)]
    out += [("hex", *m.span()) for m in _HEX.finditer(data)]
    for m in _TOKEN.finditer(data):
        n = None if m.start() and _TOKEN_BYTE.match(data, m.start() - 1) else token_end(m[0])
        if n:
            out.append(("jwt", m.start(), m.start() + n))
    at = 0
    while m := _CANDIDATE.search(data, at):
        written = data[m.start() - 1 : m.start()] == b"\\" and data[m.start()] in b"nrt"  # the letter of a line break before it
        one = _confirmed(data, m.start() + written, m.end(), depth)
        if one:
            out.append(one)
        at = one[2] if one else m.end()
    return out


def find(text: str | None) -> list[tuple[str, int, int]]:
    """Kinds and spans in code points, by start and then kind as listed in ``KINDS``."""
    text = text or ""
    data = text.encode()
    found = _found(data)
    if found and len(data) != len(text):
        place, at, n = {}, 0, 0
        for k in sorted({x for _, a, b in found for x in (a, b)}):
            n += len(data[at:k].decode())
            place[k] = n
            at = k
        found = [(kind, place[a], place[b]) for kind, a, b in found]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = pa.array([[dict(zip(("kind", "start", "end"), f, strict=True)) for f in find(t.as_py())] for t in batch.column("text")], kind)
        yield pa.RecordBatch.from_arrays([batch.column("id"), found], names=["id", "found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, and ``found``: an array of kind, start and end."""
    modest_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    return own.mapInArrow(_scanned, f"id {own.schema['id'].dataType.simpleString()}, found array<struct<kind: string, start: long, end: long>>").withColumnRenamed("id", id_col)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """How many spans of each base kind a document has, the hash of their list, and the list of all spans."""
    of = lambda *kinds: F.filter("found", lambda f: f["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
